"""Writers and scans over the match view: what is written twice, by part or in conflict is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.functions import policy
from strictbefore.operators import basketball, identity, knowledge, reconcile
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played, table
from strictbefore.plans.scalar_queries import pick, pick_sql
from strictbefore.sources import readers, sinks, store

SLIM = ["fixture_id", "status_short", "home_goals", "away_goals"]
FIRST_SQL = "SELECT fixture_id, 'NS' AS status_short, CASE WHEN fixture_id % 3 > 0 THEN home_goals END AS home_goals, away_goals FROM matches"
LATER_SQL = "SELECT fixture_id, status_short, home_goals + fixture_id % 2 AS home_goals, CASE WHEN fixture_id % 4 > 0 THEN away_goals END AS away_goals FROM matches WHERE status_short <> 'NS'"


def deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The season before it began, some scores missing, and the finished matches with other ones missing or corrected."""
    found = matches(spark, sf_dir)
    k = F.col("fixture_id")
    first = found.select(k, F.lit("NS").alias("status_short"), F.when(k % 3 > 0, F.col("home_goals")).alias("home_goals"), "away_goals")
    later = found.filter("status_short != 'NS'").select(k, "status_short", (F.col("home_goals") + k % 2).alias("home_goals"), F.when(k % 4 > 0, F.col("away_goals")).alias("away_goals"))
    return first, later


def upserted(spark: SparkSession, sf_dir: str, new_wins: bool) -> DataFrame:
    path = sinks.scratch(spark, "upserts")
    for rows in deliveries(spark, sf_dir):
        latest = sinks.upsert(rows, path, ["fixture_id"], new_wins)
    return spark.read.parquet(latest).select(*SLIM)


def merged_sql(first: str, second: str) -> str:
    return f"""WITH {MATCHES_SQL}, a AS ({FIRST_SQL}), b AS ({LATER_SQL})
    SELECT fixture_id, {", ".join(f"coalesce({first}.{c}, {second}.{c}) AS {c}" for c in SLIM[1:])} FROM a FULL JOIN b USING (fixture_id)"""


@query("upserted_fixtures", merged_sql("b", "a"))
def upserted_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries merged by id, the later winning where it says something."""
    return upserted(spark, sf_dir, True)


@query("enriched_upserts", merged_sql("a", "b"))
def enriched_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries merged by id, what is stored winning where it says something."""
    return upserted(spark, sf_dir, False)


@query("first_predictions", f"WITH {MATCHES_SQL} SELECT fixture_id, CASE WHEN status_short = 'NS' THEN 'late' ELSE 'early' END AS said FROM matches")
def first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first write of a key wins: finished matches are said early, then all are said again."""
    path = sinks.scratch(spark, "predictions")
    found = matches(spark, sf_dir)
    sinks.append_new(found.filter("status_short != 'NS'").select("fixture_id", F.lit("early").alias("said")), path, ["fixture_id"])
    sinks.append_new(found.select("fixture_id", F.lit("late").alias("said")), path, ["fixture_id"])
    return spark.read.parquet(path).select("fixture_id", "said")


@query("saved_runs", f"WITH {MATCHES_SQL}, m AS (SELECT season AS run_id, league_id, count(*) AS n FROM matches GROUP BY ALL) SELECT run_id, league_id, CASE WHEN run_id >= 1996 THEN n + 1000 ELSE n END AS n FROM m")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs saved twice: a run's metrics are replaced, other runs' stay."""
    path = sinks.scratch(spark, "runs")
    runs = matches(spark, sf_dir).groupBy(F.col("season").alias("run_id"), "league_id").agg(F.count("*").alias("n"))
    sinks.save_run(runs, path)
    sinks.save_run(runs.filter("run_id >= 1996").withColumn("n", F.col("n") + 1000), path)
    return spark.read.parquet(path).select("run_id", "league_id", "n")


@query(
    "recorded_results",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, CASE WHEN fixture_id % 4 = 0 THEN CASE WHEN fixture_id % 8 = 0 THEN 'conflict' ELSE 'unchanged' END WHEN fixture_id % 3 = 0 THEN 'no_prediction' ELSE 'recorded' END AS state,
      CASE WHEN fixture_id % 8 = 0 OR (fixture_id % 4 > 0 AND fixture_id % 3 = 0) THEN NULL WHEN fixture_id % 3 > 0 THEN home_goals > away_goals END AS correct FROM played""",
)
def recorded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results recorded once: some are stored already, some of these with another score; some matches had no prediction."""
    found, k = played(matches(spark, sf_dir)), F.col("fixture_id")
    results = found.select("fixture_id", "home_goals", "away_goals")
    stored = found.filter(k % 4 == 0).select("fixture_id", (F.col("home_goals") + F.when(k % 8 == 0, 1).otherwise(0)).alias("home_goals"), "away_goals")
    said = found.filter(k % 3 > 0).select("fixture_id", F.lit("home_win").alias("pick"))
    return sinks.record_results(results, stored, said, "fixture_id", ["home_goals", "away_goals"], policy.outcome(F.col("home_goals"), F.col("away_goals"))).select("fixture_id", "state", "correct")


@query(
    "accepted_identities",
    """SELECT 'p' AS provider, s_suppkey::VARCHAR AS provider_team_id, CASE s_suppkey % 4 WHEN 0 THEN 'team_' || s_suppkey WHEN 1 THEN 'team_' || s_suppkey WHEN 2 THEN 'old_' || s_suppkey END AS canonical_id,
      CASE s_suppkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'known' ELSE 'refused' END AS state FROM supplier""",
)
def accepted_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity mappings, refused where an id stands for another team already or for two at once."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.lit("p").alias("provider"), k.cast("string").alias("provider_team_id"), k, F.concat(F.lit("team_"), k).alias("canonical_id"))
    twice = rows.filter(k % 4 == 3).withColumn("canonical_id", F.concat(F.lit("other_"), k))
    stored = rows.filter((k % 4).isin(1, 2)).withColumn("canonical_id", F.when(k % 4 == 1, F.col("canonical_id")).otherwise(F.concat(F.lit("old_"), k)))
    return sinks.accepted_identities(rows.unionByName(twice).drop("s_suppkey"), stored.drop("s_suppkey"))


@query(
    "ledger_lines",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, CASE WHEN fixture_id % 2 = 0 THEN 'corrected' ELSE status_short END AS outcome FROM matches""",
)
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed ledger of JSON lines written twice over, of which the later line of a key counts."""
    path = sinks.scratch(spark, "ledger")
    found, k = matches(spark, sf_dir), F.col("fixture_id")
    sinks.write_ledger(found.select("fixture_id", F.col("status_short").alias("outcome")), f"{path}/1")
    sinks.write_ledger(found.filter(k % 2 == 0).select("fixture_id", F.lit("corrected").alias("outcome")), f"{path}/2")
    got = readers.last_lines(spark, f"{path}/*/*.json.gz", "fixture_id")
    return got.select(F.col("key").cast("long").alias("fixture_id"), F.get_json_object("raw", "$.outcome").alias("outcome"))


ENRICHMENT_SQL = f"""WITH {MATCHES_SQL}, e AS (
  SELECT fixture_id, 'football_data_csv' AS source, home_goals * 3 AS home_shots, home_goals AS home_corners FROM matches WHERE fixture_id % 2 = 0
  UNION ALL SELECT fixture_id, 'api_football', home_goals * 4, NULL FROM matches WHERE fixture_id % 3 = 0 UNION ALL SELECT fixture_id, 'scraped', NULL, NULL FROM matches)"""


def enrichment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two sources for some matches and an empty row of a third for all, by rule."""
    k, g = F.col("fixture_id"), F.col("home_goals")
    none = F.lit(None).cast("long")
    row = lambda source, shots, corners: F.struct(F.lit(source).alias("source"), shots.alias("home_shots"), corners.alias("home_corners"))
    rows = F.array_compact(F.array(F.when(k % 2 == 0, row("football_data_csv", g * 3, g)), F.when(k % 3 == 0, row("api_football", g * 4, none)), row("scraped", none, none)))
    return matches(spark, sf_dir).select("fixture_id", F.explode(rows).alias("r")).select("fixture_id", "r.*")


@query("best_enrichment", f"{ENRICHMENT_SQL} SELECT fixture_id, source, home_shots FROM e WHERE source = CASE WHEN fixture_id % 3 = 0 THEN 'api_football' WHEN fixture_id % 2 = 0 THEN 'football_data_csv' ELSE 'scraped' END")
def best_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match's statistics from the most believed source that has a row of it."""
    return store.enrichment(enrichment_rows(spark, sf_dir), matches(spark, sf_dir)).select("fixture_id", "source", "home_shots")


@query("provenance_only_rows", f"{ENRICHMENT_SQL} SELECT fixture_id, source FROM e WHERE source = 'scraped' AND home_shots IS NULL AND home_corners IS NULL AND fixture_id IN (SELECT fixture_id FROM e WHERE home_shots IS NOT NULL)")
def provenance_only_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only say where they come from, beside others that have figures: those that are archived before they are deleted."""
    rows = enrichment_rows(spark, sf_dir)
    archived, _ = sinks.retire(rows, reconcile.provenance_only(rows, "fixture_id", ["scraped", "reconciled"], ["home_shots", "home_corners"], "home_shots"), ["fixture_id", "source"])
    return archived.select("fixture_id", "source")


@query("kept_rows", f"{ENRICHMENT_SQL} SELECT source, count(*) AS n FROM e WHERE NOT (source = 'scraped' AND home_shots IS NULL AND home_corners IS NULL AND fixture_id IN (SELECT fixture_id FROM e WHERE home_shots IS NOT NULL)) GROUP BY source")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment_rows(spark, sf_dir)
    _, kept = sinks.retire(rows, reconcile.provenance_only(rows, "fixture_id", ["scraped"], ["home_shots", "home_corners"], "home_shots"), ["fixture_id", "source"])
    return kept.groupBy("source").agg(F.count("*").alias("n"))


def stored_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match view as a stored table partitioned by league and season, with provenance by rule."""
    path = sinks.scratch(spark, "fixtures")
    k = F.col("fixture_id")
    raw = F.concat(F.lit('{"provider_provenance":{"provider":"'), F.when(k % 2 == 0, "alpha").otherwise("beta"), F.lit('"}'), F.when(k % 11 == 0, F.lit(',"reconciliation_metadata":{"legacy_duplicate_candidate":true}')).otherwise(""), F.lit("}"))
    rows = matches(spark, sf_dir).withColumns({"raw_json": raw, "source": F.lit("mixed"), "canonical_home_id": F.concat(F.lit("team_"), "home_id"), "canonical_away_id": F.concat(F.lit("team_"), "away_id")})
    sinks.overwrite_partitions(rows, path, "league_id", "season")
    return spark.read.parquet(path)


@query(
    "league_season_fixtures",
    f"WITH {MATCHES_SQL} SELECT fixture_id, kickoff_at, row_number() OVER (ORDER BY kickoff_at, fixture_id) - 1 AS place FROM matches WHERE league_id = 2 AND season = 1995 AND fixture_id % 11 <> 0 AND fixture_id % 2 = 0",
)
def league_season_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of one stored league-season in time order, one provider's rows, no duplicates."""
    got = store.fixtures(stored_fixtures(spark, sf_dir), 2, 1995, ["alpha"])
    place = F.row_number().over(Window.partitionBy("league_id", "season").orderBy("kickoff_at", "fixture_id")) - 1
    return got.select("fixture_id", "kickoff_at", place.cast("long").alias("place"))


@query(
    "team_history",
    f"WITH {MATCHES_SQL}, r AS (SELECT fixture_id, kickoff_at FROM matches WHERE 7 IN (home_id, away_id) AND kickoff_at < TIMESTAMP '1996-06-01' ORDER BY kickoff_at DESC, fixture_id DESC LIMIT 10) SELECT * FROM r",
)
def team_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of a team's last ten matches before a cutoff."""
    return store.last_of_team(stored_fixtures(spark, sf_dir), "team_7", "1996-06-01 00:00:00", 10).select("fixture_id", "kickoff_at")


@query("dataset_manifests", f"WITH {MATCHES_SQL} SELECT league_id, season, CASE WHEN season % 3 > 0 THEN 300 END AS expected, count(DISTINCT fixture_id) AS stored, max(kickoff_at) AS latest, CASE WHEN season % 3 = 0 THEN 'UNVERIFIABLE' WHEN count(DISTINCT fixture_id) >= 300 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM matches GROUP BY league_id, season")
def dataset_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against expected fixtures of every league-season, expectations by rule."""
    found = matches(spark, sf_dir)
    expected = found.select("league_id", "season").distinct().withColumn("expected", F.when(F.col("season") % 3 > 0, 300))
    return store.manifest(found, expected, "league_id", "season").select("league_id", "season", "expected", "stored", "latest", "status")


STAGES = ["Regular Season - 1", "Relegation_Playoff", "playoff", "", None, "relegation_playoff final"]
STAGE_FLAGS = [0, 1, 1, 0, 0, 1]
LEAGUES = ["Premier League", "Serie A", "U21 premier cup", "La Liga", None]


@query(
    "fixture_filters",
    f"""WITH {MATCHES_SQL}, s AS (SELECT *, {pick_sql(STAGE_FLAGS, "fixture_id")} = 1 OR home_id = 33 OR away_id = 33 AS ex, lower({pick_sql(LEAGUES, "fixture_id")}) AS lg FROM matches)
    SELECT fixture_id, ex AS excluded, coalesce(contains(lg, 'premier') OR contains(lg, 'liga'), false) AS kept_league, (home_id % 10 = 1 AND away_id % 10 = 2) OR (home_id % 10 = 2 AND away_id % 10 = 1) AS found, home_goals IS NOT NULL AND away_goals IS NOT NULL AS gradeable FROM s""",
)
def fixture_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages outside the season, leagues kept by keyword, a search by two names in either order, and whether a match can be settled."""
    k = F.col("fixture_id")
    digits = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    name = lambda side: F.concat(F.when(F.col(f"{side}_id") == 33, "Elversberg ").otherwise("Town "), pick(list(digits), F.col(f"{side}_id")))
    found = matches(spark, sf_dir)
    return found.select(
        k, policy.excluded_stage([pick(STAGES, k)], name("home"), name("away"), "relegation_playoff", ("elversberg",)).alias("excluded"), policy.keeps_league(pick(LEAGUES, k), ("Premier", "Liga")).alias("kept_league"),
        policy.names_match(name("home"), name("away"), "One", "two").alias("found"), policy.gradeable(F.col("home_goals"), F.col("away_goals")).alias("gradeable"),
    )


@query(
    "strict_provider_matches",
    f"""WITH {MATCHES_SQL}, a AS (SELECT fixture_id, league_id, season, kickoff_at::DATE AS day, home_id, away_id FROM matches)
    SELECT a.fixture_id AS left_id, b.fixture_id + 1000000 AS right_id FROM a JOIN a b ON a.league_id = b.league_id AND a.season = b.season AND a.home_id = b.home_id AND a.away_id = b.away_id AND a.day = b.day + CASE WHEN b.fixture_id % 7 = 0 THEN 1 ELSE 0 END""",
)
def strict_provider_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers' fixtures by identity alone; the second has its own ids and some days wrong."""
    found = matches(spark, sf_dir)
    side = lambda df, day: df.select("fixture_id", F.lit("football").alias("sport"), "league_id", "season", day.alias("day"), F.concat(F.lit("t"), "home_id").alias("canonical_home_id"), F.concat(F.lit("t"), "away_id").alias("canonical_away_id"))
    day = F.to_date("kickoff_at")
    other = side(found, F.date_add(day, F.when(F.col("fixture_id") % 7 == 0, 1).otherwise(0))).withColumn("fixture_id", F.col("fixture_id") + 1_000_000)
    return reconcile.strict_matches(side(found, day), other)


GAME_STATUS, GAME_PHASES = ["FT", "AOT", "NS", "PST"], ["regular_season", "preseason", "postseason", "play_in", "all_star", "regular_season", None]
GAME_SQL = f"""WITH {MATCHES_SQL}, gm AS (SELECT fixture_id AS game_id, league_id, season, kickoff_at, home_id, CASE WHEN fixture_id % 29 = 0 THEN home_id ELSE away_id END AS away_id, {pick_sql(GAME_STATUS, "fixture_id")} AS status_short, {pick_sql(GAME_PHASES, "fixture_id")} AS phase,
  CASE WHEN fixture_id % 19 = 0 THEN -1 ELSE 90 + home_goals * 3 END AS hp, 90 + away_goals * 3 AS ap FROM matches)"""


def stored_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball games by rule: phases, statuses, some broken."""
    k = F.col("fixture_id")
    return matches(spark, sf_dir).select(
        k.alias("game_id"), "league_id", "season", F.col("kickoff_at").alias("game_at"), "home_id", F.when(k % 29 == 0, F.col("home_id")).otherwise(F.col("away_id")).alias("away_id"), pick(GAME_STATUS, k).alias("status_short"), pick(GAME_PHASES, k).alias("phase"),
        F.when(k % 19 == 0, F.lit(-1)).otherwise(90 + F.col("home_goals") * 3).alias("home_points"), (90 + F.col("away_goals") * 3).alias("away_points"),
    )


@query(
    "game_rejections",
    f"""{GAME_SQL} SELECT game_id, CASE WHEN game_id <= 0 THEN 'missing_invalid_or_non_positive_game_id' WHEN NOT kickoff_at < TIMESTAMP '1998-01-01' THEN 'game_not_before_cutoff' WHEN home_id <= 0 THEN 'missing_invalid_or_non_positive_home_team_id' WHEN away_id <= 0 THEN 'missing_invalid_or_non_positive_away_team_id' WHEN home_id = away_id THEN 'identical_home_and_away_team_ids'
      WHEN coalesce(phase NOT IN ('regular_season', 'play_in', 'postseason'), true) THEN 'phase_not_counted' WHEN status_short NOT IN ('FT', 'AOT') THEN 'game_not_completed' WHEN hp < 0 THEN 'invalid_or_negative_home_points'
      WHEN hp IS NULL OR ap IS NULL THEN 'completed_game_missing_points' WHEN hp = ap THEN 'completed_game_tied' END AS reason FROM gm""",
)
def game_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a basketball game isn't taken in."""
    rows = stored_games(spark, sf_dir)
    reason = basketball.reject_reason({c: F.col(c) for c in rows.columns}, F.col("league_id"), F.col("season"), F.lit("1998-01-01").cast("timestamp"))
    return rows.select("game_id", reason.alias("reason"))


@query("game_phases", f"{GAME_SQL} SELECT league_id, season, {', '.join(f'count(*) FILTER (phase = {chr(39)}{p}{chr(39)}) AS {p}' for p in basketball.PHASES)}, count(*) FILTER (phase IS NULL) AS unknown_phase FROM gm GROUP BY ALL")
def game_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basketball.phase_counts(stored_games(spark, sf_dir), "league_id", "season")


@query(
    "game_manifests",
    f"""{GAME_SQL}, d AS (SELECT *, status_short IN ('FT', 'AOT') AND hp IS NOT NULL AND ap IS NOT NULL AS done FROM gm), t AS (SELECT league_id, season, count(DISTINCT u) AS teams FROM (SELECT league_id, season, unnest([home_id, away_id]) AS u FROM gm) GROUP BY ALL),
    p AS (SELECT league_id, season, count(*) AS stored, count(DISTINCT game_id) AS ids, count(*) FILTER (done) AS completed, count(*) FILTER (done AND hp = ap) AS tied, count(*) FILTER (phase IN ('regular_season', 'play_in', 'postseason')) AS counted FROM d GROUP BY ALL)
    SELECT p.*, teams, CASE WHEN stored > ids THEN 'duplicate_ids' WHEN tied > 0 THEN 'tied_games' WHEN teams <> 20 THEN 'team_universe_mismatch' WHEN completed < stored THEN 'incomplete' ELSE 'verified' END AS verdict FROM p JOIN t USING (league_id, season)""",
)
def game_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basketball.manifest(stored_games(spark, sf_dir), 20, "league_id", "season")


@query(
    "minted_identities",
    """SELECT 'p' AS provider, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE 'name:' || (s_suppkey % 5) || ':town ' || s_suppkey END AS provider_team_id, 'town ' || s_suppkey AS normalized_name, s_suppkey % 5 AS league_id, 'football_team_town_' || s_suppkey AS canonical_id, 'Town ' || s_suppkey || ' FC' AS display_name FROM supplier""",
)
def minted_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identities for teams that nothing resolves."""
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(F.lit("p").alias("provider"), F.when(k % 2 == 0, k).cast("string").alias("provider_team_id"), F.concat(F.lit("Town "), k, F.lit(" FC")).alias("name"), (k % 5).alias("league_id"))
    return identity.mint(raw.unionByName(raw), "football")


@query(
    "competition_gaps",
    """WITH c AS (SELECT n_nationkey AS league_id, n_name AS name, 2000 + n_regionkey AS f, 2004 + n_regionkey AS t FROM nation WHERE n_nationkey % 5 > 0), s AS (SELECT unnest(range(2001, 2007)) AS season),
    own AS (SELECT league_id, name, season, season BETWEEN f AND t AS ex FROM c, (SELECT unnest(range(2000, 2010)) AS season) WHERE season BETWEEN 2001 AND 2006 OR season BETWEEN f AND t),
    r AS (SELECT league_id, name, season, ex, CASE WHEN season % 2 = 0 THEN 18 END AS teams, CASE WHEN season % 4 = 0 THEN 306 END AS total FROM own UNION ALL SELECT n_nationkey, n_name, season, NULL, CASE WHEN season % 2 = 0 THEN 18 END, CASE WHEN season % 4 = 0 THEN 306 END FROM nation, s WHERE n_nationkey % 5 = 0)
    SELECT league_id, name, season::INT AS season, ex AS "exists", teams AS participants, total AS fixture_total,
      concat_ws(',', CASE WHEN ex IS NULL THEN 'competition_not_catalogued' END, CASE WHEN NOT ex THEN 'edition_not_documented' END, CASE WHEN ex AND teams IS NULL THEN 'participants_unknown' END, CASE WHEN ex AND total IS NULL THEN 'fixture_total_unknown' END) AS gaps FROM r""",
)
def competition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap report over a catalogue made of nations: some aren't catalogued, the others documented for five years each."""
    nations = table(spark, sf_dir, "nation").select(F.lit("football").alias("sport"), F.col("n_nationkey").cast("long").alias("league_id"), F.col("n_name").alias("name"), "n_regionkey")
    start = (F.lit(2000) + F.col("n_regionkey")).cast("int")
    rule = F.struct(F.lit("annual").alias("type"), start.alias("from"), (start + 4).alias("to"), F.array().cast("array<int>").alias("editions"), F.lit(None).cast("int").alias("future_to"))
    known = nations.select("league_id", F.explode(F.sequence(F.lit(2000), F.lit(2009))).alias("season")).select("league_id", "season", F.when(F.col("season") % 2 == 0, 18).alias("participants"), F.when(F.col("season") % 4 == 0, 306).alias("fixture_total"))
    report = knowledge.gap_report(nations.filter("league_id % 5 > 0").withColumn("edition_rule", rule), nations, known, 2001, 2006)
    return report.select("league_id", "name", "season", "exists", "participants", "fixture_total", F.array_join("evidence_gaps", ",").alias("gaps"))


@query(
    "both_teams_snapshots",
    f"""WITH {MATCHES_SQL}, t AS (SELECT fixture_id, team_id, at_home, count(*) OVER w AS n, sum(gf) OVER w AS gf, sum(ga) OVER w AS ga, count(*) FILTER (at_home) OVER w AS nh, sum(gf) FILTER (at_home) OVER w AS gfh FROM team_rows WINDOW w AS (PARTITION BY league_id, season, team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT fixture_id, count(*) OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM played)
    SELECT h.fixture_id, h.n AS home_matches, coalesce(h.gf, 0)::BIGINT AS home_goals_for, coalesce(h.ga, 0)::BIGINT AS home_goals_against, h.nh AS home_at_home, coalesce(h.gfh, 0)::BIGINT AS home_goals_at_home,
      a.n AS away_matches, coalesce(a.gf, 0)::BIGINT AS away_goals_for, coalesce(a.ga, 0)::BIGINT AS away_goals_against, a.nh AS away_at_home, coalesce(a.gfh, 0)::BIGINT AS away_goals_at_home, met >= 3 AS enough_meetings
    FROM t h JOIN t a ON a.fixture_id = h.fixture_id AND h.at_home AND NOT a.at_home JOIN m ON m.fixture_id = h.fixture_id""",
)
def both_teams_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' records before every match side by side, at home apart, and whether they have met often enough."""
    from strictbefore.operators import features
    from strictbefore.plans.matches import team_rows

    found = matches(spark, sf_dir)
    per = features.team_records(team_rows(found), "league_id", "season")
    values = ["matches", "goals_for", "goals_against", "at_home", "goals_at_home"]
    met = features.head_to_head(played(found)).select("fixture_id", "meetings")
    # meetings are counted up to six there; three are enough
    got = features.both_sides(played(found).select("fixture_id", "home_id", "away_id"), per, values).join(met, "fixture_id")
    return got.select("fixture_id", *[f"{side}_{v}" for side in ("home", "away") for v in values], (F.col("meetings") >= 3).alias("enough_meetings"))


@query(
    "unioned_sources",
    f"""WITH {MATCHES_SQL}, u AS (SELECT fixture_id AS id, home_id, away_id, kickoff_at::DATE AS day, 1 AS place FROM matches UNION ALL SELECT CASE WHEN fixture_id % 2 = 0 THEN fixture_id END, home_id, away_id, kickoff_at::DATE, 2 FROM matches),
    k AS (SELECT *, CASE WHEN id IS NOT NULL THEN 'id:' || id ELSE 'logical:' || home_id || ':' || away_id || ':' || strftime(day, '%Y-%m-%d') END AS key FROM u)
    SELECT key, min(place)::INT AS place FROM k GROUP BY key""",
)
def unioned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' fixtures as one set: by id, where there is none by both teams and the day; the first source's row stays."""
    found, k = matches(spark, sf_dir), F.col("fixture_id")
    day = F.date_format("kickoff_at", "yyyy-MM-dd")
    side = lambda id_, place: found.select(F.when(id_.isNotNull(), F.concat(F.lit("id:"), id_)).otherwise(F.concat_ws(":", F.lit("logical"), "home_id", "away_id", day)).alias("key"), F.lit(place).alias("place"))
    return side(k, 1).unionByName(side(F.when(k % 2 == 0, k), 2)).groupBy("key").agg(F.min("place").alias("place"))



#: What is broken in a payload, by the fixture's id modulo 16.
BROKEN = {
    1: ("missing_invalid_or_non_positive_game_id", '"id":0'), 2: ("missing_game_date", '"date":7'), 3: ("missing_or_invalid_teams_object", '"teams":[]'), 4: ("missing_home_or_away_team_object", '"teams":{"home":{"id":1,"name":"A"}}'),
    5: ("identical_home_and_away_team_ids", '"teams":{"home":{"id":3,"name":"A"},"away":{"id":3,"name":"B"}}'), 6: ("missing_or_empty_away_team_name", '"teams":{"home":{"id":1,"name":"A"},"away":{"id":2,"name":" "}}'), 7: ("invalid_payload_league_id", '"league":{"id":"x"}'),
    8: ("conflicting_season (1900 != 2000)", '"league":{"id":12,"season":1900}'), 9: ("game_not_completed (status=NS)", '"status":{"short":"ns"}'), 10: ("game_not_completed (status=UNKNOWN)", '"status":{"type":{"completed":false},"completed":true}'),
    11: ("invalid_or_negative_home_points", '"scores":{"home":{"total":-4},"away":80}'), 12: ("completed_game_missing_points (status=FT)", '"scores":{"home":{"total":81}}'),
}
FITS = {"id": '"id":{id}', "date": '"date":"{date}"', "teams": '"teams":{"home":{"id":1,"name":"A"},"away":{"id":2,"name":"B"}}', "league": '"league":{"id":12,"season":2000}', "status": '"status":{"short":"FT"}', "scores": '"scores":{"home":{"total":90},"away":80}'}


@query(
    "validated_games",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, CASE WHEN fixture_id % 16 = 1 THEN '{BROKEN[1][0]}' WHEN fixture_id % 16 = 2 THEN '{BROKEN[2][0]}' WHEN NOT kickoff_at < TIMESTAMP '1997-01-01' THEN 'game_date_not_before_cutoff'
      {" ".join(f"WHEN fixture_id % 16 = {k} THEN '{reason}'" for k, (reason, _) in BROKEN.items() if k > 2)} ELSE 'valid' END AS reason FROM matches""",
)
def validated_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of games, some broken, through the ingestion rules."""
    k = F.col("fixture_id") % 16
    text = lambda part: F.replace(F.replace(F.lit(part), F.lit("{id}"), (F.col("fixture_id") + 1).cast("string")), F.lit("{date}"), F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parts = []
    for name, fits in FITS.items():
        part = text(fits)
        for n, (_, broken) in BROKEN.items():
            if broken.startswith(f'"{name}"'):
                part = F.when(k == n, F.lit(broken)).otherwise(part)
        parts.append(part)
    payload = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = sinks.stored(matches(spark, sf_dir).select("fixture_id", payload.alias("payload")), "payloads")
    verdict = basketball.payload_verdict(F.col("payload"), F.lit(12), F.lit(2000), F.lit("1997-01-01").cast("timestamp"), True)
    return rows.select("fixture_id", verdict["reason"].alias("reason"))
