"""Joins, reconciliation, audits, strings, dates and JSON over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.functions import policy, text
from strictbefore.functions import time as clock
from strictbefore.operators import quality, reconcile
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played, table


@query("enrichment_counts", "SELECT o_orderstatus, year(o_orderdate)::INT AS season, count(*) AS fixtures, count(n) AS enriched FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY ALL")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to the enriched side, grouped by two keys."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    got = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return got.groupBy("o_orderstatus", F.year("o_orderdate").alias("season")).agg(F.count("*").alias("fixtures"), F.count("n").alias("enriched"))


@query(
    "detail_counts",
    """SELECT year(o_orderdate)::INT AS season, count(*) AS games, count(r.k) AS returned, count(b.k) AS bulky, count(x.k) AS taxed FROM orders
       LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') r ON r.k = o_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) b ON b.k = o_orderkey
       LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax > 0.07) x ON x.k = o_orderkey GROUP BY ALL""",
)
def detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three child tables joined by existence; one pass over the children says which kinds each key has."""
    kinds = {"returned": F.col("l_returnflag") == "R", "bulky": F.col("l_quantity") > 45, "taxed": F.col("l_tax") > 0.07}
    has = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(c.cast("int")).alias(k) for k, c in kinds.items()])
    got = table(spark, sf_dir, "orders").join(has, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return got.groupBy(F.year("o_orderdate").alias("season")).agg(F.count("*").alias("games"), *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in kinds])


@query("pending_fixtures", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def pending_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@query("enriched_fixtures", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def enriched_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query(
    "gap_flags",
    """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS has_open FROM orders
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS as columns and in a disjunction."""
    flags = {"has_return": F.col("l_returnflag") == "R", "has_open": F.col("l_linestatus") == "O", "bulky": F.col("l_quantity") > 40}
    has = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(c).alias(k) for k, c in flags.items()])
    got = table(spark, sf_dir, "orders").join(has, F.col("o_orderkey") == F.col("l_orderkey"), "left").filter(F.col("bulky") | F.col("l_orderkey").isNull())
    return got.select("o_orderkey", *[F.coalesce(k, F.lit(False)).alias(k) for k in ("has_return", "has_open")])


PROVIDER_SQL = f"""{MATCHES_SQL}, other AS (
  SELECT fixture_id + 1000000 AS other_id, league_id, home_id, away_id, home_goals, away_goals, (kickoff_at + INTERVAL (fixture_id % 4 - 1) DAY)::DATE AS day FROM played WHERE fixture_id % 3 <> 0)"""


def second_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another provider's records of two thirds of the matches, up to two days off."""
    day = F.to_date(F.expr("kickoff_at + make_interval(0, 0, 0, int(fixture_id % 4 - 1))"))
    return played(matches(spark, sf_dir)).filter("fixture_id % 3 != 0").select((F.col("fixture_id") + 1_000_000).alias("other_id"), "league_id", "home_id", "away_id", "home_goals", "away_goals", day.alias("day"))


@query(
    "band_matched_fixtures",
    f"""WITH {PROVIDER_SQL}, p AS (
      SELECT a.fixture_id, b.other_id FROM played a JOIN other b ON a.league_id = b.league_id AND a.home_id = b.home_id AND a.away_id = b.away_id AND a.home_goals = b.home_goals AND a.away_goals = b.away_goals AND abs(date_diff('day', a.kickoff_at::DATE, b.day)) <= 1)
    SELECT fixture_id, other_id FROM (SELECT *, count(*) OVER (PARTITION BY fixture_id) AS a, count(*) OVER (PARTITION BY other_id) AS b FROM p) WHERE a = 1 AND b = 1""",
)
def band_matched_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers' records of a match: same teams and score, a day apart at most, one to one."""
    own = played(matches(spark, sf_dir)).withColumn("own_day", F.to_date("kickoff_at"))
    keys = ["league_id", "home_id", "away_id", "home_goals", "away_goals"]
    pairs = reconcile.band_join(own.select("fixture_id", "own_day", *keys), second_provider(spark, sf_dir), keys, "own_day", "day").select("fixture_id", F.col("r_other_id").alias("other_id"))
    return reconcile.one_to_one(pairs, "fixture_id", "other_id")


@query(
    "best_unique_fixture",
    f"""WITH {PROVIDER_SQL}, p AS (
      SELECT a.fixture_id, b.other_id, (a.home_id = b.home_id)::INT * 3 + (a.away_id = b.away_id)::INT * 2 AS score
      FROM played a JOIN other b ON a.league_id = b.league_id AND a.kickoff_at::DATE = b.day AND a.home_goals = b.home_goals AND a.away_goals = b.away_goals),
    t AS (SELECT *, max(score) OVER (PARTITION BY fixture_id) AS top FROM p WHERE score >= 2)
    SELECT fixture_id, any_value(other_id) AS other_id FROM t WHERE score = top GROUP BY fixture_id HAVING count(*) = 1""",
)
def best_unique_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket by league, day and score; the best agreement on teams wins if it is alone."""
    own = played(matches(spark, sf_dir)).withColumn("own_day", F.to_date("kickoff_at")).select("fixture_id", "league_id", "own_day", "home_goals", "away_goals", "home_id", "away_id")
    keys = ["league_id", "home_goals", "away_goals"]
    pairs = reconcile.band_join(own, second_provider(spark, sf_dir), keys, "own_day", "day", days=0)
    score = (F.col("home_id") == F.col("r_home_id")).cast("int") * 3 + (F.col("away_id") == F.col("r_away_id")).cast("int") * 2
    return reconcile.unique_best(pairs, "fixture_id", score, 2).select("fixture_id", F.col("r_other_id").alias("other_id"))


@query(
    "snapshot_comparison",
    f"""WITH {PROVIDER_SQL}, j AS (SELECT coalesce(a.league_id, b.league_id) AS league_id, a.fixture_id, b.other_id, a.kickoff_at::DATE = b.day AS same_day FROM played a FULL JOIN other b ON a.fixture_id = b.other_id - 1000000)
    SELECT league_id, count(*) FILTER (fixture_id IS NOT NULL AND other_id IS NOT NULL) AS both, count(*) FILTER (other_id IS NULL) AS only_own, count(*) FILTER (fixture_id IS NULL) AS only_other, count(*) FILTER (same_day) AS same_day FROM j GROUP BY league_id""",
)
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = played(matches(spark, sf_dir)).select("fixture_id", "league_id", F.to_date("kickoff_at").alias("own_day"))
    other = second_provider(spark, sf_dir).select((F.col("other_id") - 1_000_000).alias("key"), F.col("league_id").alias("other_league"), "day")
    both = own.join(other, F.col("fixture_id") == F.col("key"), "full_outer")
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return both.groupBy(F.coalesce("league_id", "other_league").alias("league_id")).agg(
        count(F.col("fixture_id").isNotNull() & F.col("key").isNotNull(), "both"), count(F.col("key").isNull(), "only_own"), count(F.col("fixture_id").isNull(), "only_other"), count(F.col("own_day") == F.col("day"), "same_day")
    )


@query(
    "reconciled_scores",
    f"""WITH {MATCHES_SQL}, s AS (
      SELECT fixture_id, 'alpha' AS source, 2 AS place, CASE WHEN fixture_id % 4 <> 0 THEN home_goals END AS hg, away_goals AS ag FROM played
      UNION ALL SELECT fixture_id, 'beta', 1, home_goals + (fixture_id % 9 = 0)::INT, CASE WHEN fixture_id % 5 <> 0 THEN away_goals END FROM played WHERE fixture_id % 2 = 0)
    SELECT fixture_id, arg_min(hg, place) FILTER (hg IS NOT NULL) AS hg, arg_min(source, place) FILTER (hg IS NOT NULL) AS hg_source, coalesce(min(hg) <> max(hg), false) AS hg_disputed,
      arg_min(ag, place) FILTER (ag IS NOT NULL) AS ag, arg_min(source, place) FILTER (ag IS NOT NULL) AS ag_source, coalesce(min(ag) <> max(ag), false) AS ag_disputed FROM s GROUP BY fixture_id""",
)
def reconciled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of a score: each goal count from the first source that has it, with provenance and disputes."""
    found = played(matches(spark, sf_dir))
    alpha = found.select("fixture_id", F.lit("alpha").alias("source"), F.when(F.col("fixture_id") % 4 != 0, F.col("home_goals")).alias("hg"), F.col("away_goals").alias("ag"))
    shifted = F.col("home_goals") + (F.col("fixture_id") % 9 == 0).cast("int")
    beta = found.filter("fixture_id % 2 = 0").select("fixture_id", F.lit("beta").alias("source"), shifted.alias("hg"), F.when(F.col("fixture_id") % 5 != 0, F.col("away_goals")).alias("ag"))
    return reconcile.first_of_sources(alpha.unionByName(beta), "fixture_id", "source", ["beta", "alpha"], ["hg", "ag"])


@query(
    "merged_records",
    """WITH o AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS nat FROM customer WHERE c_custkey % 5 <> 0),
      n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 7 <> 0)
    SELECT coalesce(o.k, n.k) AS k, coalesce(n.seg, o.seg) AS seg, coalesce(n.nat, o.nat) AS nat, concat_ws(',', CASE WHEN o.seg <> n.seg THEN 'seg' END, CASE WHEN o.nat <> n.nat THEN 'nat' END) AS conflicts FROM o FULL JOIN n ON o.k = n.k""",
)
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert where the new value wins unless it is null."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nat"))
    seg = F.when(F.col("c_custkey") % 4 == 0, "NEW").when(F.col("c_custkey") % 4 == 1, F.col("c_mktsegment"))
    new = c.filter("c_custkey % 7 != 0").select(F.col("c_custkey").alias("k"), seg.alias("seg"), F.col("c_nationkey").alias("nat"))
    return reconcile.merge(old, new, ["k"]).withColumn("conflicts", F.array_join("conflicts", ","))


@query(
    "as_of_price",
    """WITH d AS (SELECT user_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events WHERE event_type = 'purchase'),
      f AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
    SELECT f.event_id, d.value AS last_purchase FROM f LEFT JOIN d ON d.user_id = f.user_id AND d.ts < f.ts AND (until IS NULL OR f.ts <= until)""",
)
def as_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's purchase as it stood strictly before."""
    e = table(spark, sf_dir, "events")
    got = reconcile.as_of(e.filter("event_type != 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "ts")
    return got.select("event_id", F.col("d_value").alias("last_purchase"))


@query("team_participation", f"WITH {MATCHES_SQL}, s AS (SELECT league_id, season, home_id AS team_id, 1 AS home FROM matches UNION ALL SELECT league_id, season, away_id, 0 FROM matches) SELECT league_id, season, team_id, sum(home)::BIGINT AS home, sum(1 - home)::BIGINT AS away, count(*) AS matches FROM s GROUP BY ALL")
def team_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.participation(matches(spark, sf_dir), "league_id", "season")


@query(
    "structural_coverage",
    f"""WITH {MATCHES_SQL}, s AS (SELECT league_id, season, home_id AS team_id FROM matches UNION ALL SELECT league_id, season, away_id FROM matches),
      p AS (SELECT league_id, season, team_id, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT league_id, season, count(*) AS teams, min(n) AS fewest, max(n) AS most FROM p GROUP BY ALL),
      f AS (SELECT league_id, season, count(*) AS fixtures, count(DISTINCT fixture_id) AS ids, count(DISTINCT (home_id, away_id, kickoff_at::DATE)) AS logical FROM matches GROUP BY ALL)
    SELECT league_id, season, fixtures, ids, logical, teams, fewest, most, CASE WHEN fixtures > ids THEN 'duplicate_ids' WHEN fixtures > logical THEN 'duplicate_fixtures' WHEN teams <> 20 THEN 'team_universe_mismatch'
      WHEN fixtures <> 380 THEN 'fixture_count_mismatch' WHEN fewest <> most THEN 'team_participation_imbalance' ELSE 'verified' END AS verdict FROM f JOIN t USING (league_id, season)""",
)
def structural_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structure(matches(spark, sf_dir), 20, "league_id", "season")


@query("field_coverage", f"WITH {MATCHES_SQL} SELECT league_id, season, count(*) AS rows, round(count(home_goals) / count(*), 6) AS home_goals_coverage, round(count(reg_home) / count(*), 6) AS reg_home_coverage FROM matches GROUP BY ALL")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.field_coverage(matches(spark, sf_dir), ["home_goals", "reg_home"], "league_id", "season")
    return got.withColumns({c: F.round(c, 6) for c in ("home_goals_coverage", "reg_home_coverage")})


@query("identity_conflicts", "SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey % 7) AS identities, min(c_custkey % 7) AS first, max(c_custkey % 7) AS last FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey % 7) > 1")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("identity", F.col("c_custkey") % 7)
    return quality.conflicting_names(rows, "c_mktsegment", "identity", "c_nationkey")


LEDGER_SQL = f"""{MATCHES_SQL}, l AS (
  SELECT fixture_id, league_id, unnest(['home_goals', 'away_goals', 'regulation']) AS field, unnest([home_goals IS NOT NULL, away_goals IS NOT NULL, reg_home IS NOT NULL]) AS there, status_short, season FROM matches),
led AS (SELECT fixture_id, league_id, field, CASE WHEN there THEN 'present' WHEN status_short = 'NS' THEN 'not_played' WHEN season < 1997 THEN 'before_era' ELSE 'provider_gap' END AS outcome FROM l)"""


def fixture_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("status_short") == "NS", "not_played").when(F.col("season") < 1997, "before_era").otherwise("provider_gap")
    rows = matches(spark, sf_dir)
    return quality.ledger(rows.withColumn("k", F.struct("fixture_id", "league_id")), "k", {"home_goals": F.col("home_goals"), "away_goals": F.col("away_goals"), "regulation": F.col("reg_home")}, reason).select("k.*", "field", "outcome")


@query("field_ledger", f"WITH {LEDGER_SQL} SELECT fixture_id, field, outcome FROM led")
def field_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_ledger(spark, sf_dir).select("fixture_id", "field", "outcome")


@query("ledger_cube", f"WITH {LEDGER_SQL} SELECT league_id, field, outcome, count(*) AS n FROM led GROUP BY CUBE (league_id, field, outcome)")
def ledger_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_ledger(spark, sf_dir).cube("league_id", "field", "outcome").agg(F.count("*").alias("n"))


@query("gap_pivot", f"WITH {LEDGER_SQL} SELECT league_id, count(*) FILTER (outcome = 'present') AS present, count(*) FILTER (outcome = 'not_played') AS not_played, count(*) FILTER (outcome = 'before_era') AS before_era, count(*) FILTER (outcome = 'provider_gap') AS provider_gap FROM led GROUP BY league_id")
def gap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fixture_ledger(spark, sf_dir).groupBy("league_id").pivot("outcome", ["present", "not_played", "before_era", "provider_gap"]).count()
    return got.na.fill(0)


@query(
    "season_lattice",
    f"""WITH {MATCHES_SQL}, lat AS (SELECT league_id, s::INT AS season FROM range(5) AS l(league_id), range(1993, 2003) AS r(s)), have AS (SELECT league_id, season, count(*) AS n FROM matches GROUP BY ALL)
    SELECT lat.league_id, lat.season, coalesce(n, 0) AS fixtures, n IS NULL AS missing FROM lat LEFT JOIN have ON have.league_id = lat.league_id AND have.season = lat.season""",
)
def season_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every league and season that should exist, with what is stored of it."""
    lattice = spark.range(5).select(F.col("id").alias("league_id"), F.explode(F.sequence(F.lit(1993), F.lit(2002))).alias("season"))
    have = matches(spark, sf_dir).groupBy("league_id", "season").agg(F.count("*").alias("n"))
    return lattice.join(have, ["league_id", "season"], "left").select("league_id", "season", F.coalesce("n", F.lit(0)).alias("fixtures"), F.col("n").isNull().alias("missing"))


@query(
    "dataset_lifecycle",
    f"""WITH {MATCHES_SQL}, s AS (SELECT league_id, season, count(*) AS n, max(kickoff_at)::DATE AS latest FROM matches GROUP BY ALL),
      w AS (SELECT *, make_date(season, 1, 1) AS first, make_date(season, 12, 31) AS last, DATE '1998-08-02' AS today, season % 3 <> 0 AS verified FROM s)
    SELECT league_id, season, n, latest, CASE WHEN NOT verified THEN CASE WHEN today <= last THEN 'ONGOING' ELSE 'UNKNOWN' END WHEN today < first THEN 'UPCOMING' WHEN today <= last THEN 'ONGOING'
      WHEN latest > last + 21 THEN 'UNKNOWN' ELSE 'COMPLETED' END AS state FROM w""",
)
def dataset_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matches(spark, sf_dir).groupBy("league_id", "season").agg(F.count("*").alias("n"), F.to_date(F.max("kickoff_at")).alias("latest"))
    first, last = clock.season_window(F.col("season"), (0, 1, 1), (0, 12, 31))
    state = quality.lifecycle(first, last, F.col("n"), F.col("latest"), F.lit("1998-08-02").cast("date"), F.col("season") % 3 != 0)
    return got.withColumn("state", state)


@query("deduplicated_events", "SELECT user_id, event_type, day, min(event_id) AS event_id FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY ALL")
def deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest id of each key."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("recent_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of every conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("n", n).filter("n <= 3").select("conv_id", "turn", "role")


@query("best_source", "SELECT doc_id, source FROM (SELECT doc_id % 300 AS doc_id, source, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 9 END, source, doc_id) AS n FROM documents) WHERE n = 1")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("key"), "source", "doc_id")
    place = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(9)
    return reconcile.keep_first(rows, ["key"], place.asc(), F.asc("source"), F.asc("doc_id")).select(F.col("key").alias("doc_id"), "source")


@query("filled_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def filled_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("carried", F.when(F.col("event_type") == "purchase", F.col("value")))
    return reconcile.fill_forward(rows, ["user_id"], "ts", "carried").select("event_id", "carried")


@query("slowest_targets", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def slowest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("sampled_candidates", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 200")
def sampled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200, 42)


@query(
    "union_distinct_fixtures",
    f"WITH {MATCHES_SQL} SELECT fixture_id FROM matches WHERE home_id % 20 = 3 UNION SELECT fixture_id FROM matches WHERE away_id % 20 = 7 UNION SELECT fixture_id FROM matches WHERE league_id = 2",
)
def union_distinct_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' fixtures and the league's, each once: one scan, as the parts are filters of one table."""
    found = matches(spark, sf_dir)
    return found.filter("home_id % 20 = 3 or away_id % 20 = 7 or league_id = 2").select("fixture_id").distinct()


@query(
    "team_set_differences",
    f"""WITH {MATCHES_SQL}, have AS (SELECT DISTINCT season, home_id AS team FROM matches WHERE home_goals > 3), want AS (SELECT DISTINCT season, t AS team FROM (SELECT DISTINCT season FROM matches), range(0, 110) AS r(t) WHERE t % 2 = 0)
    SELECT season, team, 'missing' AS kind FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT season, team, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""",
)
def team_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir)
    have = found.filter("home_goals > 3").select("season", F.col("home_id").alias("team")).distinct()
    want = found.select("season").distinct().select("season", F.explode(F.expr("sequence(0L, 108L, 2L)")).alias("team"))
    return want.subtract(have).withColumn("kind", F.lit("missing")).unionByName(have.subtract(want).withColumn("kind", F.lit("unexpected")))


@query("missing_fields", f"WITH {MATCHES_SQL} SELECT fixture_id, concat_ws(',', CASE WHEN home_goals IS NULL THEN 'goals' END, CASE WHEN reg_home IS NULL THEN 'regulation' END) AS missing FROM matches")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = quality.missing_fields({"goals": F.col("home_goals"), "regulation": F.col("reg_home")})
    return matches(spark, sf_dir).select("fixture_id", F.array_join(gaps, ",").alias("missing"))


@query(
    "fixture_rejections",
    f"""WITH {MATCHES_SQL} SELECT CASE WHEN fixture_id <= 0 THEN 'missing_invalid_or_non_positive_fixture_id' WHEN NOT kickoff_at < TIMESTAMP '1999-01-01' THEN 'kickoff_not_before_cutoff' WHEN home_id <= 0 THEN 'missing_invalid_or_non_positive_home_team_id' WHEN away_id <= 0 THEN 'missing_invalid_or_non_positive_away_team_id' WHEN league_id <> 2 THEN 'conflicting_league_id' WHEN season <> 1997 THEN 'conflicting_season' WHEN status_short = 'NS' THEN 'fixture_not_completed'
      WHEN home_goals IS NULL OR away_goals IS NULL THEN 'completed_fixture_missing_goals' END AS reason, count(*) AS n FROM matches GROUP BY ALL""",
)
def fixture_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir)
    reason = policy.reject_reason({c: F.col(c) for c in found.columns}, F.lit(2), F.lit(1997), F.lit("1999-01-01").cast("timestamp"))
    return found.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "normalised_names",
    r"""SELECT p_partkey, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE t END, ' ') AS name, CASE WHEN len(t) = 0 THEN 'unknown' ELSE array_to_string(CASE WHEN len(k) > 0 THEN k ELSE t END, '_') END AS slug
    FROM (SELECT p_partkey, t, list_filter(t, lambda w: w NOT IN ('fc', 'cf', 'afc', 'sc', 'club')) AS k FROM (
      SELECT p_partkey, list_filter(string_split_regex(regexp_replace(replace(replace(lower(coalesce(p_name, '') || CASE p_partkey % 4 WHEN 0 THEN ' FC' WHEN 1 THEN ' & Club' WHEN 2 THEN '_b.c.' ELSE '' END), '_', ' '), '&', ' and '), '[^\p{L}\p{N}\s_]', ' ', 'g'), '\s+'), lambda w: w <> '') AS t FROM part))""",
)
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 4 == 0, " FC").when(F.col("p_partkey") % 4 == 1, " & Club").when(F.col("p_partkey") % 4 == 2, "_b.c.").otherwise("")
    name = F.concat(F.coalesce("p_name", F.lit("")), tail)
    return table(spark, sf_dir, "part").select("p_partkey", text.team_name(name).alias("name"), text.slug(name).alias("slug"))


@query(
    "parsed_labels",
    r"""WITH l AS (SELECT c_custkey, ['over_2_5', 'home_over_1_5', 'away_under_0_5', 'btts_yes', 'home_win', 'Home or draw', 'total points', 'moneyline home', 'cards_over_3_5', 'corner'][(c_custkey % 10 + 1)::INT] AS key FROM customer)
    SELECT c_custkey, key, CASE WHEN regexp_matches(key, '^(home_|away_)?(over|under)_\d+_\d+$') THEN coalesce(nullif(regexp_extract(key, '^(home|away)_', 1), ''), 'total') END AS side,
      CASE WHEN regexp_matches(key, '^(home_|away_)?(over|under)_\d+_\d+$') THEN replace(regexp_extract(key, '(\d+_\d+)$', 1), '_', '.')::DOUBLE END AS line,
      CASE key WHEN 'over_2_5' THEN 'over_under' WHEN 'home_over_1_5' THEN 'over_under' WHEN 'away_under_0_5' THEN 'over_under' WHEN 'btts_yes' THEN 'btts' WHEN 'home_win' THEN 'match_result' WHEN 'Home or draw' THEN 'double_chance'
        WHEN 'total points' THEN 'total_points' WHEN 'moneyline home' THEN 'moneyline' WHEN 'cards_over_3_5' THEN 'cards' ELSE 'match_result' END AS category FROM l""",
)
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["over_2_5", "home_over_1_5", "away_under_0_5", "btts_yes", "home_win", "Home or draw", "total points", "moneyline home", "cards_over_3_5", "corner"]
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("c_custkey") % 10 + 1).cast("int"))
    got = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    parsed = text.goal_market(F.col("key"))
    return got.select("c_custkey", "key", parsed["side"].alias("side"), parsed["line"].alias("line"), text.market_category(F.col("key")).alias("category"))


@query("stable_ids", "SELECT s_suppkey, ('0x' || substr(sha256('supplier:' || s_name), 1, 8))::BIGINT AS id FROM supplier")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.stable_id("supplier", F.col("s_name")).alias("id"))


@query(
    "parsed_times",
    """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) - INTERVAL (CASE event_id % 3 WHEN 1 THEN 2 ELSE 0 END) HOUR END AS at, year(ts)::INT - (month(ts) < 7)::INT AS season FROM events""",
)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a zone are times, naive ones aren't."""
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", clock.parse_utc(written).alias("at"), clock.season_of(F.col("ts")).alias("season"))


@query("json_values", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS total, count(props->>'$.absent') AS absent FROM events GROUP BY event_type")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.try_variant_get(v, "$.k", "int")).alias("total"), F.count(F.try_variant_get(v, "$.absent", "string")).alias("absent")
    )


@query(
    "bookmaker_summary",
    """WITH b AS (SELECT o_custkey % 50 AS event, o_orderkey % 6 AS bookmaker, unnest(['home', 'draw', 'away']) AS outcome, unnest([1.2e0 + (o_orderkey % 30) / 10e0, 2.5e0 + (o_orderkey % 20) / 10e0, CASE WHEN o_orderkey % 13 = 0 THEN 1e0 ELSE 1.5e0 + (o_orderkey % 50) / 10e0 END]) AS price FROM orders)
    SELECT event, outcome, round(avg(1 / price), 6) AS implied, count(DISTINCT bookmaker) AS bookmakers FROM b WHERE price > 1 GROUP BY ALL""",
)
def bookmaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean implied probability per outcome over all bookmakers; prices of 1 or less don't count."""
    k = F.col("o_orderkey")
    prices = F.array(
        F.struct(F.lit("home").alias("outcome"), (1.2 + (k % 30) / 10).alias("price")), F.struct(F.lit("draw").alias("outcome"), (2.5 + (k % 20) / 10).alias("price")),
        F.struct(F.lit("away").alias("outcome"), F.when(k % 13 == 0, 1.0).otherwise(1.5 + (k % 50) / 10).alias("price")),
    )
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("event"), (k % 6).alias("bookmaker"), F.explode(prices).alias("p")).select("event", "bookmaker", "p.*")
    return rows.filter("price > 1").groupBy("event", "outcome").agg(F.round(F.avg(1 / F.col("price")), 6).alias("implied"), F.count_distinct("bookmaker").alias("bookmakers"))
