"""Whole predictions, validation, settlements and audits that compose the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.functions import decision, model, text
from strictbefore.operators import documents, features
from strictbefore.plans.catalog import query
from strictbefore.plans.feature_queries import LAST_SQL
from strictbefore.plans.matches import MATCHES_SQL, matches, played, table, team_rows
from strictbefore.plans.model_queries import BLEND_SQL, GRID_SQL, PICK_SQL, RATED_SQL, blended, rated

COHORT = ("league_id", "season")


@query(
    "historical_prediction",
    f"""WITH {RATED_SQL.replace("AS home_xg", "AS home_xg0").replace("AS away_xg", "AS away_xg0").replace("SELECT p.*, h.n", "SELECT p.*, avg AS lg, h.f AS hf, h.a AS ha, a.f AS af, a.a AS aa, h.n")},
    rk AS (SELECT *, row_number() OVER (PARTITION BY league_id, season, team_id ORDER BY ts, fixture_id) AS rn, count(*) OVER (PARTITION BY league_id, season, team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM team_rows),
    fm AS (SELECT x.fixture_id, x.team_id, avg(y.gf) AS f, avg(y.ga) AS a FROM rk x JOIN rk y ON x.league_id = y.league_id AND x.season = y.season AND x.team_id = y.team_id AND y.rn BETWEEN x.k - 7 AND x.k GROUP BY ALL),
    pairs AS (SELECT *, least(home_id, away_id) AS low, greatest(home_id, away_id) AS high FROM played), {LAST_SQL.format(keys="low, high", rows="pairs")},
    hh AS (SELECT a.fixture_id, avg(CASE WHEN a.home_id = b.home_id THEN b.home_goals ELSE b.away_goals END) AS f, avg(CASE WHEN a.home_id = b.home_id THEN b.away_goals ELSE b.home_goals END) AS a
           FROM ranked a JOIN ranked b ON a.low = b.low AND a.high = b.high AND b.rn BETWEEN a.k - 5 AND a.k GROUP BY a.fixture_id),
    ra AS (SELECT r.fixture_id, lg, 0.4e0 * (hf / lg) + 0.45e0 * (h.f / lg) + 0.15e0 * coalesce(hh.f / lg, 1) AS h_att, 0.4e0 * (ha / lg) + 0.45e0 * (h.a / lg) + 0.15e0 * coalesce(hh.a / lg, 1) AS h_def,
             0.4e0 * (af / lg) + 0.45e0 * (w.f / lg) + 0.15e0 * coalesce(hh.a / lg, 1) AS a_att, 0.4e0 * (aa / lg) + 0.45e0 * (w.a / lg) + 0.15e0 * coalesce(hh.f / lg, 1) AS a_def, hh.f IS NOT NULL AS met
           FROM rated r JOIN fm h ON h.fixture_id = r.fixture_id AND h.team_id = home_id JOIN fm w ON w.fixture_id = r.fixture_id AND w.team_id = away_id LEFT JOIN hh ON hh.fixture_id = r.fixture_id),
    xg AS (SELECT fixture_id, met, h_att * a_def * lg * 1.12e0 AS home_xg, a_att * h_def * lg * 0.88e0 AS away_xg FROM ra), {GRID_SQL.format(rows="xg")}
    SELECT xg.fixture_id, CASE WHEN met THEN 1e0 ELSE 0.85e0 END AS coverage, round(home_xg, 6) AS home_xg, round(away_xg, 6) AS away_xg, round(sum(p) FILTER (x > y), 6) AS home_win, round(sum(p) FILTER (x = y), 6) AS draw, round(sum(p) FILTER (x < y), 6) AS away_win
    FROM xg JOIN grid ON grid.fixture_id = xg.fixture_id GROUP BY xg.fixture_id, met, home_xg, away_xg""",
)
def historical_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, form and meetings blended to attack and defence, then to expected goals and an outcome."""
    found = matches(spark, sf_dir)
    base = rated(spark, sf_dir)
    form = features.recent_form(team_rows(found), *COHORT).filter("matches > 0").withColumn("form_for", F.col("goals_for") / F.col("matches")).withColumn("form_against", F.col("goals_against") / F.col("matches"))
    got = features.both_sides(base, form, ["form_for", "form_against"])
    met = features.head_to_head(played(found)).select("fixture_id", F.col("avg_for").alias("met_for"), F.col("avg_against").alias("met_against"))
    got = got.join(met, "fixture_id")
    ratio = lambda c: F.col(c) / F.col("league_avg")
    home_attack = model.blended_ratio(ratio("home_avg_for"), ratio("home_form_for"), ratio("met_for"))
    home_defence = model.blended_ratio(ratio("home_avg_against"), ratio("home_form_against"), ratio("met_against"))
    away_attack = model.blended_ratio(ratio("away_avg_for"), ratio("away_form_for"), ratio("met_against"))
    away_defence = model.blended_ratio(ratio("away_avg_against"), ratio("away_form_against"), ratio("met_for"))
    got = got.withColumn("hx", model.expected_goals(home_attack, away_defence, F.col("league_avg"), True)).withColumn("ax", model.expected_goals(away_attack, home_defence, F.col("league_avg"), False))
    got = model.with_grid(got, F.col("hx"), F.col("ax"))
    ps = model.markets(F.col("hx"), F.col("ax"), bound=True)
    return got.select("fixture_id", F.when(F.col("met_for").isNotNull(), 1.0).otherwise(0.85).alias("coverage"), F.round("hx", 6).alias("home_xg"), F.round("ax", 6).alias("away_xg"), *[F.round(ps[k], 6).alias(k) for k in ("home_win", "draw", "away_win")])


@query(
    "market_validation",
    f"""WITH {BLEND_SQL}, v AS (
      SELECT fixture_id, CASE WHEN fixture_id % 17 = 0 THEN h * 1.5e0 WHEN fixture_id % 19 = 0 THEN -h ELSE h * 1.05e0 END AS h, d, a, CASE WHEN fixture_id % 23 = 0 THEN h + d + 0.1e0 ELSE h + d END AS hd FROM b)
    SELECT fixture_id, CASE WHEN h < 0 OR h > 1 THEN 'invalid_probability' WHEN abs(h + d + a - 1) > 0.2e0 THEN 'invalid_sum' WHEN abs(hd - (h + d)) > 0.05e0 THEN 'inconsistent_double_chance' ELSE 'valid' END AS verdict,
      round(CASE WHEN h BETWEEN 0 AND 1 AND abs(h + d + a - 1) <= 0.2e0 THEN h / (h + d + a) END, 6) AS home_win FROM v""",
)
def market_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions that are bent on purpose, by fixture id: which are refused, and what the others are scaled to."""
    k = F.col("fixture_id")
    got = blended(spark, sf_dir).withColumn("h", F.when(k % 17 == 0, F.col("p_home") * 1.5).when(k % 19 == 0, -F.col("p_home")).otherwise(F.col("p_home") * 1.05))
    hd = F.when(k % 23 == 0, F.col("p_home") + F.col("p_draw") + 0.1).otherwise(F.col("p_home") + F.col("p_draw"))
    ps = [F.col("h"), F.col("p_draw"), F.col("p_away")]
    total = ps[0] + ps[1] + ps[2]
    bad = ~decision.valid_probability(ps[0]) | ~decision.valid_probability(ps[1]) | ~decision.valid_probability(ps[2])
    verdict = F.when(bad, "invalid_probability").when(F.abs(total - 1) > decision.SUM_TOLERANCE, "invalid_sum").when(F.abs(hd - (ps[0] + ps[1])) > 0.05, "inconsistent_double_chance").otherwise("valid")
    return got.select("fixture_id", verdict.alias("verdict"), F.round(decision.normalised(ps)[0], 6).alias("home_win"))


@query(
    "accuracy_by_confidence",
    f"""WITH {BLEND_SQL}, c AS (
      SELECT CASE WHEN gap >= 0.2e0 THEN 'High' WHEN gap <= 0.08e0 THEN 'Toss-up' ELSE 'Moderate' END AS confidence, {PICK_SQL} = CASE WHEN reg_home > reg_away THEN 'home_win' WHEN reg_home < reg_away THEN 'away_win' ELSE 'draw' END AS hit
      FROM (SELECT b.*, reg_home, reg_away, greatest(h, d, a) - greatest(least(h, d), least(h, a), least(d, a)) AS gap FROM b JOIN rated USING (fixture_id)))
    SELECT confidence, count(*) AS graded, count(*) FILTER (hit) AS correct, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM c GROUP BY ROLLUP (confidence)""",
)
def accuracy_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per confidence label and over all."""
    from strictbefore.functions.policy import outcome

    ps = {"home_win": F.col("p_home"), "draw": F.col("p_draw"), "away_win": F.col("p_away")}
    rows = blended(spark, sf_dir).select(decision.confidence(list(ps.values())).alias("confidence"), (decision.pick(ps) == outcome(F.col("reg_home"), F.col("reg_away"))).alias("hit"))
    got = rows.rollup("confidence").agg(F.count("*").alias("graded"), F.count(F.when(F.col("hit"), 1)).alias("correct"))
    return got.withColumn("accuracy", F.round(F.col("correct") / F.col("graded"), 6))


@query(
    "market_summary",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, m AS (SELECT fixture_id, sum(p) FILTER (x + y > 1) AS p15, sum(p) FILTER (x + y > 2) AS p25, sum(p) FILTER (x + y > 3) AS p35 FROM grid GROUP BY fixture_id),
    l AS (SELECT unnest([1.5e0, 2.5e0, 3.5e0]) AS line, unnest([p15, p25, p35]) AS p, home_goals + away_goals AS total FROM m JOIN rated USING (fixture_id))
    SELECT line, count(*) AS graded, count(*) FILTER ((p >= 0.5) = (total > line)) AS correct, round(count(*) FILTER ((p >= 0.5) = (total > line)) / count(*), 6) AS accuracy FROM l GROUP BY line""",
)
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the likelier side of each total was right."""
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    lines = F.array(*[F.struct(F.lit(line).alias("line"), ps[f"over_{line}".replace(".", "_")].alias("p")) for line in (1.5, 2.5, 3.5)])
    rows = rated(spark, sf_dir).select((F.col("home_goals") + F.col("away_goals")).alias("total"), F.explode(lines).alias("l"))
    hit = (F.col("l.p") >= 0.5) == (F.col("total") > F.col("l.line"))
    got = rows.groupBy(F.col("l.line").alias("line")).agg(F.count("*").alias("graded"), F.count(F.when(hit, 1)).alias("correct"))
    return got.withColumn("accuracy", F.round(F.col("correct") / F.col("graded"), 6))


@query(
    "league_standings",
    f"""WITH {MATCHES_SQL}, t AS (SELECT league_id, season, team_id, count(*) AS played, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn, sum(gf)::BIGINT AS goals_for, sum(ga)::BIGINT AS goals_against FROM team_rows GROUP BY ALL)
    SELECT *, 3 * won + drawn AS points, rank() OVER (PARTITION BY league_id, season ORDER BY 3 * won + drawn DESC, goals_for - goals_against DESC, goals_for DESC)::INT AS place,
      round(sum(goals_for) OVER (PARTITION BY league_id, season) / sum(played) OVER (PARTITION BY league_id, season), 6) AS league_avg FROM t""",
)
def league_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by season, and the league's goals per team and match from them."""
    per = team_rows(matches(spark, sf_dir)).groupBy(*COHORT, "team_id").agg(
        F.count("*").alias("played"), F.count(F.when(F.col("gf") > F.col("ga"), 1)).alias("won"), F.count(F.when(F.col("gf") == F.col("ga"), 1)).alias("drawn"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against")
    )
    per = per.withColumn("points", 3 * F.col("won") + F.col("drawn"))
    season = Window.partitionBy(*COHORT)
    place = F.rank().over(season.orderBy(F.desc("points"), F.desc(F.col("goals_for") - F.col("goals_against")), F.desc("goals_for")))
    return per.withColumn("place", place).withColumn("league_avg", F.round(F.sum("goals_for").over(season) / F.sum("played").over(season), 6))


@query(
    "basketball_prediction",
    f"""WITH {MATCHES_SQL}, s AS (SELECT fixture_id, ts, season, home_id AS t, true AS home, 95 + home_goals * 5 + fixture_id % 9 AS f, 95 + away_goals * 5 + fixture_id % 7 AS a FROM played
        UNION ALL SELECT fixture_id, ts, season, away_id, false, 95 + away_goals * 5 + fixture_id % 7, 95 + home_goals * 5 + fixture_id % 9 FROM played),
    v AS (SELECT fixture_id, home, count(*) OVER w AS n, avg(f) OVER w AS f, avg(a) OVER w AS a FROM s WINDOW w AS (PARTITION BY season, t ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT h.fixture_id, (h.f + a.a) / 2 + 3 AS eh, (h.a + a.f) / 2 AS ea FROM v h JOIN v a ON a.fixture_id = h.fixture_id AND h.home AND NOT a.home WHERE h.n >= 5 AND a.n >= 5)
    SELECT fixture_id, round(eh, 6) AS expected_home, round(ea, 6) AS expected_away, CASE WHEN eh >= ea THEN 'home_win' ELSE 'away_win' END AS pick, eh + ea > 224.5 AS over_line FROM e""",
)
def basketball_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected points from both teams' averages before a game; points follow from goals by rule."""
    found = played(matches(spark, sf_dir)).withColumn("home_goals", 95 + F.col("home_goals") * 5 + F.col("fixture_id") % 9).withColumn("away_goals", 95 + F.col("away_goals") * 5 + F.col("fixture_id") % 7)
    per = features.team_averages(team_rows(found), "season")
    got = features.both_sides(found, per, ["prior_matches", "avg_for", "avg_against"]).filter("home_prior_matches >= 5 and away_prior_matches >= 5")
    home = (F.col("home_avg_for") + F.col("away_avg_against")) / 2 + model.HOME_POINTS
    away = (F.col("home_avg_against") + F.col("away_avg_for")) / 2
    win, over = model.normal_cdf((home - away) / model.MARGIN_SD), model.normal_cdf((home + away - model.POINTS_LINE) / model.TOTAL_SD)
    return got.select("fixture_id", F.round(home, 6).alias("expected_home"), F.round(away, 6).alias("expected_away"), F.when(win >= 0.5, "home_win").otherwise("away_win").alias("pick"), (over > 0.5).alias("over_line"))


@query(
    "alias_suffix_matches",
    """WITH a AS (SELECT s_suppkey, 'club ' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ' FC' WHEN 1 THEN ' A.F.C' WHEN 2 THEN ' cf' ELSE '' END AS n FROM supplier), b AS (SELECT c_custkey, 'Club-' || c_custkey AS n FROM customer)
    SELECT s_suppkey, c_custkey FROM a JOIN b ON replace(lower(b.n), '-', ' ') = CASE WHEN s_suppkey % 4 = 0 THEN replace(a.n, ' FC', '') WHEN s_suppkey % 4 = 2 THEN replace(a.n, ' cf', '') ELSE lower(replace(a.n, '.', ' ')) END""",
)
def alias_suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that agree up to one club suffix, as an equality: each side offers its name with and without a suffix. Names are made from whole keys, so a name has few rows."""
    tail = F.when(F.col("s_suppkey") % 4 == 0, " FC").when(F.col("s_suppkey") % 4 == 1, " A.F.C").when(F.col("s_suppkey") % 4 == 2, " cf").otherwise("")
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("club "), "s_suppkey", tail).alias("a"))
    b = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Club-"), "c_custkey").alias("b"))
    bare = lambda c: F.regexp_replace(text.odds_name(c), "(" + "|".join(text.SUFFIXES) + ")$", "")
    offers = lambda c: F.array_distinct(F.array(text.odds_name(c), bare(c)))
    left, right = a.withColumn("k", F.explode(offers(F.col("a")))), b.withColumn("k", F.explode(offers(F.col("b"))))
    return left.join(right, "k").filter(text.same_odds_name(F.col("a"), F.col("b"))).select("s_suppkey", "c_custkey").distinct()


@query(
    "alias_suffix_names",
    """WITH a AS (SELECT s_suppkey % 4 AS kind, 'club ' || (s_suppkey % 60) || CASE s_suppkey % 4 WHEN 0 THEN ' FC' WHEN 1 THEN ' A.F.C' WHEN 2 THEN ' cf' ELSE '' END AS n FROM supplier), b AS (SELECT 'Club-' || (c_custkey % 90) AS n FROM customer)
    SELECT a.n AS supplier_name, b.n AS customer_name, any_value(suppliers) AS suppliers, any_value(customers) AS customers FROM (SELECT n, kind, count(*) AS suppliers FROM a GROUP BY ALL) a JOIN (SELECT n, count(*) AS customers FROM b GROUP BY ALL) b
    ON replace(lower(b.n), '-', ' ') = CASE WHEN kind = 0 THEN replace(a.n, ' FC', '') WHEN kind = 2 THEN replace(a.n, ' cf', '') ELSE lower(replace(a.n, '.', ' ')) END GROUP BY ALL""",
)
def alias_suffix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that agree up to one club suffix, as an equality: each side offers its name with and without a suffix. Distinct names are matched and their rows counted, as rows by rows would multiply."""
    tail = F.when(F.col("s_suppkey") % 4 == 0, " FC").when(F.col("s_suppkey") % 4 == 1, " A.F.C").when(F.col("s_suppkey") % 4 == 2, " cf").otherwise("")
    a = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("club "), F.col("s_suppkey") % 60, tail).alias("supplier_name")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("Club-"), F.col("c_custkey") % 90).alias("customer_name")).agg(F.count("*").alias("customers"))
    bare = lambda c: F.regexp_replace(text.odds_name(c), "(" + "|".join(text.SUFFIXES) + ")$", "")
    offers = lambda c: F.array_distinct(F.array(text.odds_name(c), bare(c)))
    left, right = a.withColumn("k", F.explode(offers(F.col("supplier_name")))), b.withColumn("k", F.explode(offers(F.col("customer_name"))))
    pairs = left.join(right, "k").filter(text.same_odds_name(F.col("supplier_name"), F.col("customer_name")))
    return pairs.select("supplier_name", "customer_name", "suppliers", "customers").distinct()


@query(
    "source_cohort",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 9 AND (o_orderkey % 4 = 0 OR (o_orderkey % 4 = 3 AND (o_orderkey % 5 = 1 OR o_orderkey % 3 = 2)))""",
)
def source_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one provider, mixed rows that it took part in, none that are marked as duplicates."""
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "alpha").when(k % 4 == 3, "mixed").otherwise("legacy")
    raw = F.concat(
        F.lit('{"provider_provenance":{"provider":"'), F.when(k % 5 == 1, "alpha").otherwise("beta"), F.lit('","providers":["gamma"'), F.when(k % 3 == 2, F.lit(',"alpha"')).otherwise(""), F.lit("]}"),
        F.when(k % 10 == 9, F.lit(',"reconciliation_metadata":{"legacy_duplicate_candidate":"True"}')).otherwise(""), F.lit("}"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"), raw.alias("raw"))
    return rows.filter(documents.from_sources(F.col("source"), F.col("raw"), ["alpha"]) & documents.not_duplicate(F.col("raw"))).select("o_orderkey")


@query(
    "manifest_reconciliation",
    f"""WITH {MATCHES_SQL}, logical AS (SELECT league_id, season, home_id, away_id, kickoff_at::DATE AS d, count(*) AS n FROM matches GROUP BY ALL), l AS (SELECT league_id, season, sum(n - 1)::BIGINT AS repeats FROM logical GROUP BY ALL),
    t AS (SELECT league_id, season, count(DISTINCT team_id) AS teams FROM (SELECT league_id, season, home_id AS team_id FROM matches UNION ALL SELECT league_id, season, away_id FROM matches) GROUP BY ALL)
    SELECT m.league_id, m.season, count(*) AS stored, count(*) FILTER (status_short = 'NS') AS not_completed, count(*) FILTER (status_short <> 'NS' AND home_goals IS NULL) AS without_goals, any_value(repeats) AS logical_repeats, 20 - any_value(teams) AS missing_teams
    FROM matches m JOIN l ON l.league_id = m.league_id AND l.season = m.season JOIN t ON t.league_id = m.league_id AND t.season = m.season GROUP BY m.league_id, m.season""",
)
def manifest_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each league-season against what a complete one would hold."""
    found = matches(spark, sf_dir)
    counts = found.groupBy(*COHORT).agg(
        F.count("*").alias("stored"), F.count(F.when(F.col("status_short") == "NS", 1)).alias("not_completed"), F.count(F.when((F.col("status_short") != "NS") & F.col("home_goals").isNull(), 1)).alias("without_goals"),
        (F.count("*") - F.count_distinct("home_id", "away_id", F.to_date("kickoff_at"))).alias("logical_repeats"), F.count_distinct("home_id").alias("_"),
    ).drop("_")
    teams = found.select(*COHORT, F.explode(F.array("home_id", "away_id")).alias("team")).groupBy(*COHORT).agg((20 - F.count_distinct("team")).alias("missing_teams"))
    return counts.join(teams, list(COHORT))


@query(
    "month_evidence",
    f"""WITH {MATCHES_SQL}, w AS (SELECT league_id, season, m::DATE AS month FROM (SELECT DISTINCT league_id, season FROM matches), LATERAL (SELECT unnest(generate_series(make_timestamp(season, 1, 1, 0, 0, 0), make_timestamp(season, 12, 1, 0, 0, 0), INTERVAL 1 MONTH)) AS m)),
    h AS (SELECT league_id, season, date_trunc('month', kickoff_at)::DATE AS month, count(*) AS n FROM matches WHERE status_short = 'NS' GROUP BY ALL)
    SELECT w.league_id, w.season, w.month, coalesce(n, 0) AS fixtures, CASE WHEN n IS NULL THEN 'no_evidence' WHEN n < 4 THEN 'partial' ELSE 'covered' END AS verdict FROM w LEFT JOIN h ON h.league_id = w.league_id AND h.season = w.season AND h.month = w.month""",
)
def month_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of every season, with what it has of fixtures yet to be played."""
    from strictbefore.functions.time import season_months

    found = matches(spark, sf_dir)
    months = found.select(*COHORT).distinct().select(*COHORT, F.explode(season_months(F.col("season"), 1, 12)).alias("month"))
    have = found.filter("status_short = 'NS'").groupBy(*COHORT, F.to_date(F.trunc("kickoff_at", "month")).alias("month")).agg(F.count("*").alias("n"))
    verdict = F.when(F.col("n").isNull(), "no_evidence").when(F.col("n") < 4, "partial").otherwise("covered")
    return months.join(have, [*COHORT, "month"], "left").select(*COHORT, "month", F.coalesce("n", F.lit(0)).alias("fixtures"), verdict.alias("verdict"))


@query(
    "season_status",
    f"""WITH {MATCHES_SQL}, s AS (SELECT league_id, season, count(*) FILTER (status_short <> 'NS') AS graded FROM matches GROUP BY ALL)
    SELECT league_id, count(*) AS seasons, sum(graded)::BIGINT AS graded, CASE WHEN min(graded) >= 150 THEN 'COMPLETE' WHEN max(graded) >= 150 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM s GROUP BY league_id""",
)
def season_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status over several seasons: complete if every one is, partial if any."""
    per = matches(spark, sf_dir).groupBy(*COHORT).agg(F.count(F.when(F.col("status_short") != "NS", 1)).alias("n"))
    got = per.groupBy("league_id").agg(F.count("*").alias("seasons"), F.sum("n").alias("graded"), F.min("n").alias("least"), F.max("n").alias("most"))
    return got.select("league_id", "seasons", "graded", F.when(F.col("least") >= 150, "COMPLETE").when(F.col("most") >= 150, "PARTIAL").otherwise("INSUFFICIENT").alias("status"))


@query(
    "recent_matches_of_team",
    f"""WITH {MATCHES_SQL}, u AS (SELECT team_id, fixture_id, ts, 1 AS place FROM team_rows WHERE fixture_id % 3 = 0 UNION ALL SELECT team_id, fixture_id, ts, 2 FROM team_rows WHERE fixture_id % 2 = 0),
    d AS (SELECT *, row_number() OVER (PARTITION BY team_id, fixture_id ORDER BY place) AS k FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY ts DESC, fixture_id DESC) AS n FROM d WHERE k = 1)
    SELECT team_id, fixture_id, place FROM r WHERE n <= 10""",
)
def recent_matches_of_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's last ten matches over two providers, each match from the first provider that has it."""
    rows = team_rows(matches(spark, sf_dir)).select("team_id", "fixture_id", "ts")
    places = F.array_compact(F.array(F.when(F.col("fixture_id") % 3 == 0, 1), F.when(F.col("fixture_id") % 2 == 0, 2)))
    first = rows.withColumn("place", F.array_min(places)).filter("place is not null")
    n = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("ts"), F.desc("fixture_id")))
    return first.withColumn("n", n).filter("n <= 10").select("team_id", "fixture_id", "place")


@query("merged_documents")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties merged with a later delivery of the same document."""
    later = F.concat(F.lit('{"k": '), F.col("event_id") % 100, F.lit(', "extra": {"type": "'), F.col("event_type"), F.lit('"}}'))
    return table(spark, sf_dir, "events").select("event_id", documents.merge_json(F.col("props"), later).alias("m")).select("event_id", "m.*")
