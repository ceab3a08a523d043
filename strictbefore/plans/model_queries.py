"""Model, decision, grading and evaluation queries over the match view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.functions import decision, grading, model
from strictbefore.functions.policy import outcome
from strictbefore.operators import features, metrics
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played, team_rows

COHORT = ("league_id", "season")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match of teams with history: expected goals from both teams' and the league's averages before it."""
    found = played(matches(spark, sf_dir))
    rows = team_rows(found)
    w = features.before(*COHORT, "team_id")
    per = rows.select("fixture_id", "at_home", F.count("*").over(w).alias("prior_matches"), F.avg("gf").over(w).alias("avg_for"), F.avg("ga").over(w).alias("avg_against"))
    # a fixture's two rows become one, by one shuffle for both sides
    side = lambda name, value, at_home: F.max(F.when(F.col("at_home") == at_home, F.col(value))).alias(f"{name}_{value}")
    both = per.groupBy("fixture_id").agg(*[side(name, value, at) for name, at in (("home", True), ("away", False)) for value in ("prior_matches", "avg_for", "avg_against")])
    both = both.filter("home_prior_matches >= 5 and away_prior_matches >= 5")
    got = features.with_league_average(found, *COHORT).join(both, "fixture_id")
    ratio = lambda c: F.col(c) / F.col("league_avg")
    home = model.expected_goals(ratio("home_avg_for"), ratio("away_avg_against"), F.col("league_avg"), True)
    away = model.expected_goals(ratio("away_avg_for"), ratio("home_avg_against"), F.col("league_avg"), False)
    return model.with_grid(got.withColumn("home_xg", home).withColumn("away_xg", away), F.col("home_xg"), F.col("away_xg"))


RATED_SQL = f"""{MATCHES_SQL}, t AS (
  SELECT fixture_id, team_id, count(*) OVER w AS n, avg(gf) OVER w AS f, avg(ga) OVER w AS a
  FROM team_rows WINDOW w AS (PARTITION BY league_id, season, team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lg AS (
  SELECT fixture_id, sum(home_goals + away_goals) OVER w / (2e0 * count(*) OVER w) AS avg
  FROM played WINDOW w AS (PARTITION BY league_id, season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (
  SELECT p.*, h.n AS hn, a.n AS an, (h.f / avg) * (a.a / avg) * avg * 1.12e0 AS home_xg, (a.f / avg) * (h.a / avg) * avg * 0.88e0 AS away_xg
  FROM played p JOIN t h ON h.fixture_id = p.fixture_id AND h.team_id = home_id JOIN t a ON a.fixture_id = p.fixture_id AND a.team_id = away_id
  JOIN lg ON lg.fixture_id = p.fixture_id WHERE h.n >= 5 AND a.n >= 5)"""

#: A grid of 121 cells a match, normalised.
GRID_SQL = """cells AS (
  SELECT fixture_id, x, y, pow(home_xg, x) * exp(-home_xg) / factorial(x::INT) * pow(away_xg, y) * exp(-away_xg) / factorial(y::INT)
    * CASE WHEN x = 0 AND y = 0 THEN 1 + 0.13e0 * home_xg * away_xg WHEN x = 0 AND y = 1 THEN 1 - 0.13e0 * home_xg WHEN x = 1 AND y = 0 THEN 1 - 0.13e0 * away_xg WHEN x = 1 AND y = 1 THEN 1.13e0 ELSE 1e0 END AS p
  FROM {rows}, range(11) AS a(x), range(11) AS b(y)),
grid AS (SELECT fixture_id, x, y, p / sum(p) OVER (PARTITION BY fixture_id) AS p FROM cells)"""

MARKET_SQL = """round(sum(p) FILTER (x > y), 6) AS home_win, round(sum(p) FILTER (x = y), 6) AS draw, round(sum(p) FILTER (x < y), 6) AS away_win,
  round(sum(p) FILTER (x > 0 AND y > 0), 6) AS btts, round(sum(p) FILTER (x >= y), 6) AS home_or_draw, round(sum(p) FILTER (x <= y), 6) AS away_or_draw, round(sum(p) FILTER (x <> y), 6) AS home_or_away,
  round(sum(p) FILTER (x + y > 1), 6) AS over_1_5, round(sum(p) FILTER (x + y > 2), 6) AS over_2_5, round(sum(p) FILTER (x + y > 3), 6) AS over_3_5, round(sum(p) FILTER (x + y > 4), 6) AS over_4_5, round(sum(p) FILTER (x + y > 5), 6) AS over_5_5,
  round(sum(p) FILTER (x > 0), 6) AS home_over_0_5, round(sum(p) FILTER (x > 1), 6) AS home_over_1_5, round(sum(p) FILTER (x > 2), 6) AS home_over_2_5,
  round(sum(p) FILTER (y > 0), 6) AS away_over_0_5, round(sum(p) FILTER (y > 1), 6) AS away_over_1_5, round(sum(p) FILTER (y > 2), 6) AS away_over_2_5"""


@query("match_probabilities", f"WITH {RATED_SQL}, {GRID_SQL.format(rows='rated')} SELECT fixture_id, {MARKET_SQL} FROM grid GROUP BY fixture_id")
def match_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markets of every match from its expected goals."""
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    return rated(spark, sf_dir).select("fixture_id", *[F.round(p, 6).alias(name) for name, p in ps.items()])


@query(
    "live_probabilities",
    f"""WITH {MATCHES_SQL}, rows AS (
      SELECT fixture_id, (0.4e0 + home_goals / 3e0) * (90 - fixture_id % 90) / 90 AS home_xg, (0.3e0 + away_goals / 4e0) * (90 - fixture_id % 90) / 90 AS away_xg FROM played),
    {GRID_SQL.format(rows="rows")}
    SELECT fixture_id, round(sum(p) FILTER (x + 1 > y), 6) AS home_win, round(sum(p) FILTER (x + 1 = y), 6) AS draw, round(sum(p) FILTER (x + 1 < y), 6) AS away_win, round(sum(p) FILTER (x + y + 1 > 2), 6) AS over_2_5
    FROM grid GROUP BY fixture_id""",
)
def live_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets at 1-0 and a minute given by the fixture id: the grid counts goals still to come."""
    from strictbefore.functions.time import remaining_minutes

    left = remaining_minutes((F.col("fixture_id") % 90).cast("int"), F.lit("2H"))
    home, away = (F.lit(0.4) + F.col("home_goals") / 3) * left / 90, (F.lit(0.3) + F.col("away_goals") / 4) * left / 90
    ps = model.markets(home, away, shift_home=1, bound=True)
    return model.with_grid(played(matches(spark, sf_dir)), home, away).select("fixture_id", *[F.round(ps[k], 6).alias(k) for k in ("home_win", "draw", "away_win", "over_2_5")])


@query(
    "cards_market",
    """SELECT s_suppkey, round((SELECT sum(pow(m, k) * exp(-m) / factorial(k::INT)) FROM range(4, 21) AS r(k)), 6) AS over_3_5
       FROM (SELECT s_suppkey, 1.2e0 + (s_suppkey % 7) / 4e0 + 0.9e0 + (s_suppkey % 5) / 3e0 AS m FROM supplier)""",
)
def cards_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, away = F.lit(1.2) + (F.col("s_suppkey") % 7) / 4, F.lit(0.9) + (F.col("s_suppkey") % 5) / 3
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.round(model.cards_over(home, away, 3.5), 6).alias("over_3_5"))


@query(
    "card_averages",
    f"""WITH {MATCHES_SQL}, y AS (
      SELECT fixture_id, ts, home_id AS team_id, true AS at_home, CASE WHEN fixture_id % 5 > 0 THEN (fixture_id + home_id) % 6 END AS yellow FROM played
      UNION ALL SELECT fixture_id, ts, away_id, false, CASE WHEN fixture_id % 7 > 0 THEN (fixture_id * 3 + away_id) % 7 END FROM played),
    m AS (SELECT fixture_id, at_home, avg(yellow) OVER w AS cards FROM y WINDOW w AS (PARTITION BY team_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT fixture_id, max(cards) FILTER (at_home) AS home, max(cards) FILTER (NOT at_home) AS away FROM m GROUP BY fixture_id)
    SELECT fixture_id, round(home, 6) AS home_cards, round(away, 6) AS away_cards, round((SELECT sum(pow(home + away, k) * exp(-home - away) / factorial(k::INT)) FROM range(4, 21) AS r(k)), 6) AS over_3_5 FROM b WHERE home IS NOT NULL AND away IS NOT NULL""",
)
def card_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' yellow cards per earlier match with a figure, and the cards market from them."""
    k = F.col("fixture_id")
    side = lambda team, at_home, yellow: F.struct(F.col(team).alias("team_id"), F.lit(at_home).alias("at_home"), yellow.alias("yellow"))
    sides = F.array(side("home_id", True, F.when(k % 5 > 0, (k + F.col("home_id")) % 6)), side("away_id", False, F.when(k % 7 > 0, (k * 3 + F.col("away_id")) % 7)))
    rows = played(matches(spark, sf_dir)).select("fixture_id", "ts", F.explode(sides).alias("s")).select("fixture_id", "ts", "s.*")
    means = features.cards_per_match(rows)
    both = means.groupBy("fixture_id").agg(F.max(F.when(F.col("at_home"), F.col("avg_cards"))).alias("home"), F.max(F.when(~F.col("at_home"), F.col("avg_cards"))).alias("away")).filter("home is not null and away is not null")
    return both.select("fixture_id", F.round("home", 6).alias("home_cards"), F.round("away", 6).alias("away_cards"), F.round(model.cards_over(F.col("home"), F.col("away"), 3.5), 6).alias("over_3_5"))


#: The series in another form: each term from its logarithm.
ERF_SQL = """(CASE WHEN {x} = 0 THEN 0 WHEN abs({x}) > 6 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * exp(-{x} * {x})
  * list_sum([exp(2 * n * ln(2) + lgamma(n + 1) + (2 * n + 1) * ln(abs({x})) - lgamma(2 * n + 2)) FOR n IN range(0, 121)]) END)"""


@query(
    "margin_probabilities",
    f"""SELECT c_custkey, round(0.5e0 * (1 + {ERF_SQL.format(x="(d / 12e0 / sqrt(2e0))")}), 10) AS home_win, round(0.5e0 * (1 + {ERF_SQL.format(x="((t - 224.5e0) / 15e0 / sqrt(2e0))")}), 10) AS over_line
    FROM (SELECT c_custkey, (c_custkey % 37) / 2e0 - 9 + 3 AS d, 215 + (c_custkey % 23)::DOUBLE AS t FROM customer)""",
)
def margin_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basketball game's winner and total from an expected margin and total, normally distributed."""
    d, t = (F.col("c_custkey") % 37) / 2 - 9 + model.HOME_POINTS, F.lit(215) + (F.col("c_custkey") % 23).cast("double")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.round(model.normal_cdf(d / model.MARGIN_SD), 10).alias("home_win"), F.round(model.normal_cdf((t - model.POINTS_LINE) / model.TOTAL_SD), 10).alias("over_line")
    )


BLEND_SQL = f"""{RATED_SQL}, {GRID_SQL.format(rows="rated")},
  q AS (SELECT fixture_id, sum(p) FILTER (x > y) AS h, sum(p) FILTER (x = y) AS d, sum(p) FILTER (x < y) AS a FROM grid GROUP BY fixture_id),
  e AS (SELECT fixture_id, least(greatest(0.28e0 * greatest(0e0, 1 - abs(hr + 60 - ar) / 400), 0.05e0), 0.28e0) AS ed, 1 / (1 + pow(10e0, (ar - (hr + 60)) / 400)) AS w
        FROM (SELECT fixture_id, 1400e0 + home_id * 2 AS hr, 1400e0 + away_id * 2 AS ar FROM rated)),
  bl AS (SELECT fixture_id, 0.85e0 * h + 0.15e0 * (1 - ed) * w AS h, 0.85e0 * d + 0.15e0 * ed AS d, 0.85e0 * a + 0.15e0 * (1 - ed - (1 - ed) * w) AS a FROM q JOIN e USING (fixture_id)),
  b AS (SELECT fixture_id, h / (h + d + a) AS h, d / (h + d + a) AS d, a / (h + d + a) AS a FROM bl)"""


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match probabilities blended with ratings; a team's rating here follows from its id."""
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    elo = model.elo_outcomes(F.lit(1400.0) + F.col("home_id") * 2, F.lit(1400.0) + F.col("away_id") * 2)
    mixed = model.blend([ps["home_win"], ps["draw"], ps["away_win"]], list(elo))
    return rated(spark, sf_dir).withColumns({"p_home": mixed[0], "p_draw": mixed[1], "p_away": mixed[2]})


PICK_SQL = "CASE WHEN h >= d AND h >= a THEN 'home_win' WHEN d >= a THEN 'draw' ELSE 'away_win' END"


@query(
    "blended_picks",
    f"""WITH {BLEND_SQL} SELECT fixture_id, round(h, 6) AS p_home, round(d, 6) AS p_draw, round(a, 6) AS p_away, round(h + d, 6) AS home_or_draw, {PICK_SQL} AS pick,
      CASE WHEN gap >= 0.2e0 THEN 'High' WHEN gap <= 0.08e0 THEN 'Toss-up' ELSE 'Moderate' END AS confidence
    FROM (SELECT *, greatest(h, d, a) - greatest(least(h, d), least(h, a), least(d, a)) AS gap FROM b)""",
)
def blended_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = {"home_win": F.col("p_home"), "draw": F.col("p_draw"), "away_win": F.col("p_away")}
    return blended(spark, sf_dir).select(
        "fixture_id", *[F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")], F.round(F.col("p_home") + F.col("p_draw"), 6).alias("home_or_draw"),
        decision.pick(ps).alias("pick"), decision.confidence(list(ps.values())).alias("confidence"),
    )


@query(
    "odds_analysis",
    f"""WITH {BLEND_SQL}, s AS (
      SELECT b.fixture_id, h, odds, CASE WHEN odds <= 1 THEN 'INVALID_ODDS' WHEN odds_at >= kickoff_at THEN 'FUTURE' WHEN epoch_us(kickoff_at) - epoch_us(odds_at) > 86400000000 THEN 'STALE' ELSE 'AVAILABLE' END AS status
      FROM b JOIN rated USING (fixture_id))
    SELECT fixture_id, status, round(CASE WHEN status IN ('AVAILABLE', 'STALE') THEN 1 / odds END, 6) AS implied, round(CASE WHEN status = 'AVAILABLE' THEN h - 1 / odds END, 6) AS edge,
      round(CASE WHEN status = 'AVAILABLE' THEN h * odds - 1 END, 6) AS ev FROM s""",
)
def odds_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = decision.odds_analysis(F.col("p_home"), F.col("odds"), F.col("odds_at"), F.col("kickoff_at"))
    got = blended(spark, sf_dir).select("fixture_id", said.alias("s"))
    return got.select("fixture_id", "s.status", *[F.round(f"s.{c}", 6).alias(c) for c in ("implied", "edge", "ev")])


GATE_SQL = f"""{BLEND_SQL}, s AS (
  SELECT b.fixture_id, h, d, a, odds, least(hn, an) AS n, CASE WHEN b.fixture_id % 11 = 0 THEN 0.3e0 WHEN b.fixture_id % 7 = 0 THEN 0.85e0 ELSE 1e0 END AS cov, CASE WHEN b.fixture_id % 5 = 0 THEN 'UNAVAILABLE' ELSE 'APPLIED' END AS cal,
    CASE WHEN odds_at >= kickoff_at THEN 'FUTURE' WHEN epoch_us(kickoff_at) - epoch_us(odds_at) > 86400000000 THEN 'STALE' ELSE 'AVAILABLE' END AS status
  FROM b JOIN rated USING (fixture_id)),
u AS (
  SELECT *, CASE WHEN n < 5 OR cov < 0.2e0 THEN 'insufficient_data' WHEN cov < 0.5e0 OR n < 8 THEN 'limited_data' WHEN greatest(h, d, a) < 0.4e0 THEN 'high_uncertainty' ELSE 'sufficient_data' END AS state,
    CASE WHEN status = 'AVAILABLE' THEN h - 1 / odds END AS edge, CASE WHEN status = 'AVAILABLE' THEN h * odds - 1 END AS ev FROM s),
gate AS (
  SELECT *, concat_ws(',', CASE WHEN n < 5 THEN 'insufficient_history' END, CASE WHEN cov < 0.5e0 THEN 'insufficient_data' END,
    CASE WHEN state IN ('high_uncertainty', 'insufficient_data') AND n >= 5 AND cov >= 0.5e0 THEN 'high_uncertainty' END, CASE WHEN cal <> 'APPLIED' THEN 'calibration_unavailable' END,
    CASE status WHEN 'FUTURE' THEN 'future_odds' WHEN 'STALE' THEN 'stale_data' END, CASE WHEN edge < 0.02e0 THEN 'insufficient_edge' END, CASE WHEN ev < 0 THEN 'insufficient_ev' END) AS reasons FROM u)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended matches with uncertainty state and gate reasons; coverage and calibration follow from the fixture id."""
    got = blended(spark, sf_dir).withColumns({
        "n": F.least("home_prior_matches", "away_prior_matches"),
        "cov": F.when(F.col("fixture_id") % 11 == 0, 0.3).when(F.col("fixture_id") % 7 == 0, 0.85).otherwise(1.0),
        "cal": F.when(F.col("fixture_id") % 5 == 0, "UNAVAILABLE").otherwise("APPLIED"),
        "o": decision.odds_analysis(F.col("p_home"), F.col("odds"), F.col("odds_at"), F.col("kickoff_at")),
    })
    got = got.withColumn("state", decision.uncertainty(F.col("cov"), F.col("n"), F.greatest("p_home", "p_draw", "p_away")))
    reasons = decision.gate_reasons(F.col("state"), F.col("cov"), F.col("n"), decision.valid_probability(F.col("p_home")), F.col("o.status"), F.col("cal"), F.col("o.edge"), F.col("o.ev"))
    return got.withColumn("reasons", reasons)


@query(
    "quality_gate",
    f"""WITH {GATE_SQL} SELECT fixture_id, state, reasons, CASE WHEN reasons = '' THEN 'SIGNAL' ELSE 'PASS' END AS decision,
      CASE WHEN reasons LIKE '%insufficient_history%' OR reasons LIKE '%insufficient_data%' THEN 'INSUFFICIENT_DATA' WHEN reasons <> '' THEN 'BLOCKED' ELSE 'VALID' END AS status FROM gate""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reasons")
    return gated(spark, sf_dir).select("fixture_id", "state", F.array_join(r, ",").alias("reasons"), decision.decision(r).alias("decision"), decision.contract_status(r).alias("status"))


@query(
    "graded_markets",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, CASE WHEN reg_home > reg_away THEN 'home_win' WHEN reg_home < reg_away THEN 'away_win' WHEN reg_home = reg_away THEN 'draw' END AS result,
      reg_home >= reg_away AS home_or_draw, reg_home <= reg_away AS away_or_draw, reg_home <> reg_away AS home_or_away,
      home_goals + away_goals > 1.5 AS over_1_5, home_goals + away_goals > 2.5 AS over_2_5, home_goals + away_goals > 3.5 AS over_3_5, home_goals + away_goals > 4.5 AS over_4_5, home_goals + away_goals > 5.5 AS over_5_5,
      home_goals > 0 AND away_goals > 0 AS btts, home_goals > 0.5 AS home_over_0_5, home_goals > 1.5 AS home_over_1_5, home_goals > 2.5 AS home_over_2_5,
      away_goals > 0.5 AS away_over_0_5, away_goals > 1.5 AS away_over_1_5, away_goals > 2.5 AS away_over_2_5, home_goals || '-' || away_goals AS score FROM played""",
)
def graded_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = grading.result_markets(F.col("reg_home"), F.col("reg_away")) | grading.goal_markets(F.col("home_goals"), F.col("away_goals"))
    return played(matches(spark, sf_dir)).select("fixture_id", *[c.alias(name) for name, c in settled.items()])


LOG_SQL = f"""{BLEND_SQL}, log AS (
  SELECT b.fixture_id, league_id, season, ts, h, d, a, {PICK_SQL} AS pick, odds, CASE WHEN reg_home > reg_away THEN 'home_win' WHEN reg_home < reg_away THEN 'away_win' WHEN reg_home = reg_away THEN 'draw' END AS actual
  FROM b JOIN rated USING (fixture_id))"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = {"home_win": F.col("p_home"), "draw": F.col("p_draw"), "away_win": F.col("p_away")}
    return blended(spark, sf_dir).withColumn("pick", decision.pick(ps)).withColumn("actual", outcome(F.col("reg_home"), F.col("reg_away")))


@query(
    "evaluation_metrics",
    f"""WITH {LOG_SQL}, r AS (
      SELECT season, count(*) AS graded, count(*) FILTER (pick = actual) AS correct,
        avg(pow(h - (actual = 'home_win')::INT, 2) + pow(d - (actual = 'draw')::INT, 2) + pow(a - (actual = 'away_win')::INT, 2)) AS brier,
        avg(-ln(greatest(least(CASE actual WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END, 1 - 1e-15), 1e-15))) AS log_loss FROM log WHERE actual IS NOT NULL GROUP BY season)
    SELECT season, graded, correct, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(correct / graded, 6) AS accuracy,
      round(greatest(correct / graded - 1.96e0 * sqrt(correct / graded * (1 - correct / graded) / graded), 0), 6) AS low, round(least(correct / graded + 1.96e0 * sqrt(correct / graded * (1 - correct / graded) / graded), 1), 6) AS high,
      CASE WHEN graded < 30 THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS sample FROM r""",
)
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = [F.col("p_home"), F.col("p_draw"), F.col("p_away")]
    ys = [F.col("actual") == o for o in ("home_win", "draw", "away_win")]
    got = logged(spark, sf_dir).filter("actual is not null").groupBy("season").agg(
        F.count("*").alias("graded"), F.count(F.when(F.col("pick") == F.col("actual"), 1)).alias("correct"), F.avg(metrics.brier(ps, ys)).alias("brier"), F.avg(metrics.log_loss(ps, ys)).alias("log_loss")
    )
    low, high = metrics.interval(F.col("correct"), F.col("graded"))
    return got.select(
        "season", "graded", "correct", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"), F.round(F.col("correct") / F.col("graded"), 6).alias("accuracy"),
        F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.when(F.col("graded") < metrics.MIN_SAMPLE, "INSUFFICIENT_SAMPLE").otherwise("OK").alias("sample"),
    )


LONG_SQL = f"""{LOG_SQL}, long AS (
  SELECT o AS outcome, p, (actual = o)::INT AS y FROM (SELECT actual, unnest(['home_win', 'draw', 'away_win']) AS o, unnest([h, d, a]) AS p FROM log WHERE actual IS NOT NULL)),
bins AS (
  SELECT outcome, CASE WHEN p < 0.5 THEN 0e0 WHEN p < 0.55 THEN 0.55e0 - 0.05e0 WHEN p < 0.6 THEN 0.55e0 WHEN p < 0.65 THEN 0.6e0 WHEN p < 0.7 THEN 0.65e0 WHEN p < 0.75 THEN 0.7e0 WHEN p < 0.8 THEN 0.75e0 ELSE 0.8e0 END AS bin, p, y FROM long)"""


def outcome_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match and outcome: outcome, p, y."""
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).alias("p"), (F.col("actual") == o).alias("y")) for o, p in (("home_win", "p_home"), ("draw", "p_draw"), ("away_win", "p_away"))])
    return logged(spark, sf_dir).filter("actual is not null").select(F.explode(rows).alias("r")).select("r.*")


@query(
    "calibration_bins",
    f"""WITH {LONG_SQL} SELECT outcome, round(bin, 2) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(avg(p) - avg(y)), 6) AS gap FROM bins GROUP BY outcome, bin""",
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.calibration(outcome_samples(spark, sf_dir), "outcome")
    return got.select("outcome", F.round("bin", 2).alias("bin"), "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "rate", "gap")])


@query(
    "calibration_error",
    f"""WITH {LONG_SQL}, eb AS (SELECT outcome, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM bins GROUP BY outcome, bin)
    SELECT outcome, sum(n)::BIGINT AS n, round(sum(n * gap) / sum(n), 6) AS ece FROM eb GROUP BY outcome""",
)
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.expected_calibration_error(metrics.calibration(outcome_samples(spark, sf_dir), "outcome"), "outcome")
    return got.withColumn("ece", F.round("ece", 6))


@query(
    "stability_diagnostics",
    f"""WITH {LOG_SQL}, k AS (
      SELECT league_id, season, CASE WHEN greatest(h, d, a) < 0.5 THEN '<50%' WHEN greatest(h, d, a) < 0.6 THEN '50-60%' WHEN greatest(h, d, a) < 0.7 THEN '60-70%' ELSE '70%+' END AS bucket, pick, coalesce(pick = actual, false) AS correct FROM log)
    SELECT league_id, season, bucket, pick, count(*) AS n, count(*) FILTER (correct) AS correct FROM k GROUP BY GROUPING SETS ((league_id, season), (bucket), (pick), ())""",
)
def stability_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by league-season, by probability bucket, by pick and over all, in one pass."""
    rows = logged(spark, sf_dir).withColumn("bucket", metrics.bucket_of(F.greatest("p_home", "p_draw", "p_away"))).withColumn("hit", F.coalesce(F.col("pick") == F.col("actual"), F.lit(False)))
    keys = [F.col(c) for c in ("league_id", "season", "bucket", "pick")]
    sets = [[keys[0], keys[1]], [keys[2]], [keys[3]], []]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("correct"))


@query(
    "odds_baseline",
    f"""WITH {LOG_SQL}, o AS (SELECT season, actual, 1 / odds AS ih, 1 / (odds + 0.9e0) AS id, 1 / (odds + 1.7e0) AS ia FROM log WHERE actual IS NOT NULL),
    n AS (SELECT season, actual, ih / (ih + id + ia) AS h, id / (ih + id + ia) AS d, ia / (ih + id + ia) AS a FROM o)
    SELECT season, count(*) AS n, round(avg(pow(h - (actual = 'home_win')::INT, 2) + pow(d - (actual = 'draw')::INT, 2) + pow(a - (actual = 'away_win')::INT, 2)), 6) AS brier FROM n GROUP BY season""",
)
def odds_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookmaker's probabilities without their margin, as a forecast to compare with."""
    implied = [1 / F.col("odds"), 1 / (F.col("odds") + 0.9), 1 / (F.col("odds") + 1.7)]
    total = implied[0] + implied[1] + implied[2]
    ys = [F.col("actual") == o for o in ("home_win", "draw", "away_win")]
    rows = logged(spark, sf_dir).filter("actual is not null")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(metrics.brier([p / total for p in implied], ys)), 6).alias("brier"))


@query(
    "empirical_baseline",
    f"""WITH {LOG_SQL}, f AS (SELECT season, actual, count(*) AS n, sum(count(*)) OVER (PARTITION BY season)::BIGINT AS total FROM log WHERE actual IS NOT NULL GROUP BY season, actual)
    SELECT season, actual AS outcome, n, round(n / total, 6) AS share FROM f""",
)
def empirical_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    got = logged(spark, sf_dir).filter("actual is not null").groupBy("season", F.col("actual").alias("outcome")).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("season")), 6))
