"""Whole predictions: ratings, blend, walk-forward calibration, odds, gate and contract; scorelines, safest picks, all markets and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.functions import decision, model, policy
from strictbefore.operators import calibration, elo, features, metrics
from strictbefore.plans.catalog import ORACLE_SQL, query
from strictbefore.plans.feature_queries import OUTCOMES
from strictbefore.plans.matches import MATCHES_SQL, matches, played
from strictbefore.plans.model_queries import COHORT, ERF_SQL, GRID_SQL, LOG_SQL, LONG_SQL, RATED_SQL, logged, outcome_samples, rated
from strictbefore.plans.stream_queries import platt_fits, walk_forward_calibration

MARKETS = {
    "match_result": ["home_win", "draw", "away_win"], "double_chance": ["home_or_draw", "away_or_draw", "home_or_away"], "btts": ["btts"], "over_under": ["over_1_5", "over_2_5", "over_3_5", "over_4_5", "over_5_5"],
    "team_goals": ["home_over_0_5", "home_over_1_5", "home_over_2_5", "away_over_0_5", "away_over_1_5", "away_over_2_5"],
}
#: When each label comes true, as SQL over the goals; results and chances go by the 90-minute score.
TRUE_SQL = {
    "home_win": "reg_home > reg_away", "draw": "reg_home = reg_away", "away_win": "reg_home < reg_away", "home_or_draw": "reg_home >= reg_away", "away_or_draw": "reg_home <= reg_away", "home_or_away": "reg_home <> reg_away",
    "btts": "home_goals > 0 AND away_goals > 0", **{f"over_{n}_5": f"home_goals + away_goals > {n}.5" for n in range(1, 6)}, **{f"{s}_over_{n}_5": f"{s}_goals > {n}.5" for s in ("home", "away") for n in range(3)},
}
CELL_SQL = {
    "home_win": "x > y", "draw": "x = y", "away_win": "x < y", "home_or_draw": "x >= y", "away_or_draw": "x <= y", "home_or_away": "x <> y", "btts": "x > 0 AND y > 0",
    **{f"over_{n}_5": f"x + y > {n}.5" for n in range(1, 6)}, **{f"{s}_over_{n}_5": f"{c} > {n}.5" for s, c in (("home", "x"), ("away", "y")) for n in range(3)},
}
LABELS = [label for labels in MARKETS.values() for label in labels]
P_SQL = ", ".join(f"sum(p) FILTER ({CELL_SQL[label]}) AS {label}" for label in LABELS)

ROUNDED_SQL = ", ".join(f"round(sum(p) FILTER ({CELL_SQL[label]}), 9) AS {label}" for label in LABELS)


@query(
    "top_scorelines",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY p DESC, x, y) AS rank FROM grid)
    SELECT fixture_id, rank, x || '-' || y AS score, round(p, 6) AS p FROM r WHERE rank <= 5""",
)
def top_scorelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most probable scores of every match, the lower score first of equal ones."""
    rows = rated(spark, sf_dir).select("fixture_id", model.scorelines(F.col("home_xg"), F.col("away_xg"), 5).alias("s"))
    return rows.select("fixture_id", F.posexplode("s").alias("n", "c")).select("fixture_id", (F.col("n") + 1).cast("long").alias("rank"), F.concat_ws("-", F.col("c.home").cast("string"), F.col("c.away").cast("string")).alias("score"), F.round("c.p", 6).alias("p"))


def best_sql(labels: list[str]) -> tuple[str, str]:
    most = f"greatest({', '.join(labels)}, {labels[0]})"
    return "CASE " + " ".join(f"WHEN {label} = {most} THEN '{label}'" for label in labels) + " END", most


@query(
    "safest_picks",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, m AS (SELECT fixture_id, {ROUNDED_SQL} FROM grid GROUP BY fixture_id)
    SELECT fixture_id, {", ".join(f"{best_sql(labels)[0]} AS {market}, round({best_sql(labels)[1]}, 6) AS {market}_p" for market, labels in MARKETS.items())} FROM m""",
)
def safest_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable label of every market; said for information, no decision."""
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    found = rated(spark, sf_dir).withColumns({f"_{label}": F.round(ps[label], 9) for label in LABELS})  # so that equal teams tie
    best = decision.safest({market: {label: F.col(f"_{label}") for label in labels} for market, labels in MARKETS.items()})
    return found.select("fixture_id", *[c for market, b in best.items() for c in (b["label"].alias(market), F.round(b["probability"], 6).alias(f"{market}_p"))])


@query(
    "market_consistency",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, m0 AS (SELECT fixture_id, {P_SQL} FROM grid GROUP BY fixture_id),
    m AS (SELECT * REPLACE (CASE WHEN fixture_id % 13 = 1 THEN over_2_5 + 0.4e0 ELSE over_2_5 END AS over_2_5, CASE WHEN fixture_id % 13 = 2 THEN away_or_draw - 0.06e0 ELSE away_or_draw END AS away_or_draw,
                 CASE WHEN fixture_id % 13 = 3 THEN -0.1e0 ELSE btts END AS btts, CASE WHEN fixture_id % 13 = 4 THEN home_win / 9 ELSE home_win END AS home_win, CASE WHEN fixture_id % 13 = 5 THEN over_4_5 + 0.5e0 ELSE over_4_5 END AS over_4_5) FROM m0)
    SELECT fixture_id, CASE WHEN {" OR ".join(f"{label} < 0 OR {label} > 1" for label in LABELS)} THEN 'invalid_probability' WHEN abs(home_win + draw + away_win - 1) > 0.2 THEN 'invalid_sum'
      WHEN abs(home_or_draw - home_win - draw) > 0.05 THEN 'inconsistent_home_or_draw' WHEN abs(away_or_draw - away_win - draw) > 0.05 THEN 'inconsistent_away_or_draw' WHEN abs(home_or_away - home_win - away_win) > 0.05 THEN 'inconsistent_home_or_away'
      WHEN over_1_5 < over_2_5 - 1e-6 THEN 'impossible_over_1_5' WHEN over_2_5 < over_3_5 - 1e-6 THEN 'impossible_over_2_5' WHEN over_3_5 < over_4_5 - 1e-6 THEN 'impossible_over_3_5' WHEN over_4_5 < over_5_5 - 1e-6 THEN 'impossible_over_4_5' END AS fault FROM m""",
)
def market_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market of a payload against the others; some payloads are broken by rule."""
    k = F.col("fixture_id") % 13
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    found = rated(spark, sf_dir).withColumns({f"_{label}": ps[label] for label in LABELS})
    own = {label: F.col(f"_{label}") for label in LABELS}
    broken = {"over_2_5": (1, own["over_2_5"] + 0.4), "away_or_draw": (2, own["away_or_draw"] - 0.06), "btts": (3, F.lit(-0.1)), "home_win": (4, own["home_win"] / 9), "over_4_5": (5, own["over_4_5"] + 0.5)}
    own |= {label: F.when(k == n, value).otherwise(own[label]) for label, (n, value) in broken.items()}
    return found.select("fixture_id", decision.market_fault(own).alias("fault"))


PRICED = ["home_win", "draw", "away_win", "over_2_5", "btts", "home_or_draw"]


@query(
    "all_market_odds",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, m AS (SELECT fixture_id, {P_SQL} FROM grid GROUP BY fixture_id),
    l AS (SELECT fixture_id, kickoff_at, odds_at, unnest({PRICED}) AS market, unnest(range({len(PRICED)})) AS n, unnest([{", ".join(PRICED)}]) AS p FROM m JOIN rated USING (fixture_id)),
    o AS (SELECT *, 0.9e0 + ((fixture_id + n * 37) % 400) / 100e0 AS odds FROM l),
    s AS (SELECT *, CASE WHEN odds <= 1 THEN 'INVALID_ODDS' WHEN odds_at >= kickoff_at THEN 'FUTURE' WHEN epoch_us(kickoff_at) - epoch_us(odds_at) > 86400000000 THEN 'STALE' ELSE 'AVAILABLE' END AS status FROM o)
    SELECT fixture_id, market, status, round(CASE WHEN status IN ('AVAILABLE', 'STALE') THEN 1 / odds END, 6) AS implied, round(CASE WHEN status = 'AVAILABLE' THEN p - 1 / odds END, 6) AS edge, round(CASE WHEN status = 'AVAILABLE' THEN p * odds - 1 END, 6) AS ev FROM s""",
)
def all_market_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge and expected value of every market that has a price; prices follow from the key."""
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    entries = F.array(*[F.struct(F.lit(label).alias("market"), ps[label].alias("p"), (F.lit(0.9) + (F.col("fixture_id") + n * 37) % 400 / 100).alias("odds")) for n, label in enumerate(PRICED)])
    rows = rated(spark, sf_dir).select("fixture_id", "kickoff_at", "odds_at", F.explode(entries).alias("e"))
    said = decision.odds_analysis(F.col("e.p"), F.col("e.odds"), F.col("odds_at"), F.col("kickoff_at"))
    got = rows.select("fixture_id", F.col("e.market").alias("market"), said.alias("s"))
    return got.select("fixture_id", "market", "s.status", *[F.round(f"s.{c}", 6).alias(c) for c in ("implied", "edge", "ev")])


@query(
    "market_evaluation",
    f"""WITH {RATED_SQL}, {GRID_SQL.format(rows="rated")}, m AS (SELECT fixture_id, {P_SQL} FROM grid GROUP BY fixture_id),
    l AS (SELECT unnest({LABELS}) AS market, unnest([{", ".join(LABELS)}]) AS p, unnest([{", ".join(f"({TRUE_SQL[label]})::INT" for label in LABELS)}]) AS y FROM m JOIN rated USING (fixture_id))
    SELECT market, count(*) AS graded, count(*) FILTER ((p >= 0.5) = (y = 1)) AS correct, round(count(*) FILTER ((p >= 0.5) = (y = 1)) / count(*), 6) AS accuracy, round(avg(pow(p - y, 2)), 6) AS brier,
      round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1 - 1e-15), 1e-15))), 6) AS log_loss, round(avg(y), 6) AS rate FROM l GROUP BY market""",
)
def market_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of every market picked, settled and scored."""
    from strictbefore.functions import grading

    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    settled = grading.result_markets(F.col("reg_home"), F.col("reg_away")) | grading.goal_markets(F.col("home_goals"), F.col("away_goals"))
    settled |= {o: settled["result"] == o for o in OUTCOMES}
    entries = F.array(*[F.struct(F.lit(label).alias("market"), ps[label].alias("p"), settled[label].alias("y")) for label in LABELS])
    rows = rated(spark, sf_dir).select(F.explode(entries).alias("e")).select("e.*").filter("y is not null")
    y, p = F.col("y"), F.col("p")
    hit = (p >= 0.5) == y
    got = rows.groupBy("market").agg(F.count("*").alias("graded"), F.count(F.when(hit, 1)).alias("correct"), F.round(F.avg(metrics.brier([p, 1 - p], [y, ~y])), 6).alias("brier"), F.round(F.avg(metrics.log_loss([p, 1 - p], [y, ~y])), 6).alias("log_loss"), F.round(F.avg(y.cast("double")), 6).alias("rate"))
    return got.withColumn("accuracy", F.round(F.col("correct") / F.col("graded"), 6))


@query(
    "baseline_scores",
    f"""WITH {MATCHES_SQL}, r AS (SELECT season, league_id, ts, CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS said FROM played),
    f AS (SELECT season, said, coalesce(count(*) FILTER (said = 'home_win') OVER w / nullif(count(*) OVER w, 0), 1/3e0) AS h, coalesce(count(*) FILTER (said = 'draw') OVER w / nullif(count(*) OVER w, 0), 1/3e0) AS d, coalesce(count(*) FILTER (said = 'away_win') OVER w / nullif(count(*) OVER w, 0), 1/3e0) AS a
          FROM r WINDOW w AS (PARTITION BY league_id, season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT season, count(*) AS n, round(avg(pow(h - (said = 'home_win')::INT, 2) + pow(d - (said = 'draw')::INT, 2) + pow(a - (said = 'away_win')::INT, 2)), 6) AS brier,
      round(avg(-ln(greatest(CASE said WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END, 1e-15))), 6) AS log_loss FROM f GROUP BY season""",
)
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What guessing by the frequencies known before each match would have scored."""
    rows = played(matches(spark, sf_dir)).withColumn("said", policy.outcome(F.col("home_goals"), F.col("away_goals")))
    ps, ys = [F.col(f"prior_{o}") for o in OUTCOMES], [F.col("said") == o for o in OUTCOMES]
    got = metrics.prior_frequencies(rows, "said", OUTCOMES, *COHORT)
    return got.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(metrics.brier(ps, ys)), 6).alias("brier"), F.round(F.avg(metrics.log_loss(ps, ys)), 6).alias("log_loss"))


@query(
    "calibration_table",
    f"""WITH {LONG_SQL}, every_bin AS (SELECT outcome, unnest([0e0, 0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0]) AS bin FROM (SELECT DISTINCT outcome FROM bins)), held AS (SELECT outcome, round(bin, 2) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM bins GROUP BY ALL)
    SELECT outcome, bin, coalesce(n, 0) AS n, round(mean_p, 4) AS mean_p, round(rate, 4) AS rate, round(abs(mean_p - rate), 4) AS gap FROM every_bin LEFT JOIN held USING (outcome, bin)""",
)
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight bins of every outcome, empty ones too."""
    return metrics.all_bins(metrics.calibration(outcome_samples(spark, sf_dir), "outcome"), "outcome")


@query(
    "top_pick_calibration",
    f"""WITH {LOG_SQL}, tops AS (SELECT greatest(h, d, a) AS p, (pick = actual)::INT AS y FROM log WHERE actual IS NOT NULL)
    SELECT CASE WHEN p < 0.5 THEN 0e0 WHEN p < 0.55 THEN 0.5e0 WHEN p < 0.6 THEN 0.55e0 WHEN p < 0.65 THEN 0.6e0 WHEN p < 0.7 THEN 0.65e0 WHEN p < 0.75 THEN 0.7e0 WHEN p < 0.8 THEN 0.75e0 ELSE 0.8e0 END AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM tops GROUP BY bin""",
)
def top_pick_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the most probable outcome came true, by its probability."""
    rows = logged(spark, sf_dir).filter("actual is not null").select(F.greatest("p_home", "p_draw", "p_away").alias("p"), (F.col("pick") == F.col("actual")).alias("y"))
    return metrics.calibration(rows).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(
    "diagnostics",
    f"""WITH {LOG_SQL}, k AS (
      SELECT pick, actual, CASE WHEN greatest(h, d, a) < 0.4 THEN 'high_uncertainty' ELSE 'sufficient_data' END AS state, CASE WHEN h * odds - 1 >= 0 AND h - 1 / odds >= 0.02 THEN 'SIGNAL' ELSE 'PASS' END AS gate,
        CASE WHEN gap >= 0.2e0 THEN 'High' WHEN gap <= 0.08e0 THEN 'Toss-up' ELSE 'Moderate' END AS confidence FROM (SELECT *, greatest(h, d, a) - greatest(least(h, d), least(h, a), least(d, a)) AS gap FROM log))
    SELECT state, gate, confidence, actual, count(*) AS n, count(*) FILTER (pick = actual) AS correct FROM k GROUP BY GROUPING SETS ((state), (gate), (confidence), (actual))""",
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hits by uncertainty, by a gate on edge and value, by confidence and by what came true, in one pass."""
    top, h, odds = F.greatest("p_home", "p_draw", "p_away"), F.col("p_home"), F.col("odds")
    rows = logged(spark, sf_dir).select(
        "pick", "actual", F.when(top < decision.MIN_TOP, "high_uncertainty").otherwise("sufficient_data").alias("state"), F.when((h * odds - 1 >= decision.MIN_EV) & (h - 1 / odds >= decision.MIN_EDGE), "SIGNAL").otherwise("PASS").alias("gate"),
        decision.confidence([F.col("p_home"), F.col("p_draw"), F.col("p_away")]).alias("confidence"),
    )
    keys = [F.col(c) for c in ("state", "gate", "confidence", "actual")]
    return rows.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("pick") == F.col("actual"), 1)).alias("correct"))


ELO_SQL = ORACLE_SQL["elo_ratings"]
ELO_STEPS_SQL = ELO_SQL[ELO_SQL.index("o AS (") : ELO_SQL.rindex("    SELECT fixture_id, o.league_id")].rstrip()

#: Fits by descent as a recursion: per group of ``train`` (keys, logit, n, positive) a hundred steps.
FIT_SQL = """size AS (SELECT {keys}, sum(n) AS total FROM train GROUP BY ALL HAVING sum(n) >= 20 AND sum(positive) BETWEEN 1 AND sum(n) - 1),
fit AS (
  SELECT {keys}, 0 AS step, 1e0 AS a, 0e0 AS b FROM size
  UNION ALL
  SELECT {keys}, step + 1, any_value(a) - 0.05e0 * sum((n / (1 + exp(-(a * logit + b))) - positive) * logit) / sum(n), any_value(b) - 0.05e0 * sum(n / (1 + exp(-(a * logit + b))) - positive) / sum(n)
  FROM fit JOIN train USING ({keys}) WHERE step < 100 GROUP BY {keys}, step)"""
LOGIT_SQL = "round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 4)"
THREE_SQL = "unnest(['home_win', 'draw', 'away_win']) AS outcome, unnest([h, d, a]) AS p, unnest([(actual = 'home_win')::INT, (actual = 'draw')::INT, (actual = 'away_win')::INT]) AS y"

query(
    "fitted_logistics",
    f"""WITH RECURSIVE {LOG_SQL}, train AS (SELECT outcome, {LOGIT_SQL} AS logit, count(*) AS n, sum(y) AS positive FROM (SELECT {THREE_SQL} FROM log WHERE actual IS NOT NULL) GROUP BY ALL), {FIT_SQL.format(keys="outcome")}
    SELECT outcome, round(a, 8) AS a, round(b, 8) AS b, total::BIGINT AS samples FROM fit JOIN size USING (outcome) WHERE step = 100""",
)(lambda spark, sf_dir: platt_fits(spark, sf_dir).select("outcome", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), "samples"))

SAMPLES_SQL = """s AS (SELECT fixture_id, league_id, season, {three} FROM {rows} WHERE actual IS NOT NULL), bins AS (SELECT league_id, season, outcome, {logit} AS logit, count(*) AS n, sum(y) AS positive FROM s GROUP BY ALL),
train AS (SELECT league_id, p.season, outcome, logit, sum(n) AS n, sum(positive) AS positive FROM bins JOIN (SELECT DISTINCT league_id, season FROM bins) p USING (league_id) WHERE bins.season < p.season GROUP BY ALL)"""

query(
    "walk_forward_fits",
    f"""WITH RECURSIVE {LOG_SQL}, {SAMPLES_SQL.format(three=THREE_SQL, logit=LOGIT_SQL, rows="log")}, {FIT_SQL.format(keys="league_id, season, outcome")}
    SELECT s.fixture_id, s.league_id, s.season, s.outcome, CASE WHEN a IS NULL THEN 'UNAVAILABLE' ELSE 'APPLIED' END AS status, round(1 / (1 + exp(-(a * ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) + b))), 8) AS calibrated
    FROM s LEFT JOIN (FROM fit WHERE step = 100) f ON f.league_id = s.league_id AND f.season = s.season AND f.outcome = s.outcome""",
)(lambda spark, sf_dir: walk_forward_calibration(spark, sf_dir).select("fixture_id", "league_id", "season", "outcome", "status", F.round("calibrated", 8).alias("calibrated")))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of teams with history, from features to contract; all that is used was known before it."""
    found = played(matches(spark, sf_dir))
    ratings = elo.ratings(found, *COHORT).select("fixture_id", "home_rating", "away_rating")
    meetings = features.head_to_head(found).select("fixture_id", "meetings")
    ps = model.markets(F.col("home_xg"), F.col("away_xg"), bound=True)
    rows = rated(spark, sf_dir).join(ratings, "fixture_id").join(meetings, "fixture_id")
    mixed = model.blend([ps[o] for o in OUTCOMES], list(model.elo_outcomes(F.col("home_rating"), F.col("away_rating"))))
    raw = rows.withColumns(dict(zip(("p_home", "p_draw", "p_away"), mixed, strict=True))).withColumn("actual", policy.outcome(F.col("reg_home"), F.col("reg_away")))
    three = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).alias("p"), (F.col("actual") == o).alias("y")) for o, p in zip(OUTCOMES, ("p_home", "p_draw", "p_away"), strict=True)])
    samples = raw.filter("actual is not null").select("league_id", "season", F.explode(three).alias("r")).select("league_id", "season", "r.*")
    fits = calibration.fits_by_period(calibration.grouped(samples, "league_id", "season"), "season", "league_id")
    wide = fits.groupBy("league_id", "season").agg(*[F.max(F.when(F.col("outcome") == o, F.col(c))).alias(f"{c}_{o}") for o in OUTCOMES for c in ("a", "b")])
    got = raw.join(wide, ["league_id", "season"], "left")  # a row per league and season
    calibrated, status = calibration.multiclass([F.col("p_home"), F.col("p_draw"), F.col("p_away")], [(F.col(f"a_{o}"), F.col(f"b_{o}")) for o in OUTCOMES])
    got = got.withColumns({"c_home": calibrated[0], "c_draw": calibrated[1], "c_away": calibrated[2], "calibration": status, "coverage": F.when(F.col("meetings") > 0, 1.0).otherwise(0.85), "n": F.least("home_prior_matches", "away_prior_matches")})
    final = [F.col("c_home"), F.col("c_draw"), F.col("c_away")]
    # edge and value need a calibrated probability
    got = got.withColumn("o", decision.odds_analysis(F.when(F.col("calibration") == "APPLIED", F.col("c_home")), F.col("odds"), F.col("odds_at"), F.col("kickoff_at")))
    got = got.withColumn("state", decision.uncertainty(F.col("coverage"), F.col("n"), F.greatest(*final)))
    reasons = decision.gate_reasons(F.col("state"), F.col("coverage"), F.col("n"), decision.valid_probability(F.col("c_home")), F.col("o.status"), F.col("calibration"), F.col("o.edge"), F.col("o.ev"))
    got = got.withColumn("reasons", reasons)
    return got.select(decision.contract(F.col("fixture_id"), [F.col("p_home"), F.col("p_draw"), F.col("p_away")], final, F.col("calibration"), F.col("o"), F.col("state"), F.col("reasons"), F.col("kickoff_at")).alias("c"))


PREDICTED_SQL = f"""{RATED_SQL}, {ELO_STEPS_SQL},
  elo AS (SELECT fixture_id, coalesce(state[home_id::BIGINT], 1500e0) AS hr, coalesce(state[away_id::BIGINT], 1500e0) AS ar FROM o JOIN r ON r.league_id = o.league_id AND r.season = o.season AND r.rn = o.seen),
  {GRID_SQL.format(rows="rated")},
  q AS (SELECT fixture_id, sum(p) FILTER (x > y) AS h, sum(p) FILTER (x = y) AS d, sum(p) FILTER (x < y) AS a FROM grid GROUP BY fixture_id),
  e AS (SELECT fixture_id, least(greatest(0.28e0 * greatest(0e0, 1 - abs(hr + 60 - ar) / 400), 0.05e0), 0.28e0) AS ed, 1 / (1 + pow(10e0, (ar - (hr + 60)) / 400)) AS w FROM elo),
  bl AS (SELECT fixture_id, 0.85e0 * h + 0.15e0 * (1 - ed) * w AS h, 0.85e0 * d + 0.15e0 * ed AS d, 0.85e0 * a + 0.15e0 * (1 - ed - (1 - ed) * w) AS a FROM q JOIN e USING (fixture_id)),
  b AS (SELECT fixture_id, h / (h + d + a) AS h, d / (h + d + a) AS d, a / (h + d + a) AS a FROM bl),
  log AS (SELECT rated.*, h, d, a, CASE WHEN reg_home > reg_away THEN 'home_win' WHEN reg_home < reg_away THEN 'away_win' ELSE 'draw' END AS actual FROM b JOIN rated USING (fixture_id)),
  {SAMPLES_SQL.format(three=THREE_SQL, logit=LOGIT_SQL, rows="log")}, {FIT_SQL.format(keys="league_id, season, outcome")},
  wide AS (SELECT league_id, season, {", ".join(f"max({c}) FILTER (outcome = '{o}') AS {c}_{o}" for o in OUTCOMES for c in ("a", "b"))} FROM fit WHERE step = 100 GROUP BY ALL),
  c0 AS (SELECT log.*, a_home_win IS NOT NULL AND a_draw IS NOT NULL AND a_away_win IS NOT NULL AS fine, {", ".join(f"1 / (1 + exp(-(a_{o} * ln(greatest(least({p}, 1 - 1e-6), 1e-6) / (1 - greatest(least({p}, 1 - 1e-6), 1e-6))) + b_{o}))) AS k{p}" for o, p in zip(OUTCOMES, "hda", strict=True))}
         FROM log LEFT JOIN wide USING (league_id, season)),
  m AS (SELECT fixture_id, count(*) OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM played),
  c1 AS (SELECT *, least(hn, an) AS n, CASE WHEN met > 0 THEN 1e0 ELSE 0.85e0 END AS cov, CASE WHEN fine THEN kh / (kh + kd + ka) ELSE h END AS ch, CASE WHEN fine THEN kd / (kh + kd + ka) ELSE d END AS cd, CASE WHEN fine THEN ka / (kh + kd + ka) ELSE a END AS ca,
      CASE WHEN odds_at >= kickoff_at THEN 'FUTURE' WHEN epoch_us(kickoff_at) - epoch_us(odds_at) > 86400000000 THEN 'STALE' ELSE 'AVAILABLE' END AS odds_status FROM c0 JOIN m USING (fixture_id)),
  c2 AS (SELECT *, CASE WHEN odds_status = 'AVAILABLE' AND fine THEN ch - 1 / odds END AS edge, CASE WHEN odds_status = 'AVAILABLE' AND fine THEN ch * odds - 1 END AS ev,
      CASE WHEN n < 5 THEN 'insufficient_data' WHEN n < 8 THEN 'limited_data' WHEN greatest(ch, cd, ca) < 0.4 THEN 'high_uncertainty' ELSE 'sufficient_data' END AS state FROM c1),
  c3 AS (SELECT *, concat_ws(',', CASE WHEN state = 'high_uncertainty' THEN 'high_uncertainty' END, CASE WHEN NOT fine THEN 'calibration_unavailable' END, CASE odds_status WHEN 'FUTURE' THEN 'future_odds' WHEN 'STALE' THEN 'stale_data' END,
      CASE WHEN edge < 0.02 THEN 'insufficient_edge' END, CASE WHEN ev < 0 THEN 'insufficient_ev' END) AS reasons, greatest(ch, cd, ca) - greatest(least(ch, cd), least(ch, ca), least(cd, ca)) AS gap FROM c2)"""


@query(
    "predicted_fixtures",
    f"""WITH RECURSIVE {PREDICTED_SQL} SELECT fixture_id, round(h, 6) AS raw_home, round(ch, 6) AS p_home, round(cd, 6) AS p_draw, round(ca, 6) AS p_away, CASE WHEN fine THEN 'APPLIED' ELSE 'UNAVAILABLE' END AS calibration, odds_status,
      CASE WHEN ch >= cd AND ch >= ca THEN 'home_win' WHEN cd >= ca THEN 'draw' ELSE 'away_win' END AS pick, CASE WHEN gap >= 0.2 THEN 'High' WHEN gap <= 0.08 THEN 'Toss-up' ELSE 'Moderate' END AS confidence,
      state, reasons, CASE WHEN reasons = '' THEN 'SIGNAL' ELSE 'PASS' END AS decision, CASE WHEN reasons = '' THEN 'VALID' ELSE 'BLOCKED' END AS status FROM c3""",
)
def predicted_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name: F.col(f"c.{name}")
    return predicted(spark, sf_dir).select(
        c("fixture_id"), F.round(c("raw.home_win"), 6).alias("raw_home"), *[F.round(c(f"calibrated.{o}"), 6).alias(n) for o, n in zip(OUTCOMES, ("p_home", "p_draw", "p_away"), strict=True)], c("calibration_status").alias("calibration"), c("odds.status").alias("odds_status"),
        c("pick"), c("confidence"), c("uncertainty").alias("state"), F.array_join(c("reasons"), ",").alias("reasons"), c("decision"), c("status"),
    )


GAMES_SQL = f"""WITH {MATCHES_SQL}, s AS (SELECT fixture_id, ts, season, home_id AS t, true AS home, 95 + home_goals * 5 + fixture_id % 9 AS f, 95 + away_goals * 5 + fixture_id % 7 AS a FROM played
    UNION ALL SELECT fixture_id, ts, season, away_id, false, 95 + away_goals * 5 + fixture_id % 7, 95 + home_goals * 5 + fixture_id % 9 FROM played),
  v AS (SELECT fixture_id, season, home, f AS pf, a AS pa, count(*) OVER w AS n, avg(f) OVER w AS f, avg(a) OVER w AS a FROM s WINDOW w AS (PARTITION BY season, t ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT h.fixture_id, h.season, h.pf > h.pa AS won, h.pf + h.pa AS total, h.pf = h.pa AS tied, ((h.f + a.a) / 2 + 3 - (h.a + a.f) / 2) / 12e0 / sqrt(2e0) AS d, ((h.f + a.a) / 2 + 3 + (h.a + a.f) / 2 - 224.5e0) / 15e0 / sqrt(2e0) AS o FROM v h JOIN v a ON a.fixture_id = h.fixture_id AND h.home AND NOT a.home WHERE h.n >= 5 AND a.n >= 5),
  gm AS (SELECT *, 0.5e0 * (1 + {ERF_SQL.format(x="d")}) AS p, 0.5e0 * (1 + {ERF_SQL.format(x="o")}) AS q FROM e WHERE NOT tied)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball games with the winner's and the total's probability before them; points follow from goals by rule. Ties are no games."""
    from strictbefore.plans.matches import team_rows

    found = played(matches(spark, sf_dir)).withColumn("home_goals", 95 + F.col("home_goals") * 5 + F.col("fixture_id") % 9).withColumn("away_goals", 95 + F.col("away_goals") * 5 + F.col("fixture_id") % 7)
    got = features.both_sides(found, features.team_averages(team_rows(found), "season"), ["prior_matches", "avg_for", "avg_against"]).filter("home_prior_matches >= 5 and away_prior_matches >= 5 and home_goals != away_goals")
    home, away = (F.col("home_avg_for") + F.col("away_avg_against")) / 2 + model.HOME_POINTS, (F.col("home_avg_against") + F.col("away_avg_for")) / 2
    return got.select(
        "fixture_id", "season", (F.col("home_goals") > F.col("away_goals")).alias("won"), (F.col("home_goals") + F.col("away_goals")).alias("total"),
        model.normal_cdf((home - away) / model.MARGIN_SD).alias("p"), model.normal_cdf((home + away - model.POINTS_LINE) / model.TOTAL_SD).alias("q"),
    )


@query(
    "game_evaluation",
    f"""{GAMES_SQL}, l AS (SELECT season, unnest(['moneyline', 'total_points']) AS market, unnest([p, q]) AS p, unnest([won::INT, (total > 224.5)::INT]) AS y FROM gm)
    SELECT season, market, count(*) AS graded, count(*) FILTER ((p >= 0.5) = (y = 1)) AS correct, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM l GROUP BY season, market""",
)
def game_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both basketball markets settled and scored by season."""
    entry = lambda name, p, y: F.struct(F.lit(name).alias("market"), F.col(p).alias("p"), y.alias("y"))
    rows = games(spark, sf_dir).select("season", F.explode(F.array(entry("moneyline", "p", F.col("won")), entry("total_points", "q", F.col("total") > model.POINTS_LINE))).alias("e")).select("season", "e.*")
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("season", "market").agg(F.count("*").alias("graded"), F.count(F.when((p >= 0.5) == y, 1)).alias("correct"), F.round(F.avg(metrics.brier([p, 1 - p], [y, ~y])), 6).alias("brier"), F.round(F.avg(metrics.log_loss([p, 1 - p], [y, ~y])), 6).alias("log_loss"))


@query(
    "game_accuracy",
    f"""{GAMES_SQL}, c AS (SELECT CASE WHEN abs(2 * p - 1) >= 0.2 THEN 'High' WHEN abs(2 * p - 1) <= 0.08 THEN 'Toss-up' ELSE 'Moderate' END AS confidence, (p >= 0.5) = won AS hit FROM gm)
    SELECT confidence, count(*) AS graded, count(*) FILTER (hit) AS correct FROM c GROUP BY ROLLUP (confidence)""",
)
def game_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball picks by confidence and over all."""
    rows = games(spark, sf_dir).select(decision.confidence([F.col("p"), 1 - F.col("p")]).alias("confidence"), ((F.col("p") >= 0.5) == F.col("won")).alias("hit"))
    return rows.rollup("confidence").agg(F.count("*").alias("graded"), F.count(F.when(F.col("hit"), 1)).alias("correct"))

