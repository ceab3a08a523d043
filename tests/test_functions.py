import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictbefore.functions import decision, grading, model, policy, text
from strictbefore.functions import time as clock
from strictbefore.operators import calibration


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_times(spark):
    texts = ["2026-01-01T12:00:00Z", "2026-01-01T07:00:00-05:00", "2026-01-01T14:00:00+02:00", "2026-01-01", "2026-01-01T12:00:00", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(clock.parse_utc(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] and got[3:] == [None] * 4
    assert one(spark, clock.season_code(F.lit(2024)), clock.season_code(F.lit(1999)))[:] == ("2425", "9900")
    labels = ["2024", "2024/25", "2024-2025", "2024/27", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, t string").orderBy("i").select(clock.season_start(F.col("t"))).collect()
    assert [r[0] for r in rows] == [2024, 2024, 2024, None, None]


def test_regulation_goals(spark):
    lit = F.lit
    row = one(spark, policy.regulation(lit("AET"), lit(3), lit(2), lit(2), lit(2)), policy.regulation(lit("AET"), lit(3), lit(2), lit(None).cast("int"), lit(None).cast("int")), policy.regulation(lit("FT"), lit(3), lit(2), lit(None).cast("int"), lit(None).cast("int")))
    assert tuple(row["c0"]) == (2, 2) and row["c1"] is None and tuple(row["c2"]) == (3, 2)
    assert one(spark, policy.strict_int(lit(" +3 ")), policy.strict_int(lit("1.0")), policy.strict_int(lit("true")))[:] == (3, None, None)


def test_odds(spark):
    at = lambda h: F.lit("2026-01-02 00:00:00").cast("timestamp") - F.expr(f"interval {h} hours")
    cutoff = at(0)
    good, odd = decision.odds_analysis(F.lit(0.5), F.lit(2.1), at(3), cutoff), [decision.odds_analysis(F.lit(0.5), F.lit(x).cast("double"), at(3), cutoff) for x in (float("nan"), float("inf"), 0.0, -1.5)]
    row = one(spark, good, *odd, decision.odds_analysis(F.lit(0.5), F.lit(2.1), at(30), cutoff), decision.odds_analysis(F.lit(0.5), F.lit(2.1), at(0), cutoff))
    assert row["c0"]["status"] == "AVAILABLE" and row["c0"]["edge"] == pytest.approx(0.5 - 1 / 2.1) and row["c0"]["ev"] == pytest.approx(0.05)
    assert all(row[f"c{i}"]["status"] == "INVALID_ODDS" and row[f"c{i}"]["odds"] is None for i in range(1, 5))
    assert row["c5"]["status"] == "STALE" and row["c5"]["implied"] is not None and row["c5"]["edge"] is None and row["c6"]["status"] == "FUTURE"


def test_models(spark):
    ps = model.markets(F.lit(1.4), F.lit(1.1))
    row = one(spark, ps["home_win"], ps["draw"], ps["over_2_5"], ps["btts"], model.normal_cdf(F.lit(0.7)), model.cards_over(F.lit(2.0), F.lit(1.5), 3.5))
    assert row[:4] == pytest.approx((0.4216091376, 0.2992117802, 0.4561867161, 0.5190503197), abs=1e-9)
    assert row["c4"] == pytest.approx(0.5 * (1 + math.erf(0.7 / math.sqrt(2))), abs=2e-7)
    assert row["c5"] == pytest.approx(sum(3.5**k * math.exp(-3.5) / math.factorial(k) for k in range(4, 21)))


def test_statistics_are_graded(spark):
    stats = spark.createDataFrame([([(1, "Corner Kicks", 6.0), (2, "corner kicks", 4.0), (1, "Yellow Cards", 2.0), (2, "Yellow Cards", 2.0), (1, "Red Cards", 0.0), (2, "Red Cards", 0.0)],)], "s array<struct<team_id:long,type:string,value:double>>")
    got = stats.select(*[c.alias(n) for n, c in grading.statistical_markets(F.col("s"), F.lit(1), F.lit(2)).items()]).first()
    assert got["corners_over_9_5"] is True and got["cards_over_3_5"] is True and got["corners_over_10_5"] is False


def test_names(spark):
    names = ["Man Utd FC", "Brøndby & Æ", "  FC ", "", None, "Café_del Mar"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.team_name(F.col("n"))).collect()]
    assert got[0] == "man utd" and got[2] == "fc" and got[3] == got[4] == "" and got[5] == "cafe del mar"
    pairs = spark.createDataFrame([("Athletic Bilbao", "Athletic Club"), ("Barcelona", "Barça"), ("Diddeleng", "Dudelange"), ("A", "A"), ("Inter", "Lazio"), ("", "x")], "a string, b string")
    scores = [r[0] for r in pairs.select(text.name_score(F.col("a"), F.col("b"))).collect()]
    assert scores[0] == 0.85 and scores[1] == 0.85 and scores[3] == 1.0 and scores[4] < 0.8 and scores[5] == 0.0
    assert one(spark, text.same_odds_name(F.lit("Arsenal"), F.lit("arsenal F.C.")), text.same_odds_name(F.lit("Arsenal"), F.lit("Arsenal FC")), text.same_odds_name(F.lit(""), F.lit(" fc")))[:] == (False, True, False)


def test_calibration_fits():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 400)
    y = (rng.uniform(size=400) < p).astype(int)
    logit = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(100):
        e = 1 / (1 + np.exp(-(a * logit + b))) - y
        a, b = a - 0.05 * (e * logit).mean(), b - 0.05 * e.mean()
    assert calibration.fit_platt(logit, np.ones(400), y) == pytest.approx((a, b))
    assert calibration.fit_platt(logit[:10], np.ones(10), y[:10]) is None and calibration.fit_platt(logit, np.ones(400), np.zeros(400)) is None
    order = np.argsort(p)
    xs, ys = calibration.fit_isotonic(p[order], y[order].astype(float), np.ones(400))
    assert ys == sorted(ys) and xs == sorted(xs) and calibration.fit_isotonic(p[:5], y[:5], np.ones(5)) is None
    assert calibration.fit_isotonic(np.array([0.1, 0.2, 0.3]), np.array([1.0, 0.0, 1.0]), np.array([10, 10, 10]))[1] == [0.5, 1.0]


def test_isotonic_values(spark):
    xs, ys = F.array(F.lit(0.2), F.lit(0.4)), F.array(F.lit(0.1), F.lit(0.5))
    row = one(spark, *[calibration.isotonic_value(F.lit(p), xs, ys) for p in (0.1, 0.2, 0.3, 0.4, 0.9)])
    assert row[:] == pytest.approx((0.1, 0.1, 0.3, 0.5, 0.5))


def test_side_kinds_and_rejections(spark):
    assert one(spark, text.side_kind(F.lit("Ajax U19 Women")), text.side_kind(F.lit("Ajax")), text.side_kind(F.lit("Inter U17")))[:] == ("u19,women", "", "u17")
    row = {"fixture_id": F.lit(1), "kickoff_at": F.lit("2024-01-01").cast("timestamp"), "home_id": F.lit(1), "away_id": F.lit(2), "home_team": F.lit("A"), "away_team": F.lit(" "), "league_id": F.lit(3), "season": F.lit(2024), "status_short": F.lit("FT"), "home_goals": F.lit(1), "away_goals": F.lit(None).cast("int")}
    why = lambda **more: policy.reject_reason(row | more, F.lit(3), F.lit(2024), F.lit("2025-01-01").cast("timestamp"))
    got = one(spark, why(), why(away_team=F.lit("B")), why(away_team=F.lit("B"), away_goals=F.lit(0)), why(home_id=F.lit(2)), why(away_team=F.lit("B"), status_short=F.lit("NS")), why(away_team=F.lit("B"), away_goals=F.lit(-1)))
    assert got[:] == ("missing_or_empty_away_team_name", "completed_fixture_missing_goals", None, "identical_home_and_away_team_ids", "fixture_not_completed", "invalid_or_negative_away_goals")
    assert one(spark, policy.is_live(F.lit("SUSP")), policy.is_called_off(F.lit("AWD"), "basketball"), policy.is_finished(F.lit("AOT"), "basketball"))[:] == (True, False, True)
