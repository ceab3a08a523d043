"""From a probability to a gated decision: validation, odds, uncertainty, gate and contract, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and the order in which reasons are given.
MIN_SAMPLES, MIN_COVERAGE, LEAST_COVERAGE, FULL_SAMPLES, LIVE_SAMPLES = 5, 0.50, 0.20, 8, 10
MIN_TOP, MIN_EDGE, MIN_EV, MAX_ODDS_HOURS = 0.40, 0.02, 0.0, 24
HIGH_GAP, TOSS_UP_GAP = 0.20, 0.08
SUM_TOLERANCE = 0.2


def valid_probability(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & (p >= 0) & (p <= 1), F.lit(False))


def normalised(ps: list[Column], tolerance: float = SUM_TOLERANCE) -> list[Column]:
    """The distribution scaled to one; nulls if a part is invalid or the sum is off by more than the tolerance."""
    total = sum(ps[1:], ps[0])
    fine = (F.abs(total - 1) <= tolerance) & (total > 0)
    for p in ps:
        fine = fine & valid_probability(p)
    return [F.when(fine, p / total) for p in ps]


def odds_status(odds: Column, odds_at: Column, cutoff: Column) -> Column:
    """Why odds can't be used, or AVAILABLE; the first rule that applies."""
    age = F.unix_micros(cutoff) - F.unix_micros(odds_at)
    return (
        F.when(odds.isNull(), "MISSING").when(F.isnan(odds) | (odds == float("inf")) | (odds <= 1), "INVALID_ODDS")
        .when(odds_at.isNull() | cutoff.isNull(), "MISSING").when(odds_at >= cutoff, "FUTURE")
        .when(age > MAX_ODDS_HOURS * 3_600_000_000, "STALE").otherwise("AVAILABLE")
    )


def odds_analysis(p: Column, odds: Column, odds_at: Column, cutoff: Column) -> Column:
    """struct<odds, implied, edge, ev, status>; edge and EV only from a valid calibrated probability and available odds."""
    status = odds_status(odds, odds_at, cutoff)
    usable = ~F.coalesce(F.isnan(odds) | (odds == float("inf")) | (odds <= 1), F.lit(True))
    value = F.when(usable, odds)
    both = (status == "AVAILABLE") & valid_probability(p)
    return F.struct(
        value.alias("odds"), F.when(status.isin("AVAILABLE", "STALE"), 1 / value).alias("implied"), F.when(both, p - 1 / value).alias("edge"),
        F.when(both, p * value - 1).alias("ev"), status.alias("status"),
    )


def uncertainty(coverage: Column, samples: Column, top: Column, live: Column | None = None) -> Column:
    live = F.lit(False) if live is None else live
    n, bounded = F.coalesce(samples, F.lit(0)), F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0))
    return (
        F.when(coverage.isNull() | (n < MIN_SAMPLES) | (bounded < LEAST_COVERAGE), "insufficient_data").when((bounded < MIN_COVERAGE) | (n < FULL_SAMPLES), "limited_data")
        .when((F.coalesce(top, F.lit(0.0)) < MIN_TOP) | (live & (n < LIVE_SAMPLES)), "high_uncertainty").otherwise("sufficient_data")
    )


def gate_reasons(state: Column, coverage: Column, samples: Column, valid: Column, odds: Column, calibration: Column, edge: Column, ev: Column, error: Column | None = None, require_odds: bool = False) -> Column:
    """All reasons in order, an empty array if none; missing odds count only where odds are required."""
    few, thin = F.coalesce(samples, F.lit(0)) < MIN_SAMPLES, F.coalesce(coverage, F.lit(0.0)) < MIN_COVERAGE
    error = F.lit(False) if error is None else error
    say = lambda cond, reason: F.when(F.coalesce(cond, F.lit(False)), F.lit(reason))
    odds_reason = F.when(odds == "FUTURE", "future_odds").when(odds == "STALE", "stale_data")
    odds_reason = odds_reason.when(odds == "MISSING", "missing_odds") if require_odds else odds_reason
    return F.array_compact(F.array(
        say(error, "model_error"), say(~valid, "invalid_probability"), say(few, "insufficient_history"), say(thin, "insufficient_data"),
        say(state.isin("high_uncertainty", "insufficient_data") & ~few & ~thin, "high_uncertainty"),
        F.when(calibration == "ERROR", "calibration_error").when(F.coalesce(calibration != "APPLIED", F.lit(True)), "calibration_unavailable"),
        odds_reason, say(edge < MIN_EDGE, "insufficient_edge"), say(ev < MIN_EV, "insufficient_ev"),
    ))


def decision(reasons: Column) -> Column:
    """SIGNAL if nothing stands against it; PASS means blocked."""
    return F.when(F.size(reasons) == 0, "SIGNAL").otherwise("PASS")


def contract_status(reasons: Column) -> Column:
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    return (
        F.when(has("model_error", "calibration_error"), "ERROR").when(has("invalid_probability"), "INVALID_PROBABILITY")
        .when(has("insufficient_history", "insufficient_data"), "INSUFFICIENT_DATA").when(F.size(reasons) > 0, "BLOCKED").otherwise("VALID")
    )


def pick(ps: dict[str, Column]) -> Column:
    """The most probable outcome; of equal ones the first named."""
    first, *others = ps.values()
    best = F.greatest(first, *others) if others else first
    return F.coalesce(*[F.when(p == best, F.lit(name)) for name, p in ps.items()])


def confidence(ps: list[Column]) -> Column:
    """High, Moderate or Toss-up by the gap between the two most probable outcomes."""
    ranked = F.sort_array(F.array(*ps), asc=False)
    gap = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    return F.when(gap >= HIGH_GAP, "High").when(gap <= TOSS_UP_GAP, "Toss-up").otherwise("Moderate")


#: Fixed value: how far a double chance may be from the sum of its outcomes, and lines out of order.
CHANCE_TOLERANCE, LINE_TOLERANCE = 0.05, 1e-6


def market_fault(ps: dict[str, Column]) -> Column:
    """What contradicts itself in a payload of market probabilities, the first that does; null if nothing. Missing markets aren't held against it."""
    say = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.lit(what))
    valid = lambda p: p.isNull() | valid_probability(p)
    bad = F.lit(False)
    for p in ps.values():
        bad = bad | ~valid(p)
    result = [ps[k] for k in ("home_win", "draw", "away_win")]
    checks = [say(bad, "invalid_probability"), say(F.abs(result[0] + result[1] + result[2] - 1) > SUM_TOLERANCE, "invalid_sum")]
    pairs = {"home_or_draw": ("home_win", "draw"), "away_or_draw": ("away_win", "draw"), "home_or_away": ("home_win", "away_win")}
    checks += [say(F.abs(ps[k] - (ps[a] + ps[b])) > CHANCE_TOLERANCE, f"inconsistent_{k}") for k, (a, b) in pairs.items() if k in ps]
    lines = [f"over_{n}_5" for n in range(1, 6)]
    checks += [say(ps[low] < ps[high] - LINE_TOLERANCE, f"impossible_{low}") for low, high in zip(lines, lines[1:], strict=False) if low in ps and high in ps]
    checks += [say(F.abs(ps[k] + ps[k.replace("over", "under")] - 1) > SUM_TOLERANCE, f"invalid_pair_{k}") for k in lines if k in ps and k.replace("over", "under") in ps]
    return F.coalesce(*checks)


def safest(ps: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """Per market struct<label, probability> of its most probable label, the first of equal ones; informational only."""
    return {market: F.struct(pick(labels).alias("label"), F.array_max(F.array(*labels.values())).alias("probability")) for market, labels in ps.items()}


def contract(fixture: Column, raw: list[Column], calibrated: list[Column], calibration: Column, odds: Column, state: Column, reasons: Column, cutoff: Column) -> Column:
    """The record of one prediction: what was computed before the cutoff, what was done to it and what stands against it."""
    names = ("home_win", "draw", "away_win")
    both = lambda ps: F.struct(*[p.alias(n) for p, n in zip(ps, names, strict=True)])
    return F.struct(
        fixture.alias("fixture_id"), cutoff.alias("data_cutoff"), both(raw).alias("raw"), both(calibrated).alias("calibrated"), calibration.alias("calibration_status"), pick(dict(zip(names, calibrated, strict=True))).alias("pick"),
        confidence(calibrated).alias("confidence"), odds.alias("odds"), state.alias("uncertainty"), reasons.alias("reasons"), decision(reasons).alias("decision"), contract_status(reasons).alias("status"),
    )
