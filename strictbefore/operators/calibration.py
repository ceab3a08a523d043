"""Walk-forward calibration: logistic (Platt) and isotonic fits on what was known before each cutoff.

Platt's descent needs, per step, two sums over all samples: with the samples' log odds grouped to rounded bins, the steps
run on the bins, whose number doesn't grow with the data; one group per cohort holds its bins only. Isotonic
regression pools sorted places, which are rounded likewise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the fit.
MIN_SAMPLES, STEPS, RATE, EPS = 20, 100, 0.05, 1e-6
#: Log odds are grouped to this many decimals.
DECIMALS = 4


def fit_platt(logit: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[float, float] | None:
    """a, b after full-batch descent on grouped samples: counts and positives per log odds. Null without both classes."""
    total, hits = int(n.sum()), int(positive.sum())
    if total < MIN_SAMPLES or hits in (0, total):
        return None
    a, b = 1.0, 0.0
    for _ in range(STEPS):
        error = n / (1 + np.exp(-(a * logit + b))) - positive
        a, b = a - RATE * float(error @ logit) / total, b - RATE * float(error.sum()) / total
    return a, b


def grouped(samples: DataFrame, *keys: str) -> DataFrame:
    """Samples by rounded log odds: n and positive. From here on the size of a group is bounded by the rounding."""
    safe = F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS))
    return samples.groupBy(*keys, "outcome", F.round(F.ln(safe / (1 - safe)), DECIMALS).alias("logit")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("positive"))


def fit_groups(bins: DataFrame, *cohort: str) -> DataFrame:
    """Per cohort and outcome: a, b and samples; no row where a fit isn't possible."""
    kinds = {f.name: f.dataType.simpleString() for f in bins.schema}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("logit")
        got = fit_platt(rows.logit.to_numpy(), rows.n.to_numpy(), rows.positive.to_numpy())
        return pd.DataFrame([(*key, *got, int(rows.n.sum()))] if got else [], columns=[*cohort, "outcome", "a", "b", "samples"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cohort), "outcome string, a double, b double, samples long"])
    return bins.groupBy(*cohort, "outcome").applyInPandas(fit, schema)


def platt_fits(samples: DataFrame, *cohort: str) -> DataFrame:
    """Per cohort and outcome, from columns outcome, p and y: a, b and samples."""
    return fit_groups(grouped(samples, *cohort), *cohort)


def fits_by_period(bins: DataFrame, period: str, *cohort: str) -> DataFrame:
    """Per cohort, outcome and period: the fit on all earlier periods. Periods are added up one after the other, so that none is read twice."""
    kinds = {f.name: f.dataType.simpleString() for f in bins.schema}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        logit, place = np.unique(rows.logit.to_numpy(), return_inverse=True)
        n, positive = np.zeros(len(logit)), np.zeros(len(logit))
        out = []
        for at, own in sorted(rows.assign(place=place).groupby(period)):
            if n.any():
                used = n > 0
                got = fit_platt(logit[used], n[used], positive[used])
                out += [(*key, at, *got, int(n.sum()))] if got else []
            n[own.place], positive[own.place] = n[own.place] + own.n, positive[own.place] + own.positive
        return pd.DataFrame(out, columns=[*cohort, "outcome", period, "a", "b", "samples"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cohort), f"outcome string, {period} {kinds[period]}, a double, b double, samples long"])
    return bins.groupBy(*cohort, "outcome").applyInPandas(fit, schema)


def walk_forward(samples: DataFrame, period: str, *cohort: str) -> DataFrame:
    """Each sample with the fit of its cohort's earlier periods and its calibrated probability; status APPLIED or UNAVAILABLE.

    Samples are grouped by period first: a later period trains on its predecessors' groups, not on their rows.
    """
    from strictbefore.functions.model import platt

    fits = fits_by_period(grouped(samples, *cohort, period), period, *cohort)
    got = samples.join(fits, [*cohort, period, "outcome"], "left")
    return got.withColumn("calibrated", platt(F.col("p"), F.col("a"), F.col("b"))).withColumn("status", F.when(F.col("a").isNull(), "UNAVAILABLE").otherwise("APPLIED"))


def multiclass(ps: list[Column], fits: list[tuple[Column, Column]]) -> tuple[list[Column], Column]:
    """A distribution through a fit of each outcome, renormalised, and its status.

    UNAVAILABLE without all fits, ERROR where a probability is no number or nothing is left to share; the raw distribution stands in.
    """
    from strictbefore.functions.decision import valid_probability
    from strictbefore.functions.model import platt

    fitted, numbers = F.lit(True), F.lit(True)
    for p, (a, b) in zip(ps, fits, strict=True):
        fitted, numbers = fitted & a.isNotNull() & b.isNotNull(), numbers & valid_probability(p)
    said = [platt(p, a, b) for p, (a, b) in zip(ps, fits, strict=True)]
    total = sum(said[1:], said[0])
    status = F.when(~fitted, "UNAVAILABLE").when(~numbers | ~F.coalesce(total > 0, F.lit(False)), "ERROR").otherwise("APPLIED")
    return [F.when(status == "APPLIED", c / total).otherwise(p) for c, p in zip(said, ps, strict=True)], status


def fit_isotonic(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[list[float], list[float]] | None:
    """Pooled adjacent violators over sorted places p with mean outcomes y of n samples each: places and values.

    A pool's place is the midpoint of what it joins.
    """
    if n.sum() < MIN_SAMPLES:
        return None
    pools: list[list[float]] = []
    for x, v, w in zip(p.tolist(), y.tolist(), n.tolist(), strict=True):
        pools.append([x, v, float(w)])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            x2, v2, w2 = pools.pop()
            x1, v1, w1 = pools[-1]
            pools[-1] = [(x1 + x2) / 2, (w1 * v1 + w2 * v2) / (w1 + w2), w1 + w2]
    return [q[0] for q in pools], [q[1] for q in pools]


def isotonic_fits(samples: DataFrame, *cohort: str) -> DataFrame:
    """Per cohort and outcome: xs and ys of the fitted steps; probabilities equal to six decimals count as one place, which bounds a group."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        got = fit_isotonic(rows.p.to_numpy(), rows.y.to_numpy(), rows.n.to_numpy())
        return pd.DataFrame([(*key, *got)] if got else [], columns=[*cohort, "outcome", "xs", "ys"])

    places = samples.groupBy(*cohort, "outcome", F.round("p", 6).alias("p")).agg(F.avg(F.col("y").cast("double")).alias("y"), F.count("*").alias("n"))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cohort), "outcome string, xs array<double>, ys array<double>"])
    return places.groupBy(*cohort, "outcome").applyInPandas(fit, schema)


def isotonic_value(p, xs, ys):
    """The fitted value at p: linear between places, constant beyond the ends."""
    at = F.size(F.filter(xs, lambda x: x <= p))
    left_x, right_x = F.try_element_at(xs, at), F.try_element_at(xs, at + 1)
    left_y, right_y = F.try_element_at(ys, at), F.try_element_at(ys, at + 1)
    between = left_y + (right_y - left_y) * F.try_divide(p - left_x, right_x - left_x)
    return F.when(at == 0, F.try_element_at(ys, F.lit(1))).when(at == F.size(xs), F.try_element_at(ys, F.size(ys))).otherwise(F.coalesce(between, right_y))
