"""Evaluation over long-form predictions: one row per (key, outcome) with its probability and whether it happened.

Everything is a map-side combined aggregate: rows meet per group and bin, never per prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bin edges, the clip of a logarithm, the sample below which figures don't count.
EDGES, EPS, MIN_SAMPLE, Z = (0.0, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8), 1e-15, 30, 1.96


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def brier(ps: list[Column], ys: list[Column]) -> Column:
    """Per row: two outcomes count the first only, more the sum over all."""
    terms = [F.pow(p - y.cast("double"), F.lit(2.0)) for p, y in zip(ps, ys, strict=True)]
    return terms[0] if len(terms) == 2 else sum(terms[1:], terms[0])


def log_loss(ps: list[Column], ys: list[Column]) -> Column:
    return -sum((F.when(y, F.ln(clip(p))).otherwise(0.0) for p, y in zip(ps, ys, strict=True)), F.lit(0.0))


def bin_of(p: Column) -> Column:
    """The lower edge of a probability's bin; what lies beyond 0 or 1 counts as that, and the last bin holds 1."""
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    out = F.when(p < EDGES[1], EDGES[0])
    for low, high in zip(EDGES[1:], EDGES[2:], strict=False):
        out = out.when(p < high, low)
    return out.when(p <= 1, EDGES[-1])


def calibration(samples: DataFrame, *group: str) -> DataFrame:
    """Per group and bin: count, mean probability, rate and gap, from columns p and y; probabilities are held to 0..1."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    binned = samples.withColumn("p", p).withColumn("bin", bin_of(F.col("p"))).groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return binned.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def all_bins(bins: DataFrame, *group: str) -> DataFrame:
    """calibration() with a row for every bin of every group, empty ones with 0 samples and no figures, 4 decimals."""
    every = bins.select(*group).distinct() if group else bins.sparkSession.range(1).select()
    every = every.select(*group, F.explode(F.array(*map(F.lit, EDGES))).alias("bin"))
    got = every.join(bins, [*group, "bin"], "left")
    return got.select(*group, "bin", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 4).alias(c) for c in ("mean_p", "rate", "gap")])


def expected_calibration_error(bins: DataFrame, *group: str) -> DataFrame:
    return bins.groupBy(*group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def interval(correct: Column, graded: Column) -> tuple[Column, Column]:
    """A 95% normal interval of a rate, within [0, 1]."""
    rate = F.try_divide(correct, graded)
    half = Z * F.sqrt(F.try_divide(rate * (1 - rate), graded))
    return F.greatest(rate - half, F.lit(0.0)), F.least(rate + half, F.lit(1.0))


def prior_frequencies(rows: DataFrame, value: str, outcomes: list[str], *cohort: str) -> DataFrame:
    """Per row: how often each outcome came strictly before, uniform while nothing has: prior_<outcome>.

    Outcomes are counted per instant first, so the frame runs over the cohort's instants.
    """
    counts = rows.groupBy(*cohort, "ts").agg(F.count(value).alias("n"), *[F.count(F.when(F.col(value) == o, 1)).alias(f"n_{o}") for o in outcomes])
    w = Window.partitionBy(*cohort).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    prior = [F.coalesce(F.try_divide(F.sum(f"n_{o}").over(w), F.sum("n").over(w)), F.lit(1.0 / len(outcomes))).alias(f"prior_{o}") for o in outcomes]
    return rows.join(counts.select(*cohort, "ts", *prior), [*cohort, "ts"])


def bucket_of(top: Column) -> Column:
    return F.when(top < 0.5, "<50%").when(top < 0.6, "50-60%").when(top < 0.7, "60-70%").otherwise("70%+")
