"""Isotonic fits on samples as they are: pools of adjacent violators made side by side and merged in order.

The blocks that pooling ends with depend on the data and not on the order of the poolings. So stretches of the sorted places are pooled by themselves, a task each, which
leaves few pools; these are pooled again, per fit, in order; and each place learns its block by its pool. A block's value is its mean, compared in whole numbers. Its place, the midpoint
of what it joined step by step, does depend on the order: it is found by going through the block's places in order, with a stack of pools as all that is
held; different blocks are gone through by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from strictbefore.operators.calibration import MIN_SAMPLES
from strictbefore.sources.sinks import stored


def pooled(places: Iterable[tuple[float, int, int]]) -> list[list]:
    """Pools [place, sum, n, first place] of sorted (place, sum of outcomes, samples): while a pool's mean is over the next one's the two are joined, at the midpoint of their places."""
    pools: list[list] = []
    for x, s, n in places:
        pools.append([x, s, n, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            x2, s2, n2, _ = pools.pop()
            top = pools[-1]
            pools[-1] = [(top[0] + x2) / 2, top[1] + s2, top[2] + n2, top[3]]
    return pools


class Midpoint:
    """The place of a block whose places come in order."""

    def __init__(self) -> None:
        self.pools: list[list] = []
        self.key = None

    def eval(self, row: Row) -> None:
        self.key = (row["fit"], row["block"])
        self.pools.append([row["p"], row["s"], row["n"]])
        while len(self.pools) > 1 and self.pools[-2][1] * self.pools[-1][2] > self.pools[-1][1] * self.pools[-2][2]:
            x2, s2, n2 = self.pools.pop()
            x1, s1, n1 = self.pools[-1]
            self.pools[-1] = [(x1 + x2) / 2, s1 + s2, n1 + n2]

    def terminate(self) -> Iterator[tuple]:
        if self.key:
            # at the end of a block its places have become one pool
            x, s, n = self.pools[0]
            yield *self.key, x, s / n


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of a task, sorted, each with the first place of the pool it falls in."""
    held = [b for b in batches if len(b)]
    rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=["fit", "p", "s", "n"])
    for fit, own in rows.groupby("fit", sort=False):
        first = np.array([pool[3] for pool in pooled(zip(own.p.tolist(), own.s.tolist(), own.n.tolist(), strict=True))])
        yield own.assign(pool=first[np.searchsorted(first, own.p.to_numpy(), "right") - 1], fit=fit)[["fit", "p", "s", "n", "pool"]]


def _blocks(key: tuple, pools: pd.DataFrame) -> pd.DataFrame:
    """Each pool of a fit with the first place of its block."""
    pools = pools.sort_values("pool")
    first = np.array([b[3] for b in pooled(zip(pools.pool.tolist(), pools.s.tolist(), pools.n.tolist(), strict=True))])
    at = pools.pool.to_numpy()
    return pd.DataFrame({"fit": key[0], "pool": at, "block": first[np.searchsorted(first, at, "right") - 1]})


def fits(samples: DataFrame, *cohort: str) -> DataFrame:
    """Per cohort and outcome of MIN_SAMPLES samples (p, y) or more: xs and ys of the fitted steps. Samples without a p or y don't count; equal p are one place."""
    names = [*cohort, "outcome"]
    known = samples.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull())
    places = known.groupBy(*names, F.col("p").cast("double").alias("p")).agg(F.sum(F.col("y").cast("long")).alias("s"), F.count("*").alias("n"))
    numbered = places.groupBy(*names).agg(F.sum("n").alias("_n")).filter(F.col("_n") >= MIN_SAMPLES).select(*names, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("fit"))
    numbered = stored(numbered, "fits")
    same = F.lit(True)
    for c in names:
        same = same & places[c].eqNullSafe(numbered[c])
    ordered = places.join(numbered, same).select("fit", "p", "s", "n").repartitionByRange("fit", "p").sortWithinPartitions("fit", "p")
    placed = stored(ordered.mapInPandas(_stretches, "fit string, p double, s long, n long, pool double"), "places")
    pools = placed.groupBy("fit", "pool").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    blocks = pools.groupBy("fit").applyInPandas(_blocks, "fit string, pool double, block double")
    rows = placed.join(blocks, ["fit", "pool"]).select("fit", "block", "p", "s", "n")
    midpoints = udtf(Midpoint, returnType="fit string, block double, x double, y double")
    steps = midpoints(rows.asTable().partitionBy("fit", "block").orderBy("p"))
    got = steps.groupBy("fit").agg(F.array_sort(F.collect_list(F.struct("block", "x", "y"))).alias("steps"))
    return got.join(numbered, "fit").select(*names, F.transform("steps", lambda s: s["x"]).alias("xs"), F.transform("steps", lambda s: s["y"]).alias("ys"))
