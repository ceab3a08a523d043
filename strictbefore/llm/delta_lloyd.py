"""Lloyd's clustering by differences: what a round didn't change is not computed again.

Vectors of DIMS finite components become integers, floor(SCALE * x). The first centroids are the K vectors of smallest
lower-case SHA-256 of ``<SALT>:<id>``. A round assigns every vector to its nearest centroid by squared Euclidean distance (ties: the
smaller number) and replaces each non-empty centroid by the exact floor of its vectors' mean; after ROUNDS rounds the vectors are assigned once more.

Persisted between rounds: each vector's cluster and distance, and each cluster's component sums and size. A round reads
which centroids changed. A vector whose own centroid stayed keeps its distance and is compared with the changed centroids only;
one whose own centroid changed is compared with all. Vectors that change their cluster are then aggregated as signed integer
transfers, minus their components for the cluster they leave and plus for the one they enter, summed per task and then
over all tasks; the sums move by these, and a round without transfers ends the work, as no later one would change anything.

Vectors and assignments are bucketed tables by the row's key, so that a round joins them without a shuffle; a round's
assignments replace the last one's, and a lost executor costs tasks. All arithmetic is in integers, so results don't depend on order.

Only K centroids and K x DIMS sums come to the driver, and K centroids go to the tasks.

Defined cases: a vector that is null, of another length, or holds a null or non-finite component takes no part and has
no row. Components beyond MOST in size count as MOST, so that distances fit a long; sums of distances beyond a long count as the largest. A null
id is no start but takes part like any other. Repeated rows are vectors of their own; of equal hashes the smaller vector starts first. With
fewer than K vectors there are as many centroids. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictbefore.llm.common import bounded_batches, bucketed, forget, fresh, keyed, materialise

DIMS, K, ROUNDS, SALT, SCALE = 64, 8, 10, 3, 1024
MOST = 1 << 27
KEYS = ("file", "check", "at")
LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """file, check, at, id, q: the vectors that take part, as integers."""
    (row,) = fresh(vectors, "row")
    keyed_rows = keyed(vectors, row)
    got = keyed_rows.select(F.col(row).alias("row"), keyed_rows[id_col].cast("long").alias("id"), keyed_rows[vec_col].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), x * scale)))))
    kept = got.filter((F.size("vec") == dims) & finite)
    return kept.select(*[F.col("row")[k].alias(k) for k in KEYS], "id", F.transform("vec", lambda x: whole(x).cast("int")).alias("q"))


def nearest(q: np.ndarray, was: np.ndarray, own: np.ndarray, centres: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters, distances and how many distances were computed, from the clusters ``was`` at distances ``own`` (-1: none yet)."""
    cluster, distance, compared = was.copy(), own.copy(), 0
    afresh = (was < 0) | changed[was]
    for rows, against in ((np.flatnonzero(afresh), np.arange(len(centres))), (np.flatnonzero(~afresh), np.flatnonzero(changed))):
        if not len(rows):
            continue
        if len(against) == len(centres):
            cluster[rows], distance[rows] = len(centres), LARGEST
        for c in against.tolist():  # in ascending order: of equal distances the smaller number stays
            apart = q[rows] - centres[c]
            d = np.einsum("ij,ij->i", apart, apart)
            better = (d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows]))
            at = rows[better]
            cluster[at], distance[at] = c, d[better]
        compared += len(rows) * len(against)
    return cluster, distance, compared


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigned(joined: DataFrame, centres: np.ndarray, changed: np.ndarray, dims: int) -> DataFrame:
    """The keys with cluster, distance and the cluster before."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            cluster, distance, _ = nearest(matrix(batch.column(3), dims), was.astype(np.int64), own.astype(np.int64), centres, changed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())], names=[*KEYS, "cluster", "distance", "was"])

    narrow = joined.select(*KEYS, "q", "cluster", "distance")
    return narrow.mapInArrow(mapped, "file long, check long, at long, cluster int, distance long, was int")


def transfers(moved: DataFrame, dims: int) -> DataFrame:
    """cluster, place, total, n: signed sums of the vectors that left and entered each cluster, one partial sum a task."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            q = np.column_stack([matrix(batch.column(0), dims), np.ones(batch.num_rows, np.int64)])
            for column, sign in ((1, -1), (2, 1)):
                owner = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(owner[owner >= 0]).tolist():
                    sums[c] = sums.get(c, 0) + sign * q[owner == c].sum(0)
        rows = [(c, place, int(total), int(s[-1])) for c, s in sums.items() for place, total in enumerate(s[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["cluster", "place", "total", "n"])

    parts = moved.select("q", "was", "cluster").mapInArrow(mapped, "cluster int, place int, total long, n long")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, salt: int = SALT, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """One row (id, cluster, distance) per vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = bucketed(quantised(vectors, id_col, vec_col, dims, scale).repartition(buckets, *KEYS), "lloyd_vectors", buckets, *KEYS)
    starts = points.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)).orderBy("h", "q").limit(k).select("q").collect()
    centres = np.array([r["q"] for r in starts], np.int64).reshape(-1, dims)
    changed, state, sums = np.ones(len(centres), bool), None, None
    for turn in range(rounds + 1 if len(centres) else 0):
        if state is None:
            joined = points.withColumn("cluster", F.lit(-1)).withColumn("distance", F.lit(0).cast("long"))
        else:
            joined = points.join(state.drop("was"), list(KEYS))
        before, state = state, bucketed(assigned(joined, centres, changed, dims), "lloyd_state", buckets, *KEYS)
        if before is not None:
            forget(before)
        if turn == rounds:
            break
        moved = transfers(points.join(state.filter("cluster != was"), list(KEYS)), dims)
        total = moved if sums is None else moved.unionByName(sums).groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        sums = materialise(total, "lloyd-sums")
        after = centres.copy()
        for c, place, s, n in sums.filter("n > 0").collect():
            after[c, place] = s // n
        changed, centres = (after != centres).any(1), after
        if not changed.any():
            break
    if state is None:
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), centres
    return points.select(*KEYS, "id").join(state.drop("was"), list(KEYS)).select("id", "cluster", "distance"), centres


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found, centres = fit(vectors, id_col, vec_col, **options)
    apart = F.col("distance").cast("decimal(20,0)")
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(apart).alias("s")).collect()}  # K rows at most
    every = min(sum(per.values()), LARGEST)
    rows = [(c, min(s, LARGEST), every, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
