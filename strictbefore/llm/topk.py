"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are quantised to floor(SCALE * x). A node is a chunk of CHUNK rows and one of SLICES slices of the dimensions; its
local score is the inner product over the slice. Queries are a written table; a task holds one chunk of rows and reads
the queries by blocks of QUERY_BLOCK, so each phase is one job whatever the number of queries, and a task's memory has a fixed bound.

Phase 1: every node names the k rows of highest local score per query; their full scores give each query a lower bound
of its k-th score. Phase 2: the bounds are sent to all nodes with the queries. A row whose score reaches the bound must reach
an even share of it in some slice, so the rows that do are sufficient. Slice by slice, rows that neither have such a
share yet nor can still get it (by the norms of what is left, Cauchy-Schwarz) for any query of the block are dropped before the next product.
Phase 3: the scores of the rest are resolved exactly; what reaches the bound is ranked, ties to the smaller id.

Scores are integers. Where every sum is certain to stay below 2^53 they are computed in doubles, else in Python's
integers and kept within a long.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. A
query meets rows of its own dimension only. A query's own row is every row of its id; of rows that repeat a query's id the
least vector asks. Rows that repeat an id are candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.llm.common import materialise

K, SCALE, SLICES = 10, 1024, 4
#: Queries asked at once, rows that a task holds, and rows scored at once: at 1,024 dimensions 8, 128 and 16 MB of doubles.
QUERY_BLOCK, CHUNK, ROW_BLOCK = 1024, 16_384, 2048
#: Components beyond HUGE count as HUGE; scores are kept within a long.
HUGE = 1e300
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: finite(x.cast("double")))


def quantised(values: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows' places and floor(scale * x); doubles, or Python integers where a long is too short."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.diff(values.offsets.to_numpy())
    flat = np.floor(np.clip(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -HUGE, HUGE) * scale)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        out[dim] = (rows, flat[starts[rows][:, None] + np.arange(dim)])
    return out


def products(q: np.ndarray, x: np.ndarray, spans: list[slice]) -> list[np.ndarray]:
    """Inner products over each span of the dimensions, exact."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return [q[:, s] @ x[:, s].T for s in spans]
    integers = lambda m: np.array([[int(v) for v in r] for r in m], object)
    a, b = integers(q), integers(x)
    return [a[:, s] @ b[:, s].T for s in spans]


def whole(scores: np.ndarray) -> list[int]:
    return [min(max(int(s), LEAST), MOST) for s in scores]


class Asked:
    """A block of queries by dimension: ids, vectors, and in phase 2 each one's bound."""

    def __init__(self, block: pa.RecordBatch, scale: int):
        ids = block.column("id").to_numpy(zero_copy_only=False)
        bounds = np.array([-np.inf if b is None else b for b in block.column("bound").to_pylist()], object) if "bound" in block.schema.names else np.full(len(ids), -np.inf, object)
        self.by = {dim: (ids[rows], q, bounds[rows]) for dim, (rows, q) in quantised(block.column("v"), scale).items()}


def asked(files: list[str], scale: int, query_block: int) -> Iterator[Asked]:
    """The queries of a written table, block by block."""
    from pyarrow import fs
    from pyarrow.parquet import ParquetFile

    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            for block in ParquetFile(source).iter_batches(query_block):
                yield Asked(block, scale)


def cut(dim: int, slices: int) -> list[slice]:
    edges = [dim * i // slices for i in range(slices + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def chunks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Up to CHUNK rows as blocks of one dimension: dimension, ids, vectors."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            held += [(dim, ids[own], x) for dim, (own, x) in quantised(part.column(1), scale).items()]
            rows += part.num_rows
            if rows >= CHUNK:
                yield held
                held, rows = [], 0
    if held:
        yield held


def table(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def local_lists(files: list[str], k: int, scale: int, slices: int, query_block: int):
    """Phase 1: per query the k best full scores among the rows of a chunk that some node's local list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, scale):
            for block in asked(files, scale, query_block):
                best: dict[int, list] = {}
                for dim, ids, x in chunk:
                    if dim not in block.by:
                        continue
                    own, q, _ = block.by[dim]
                    local = products(q, x, cut(dim, slices))
                    total = sum(local[1:], local[0])
                    for i, me in enumerate(own.tolist()):
                        named = set()
                        for scores in local:
                            named.update(np.argpartition(-scores[i], min(k, len(ids) - 1))[: k + 1].tolist())
                        at = np.array([j for j in named if ids[j] != me], np.int64)
                        best[me] = sorted([*best.get(me, []), *total[i][at].tolist()], reverse=True)[:k]
                yield table(["query_id", "score"], [(me, s) for me, scores in best.items() for s in whole(scores)])

    return run


def survivors(q: np.ndarray, x: np.ndarray, bounds: np.ndarray, spans: list[slice]) -> np.ndarray:
    """Places of the rows that reach an even share of some query's bound in some slice, or may: norms drop the rest between products."""
    share = np.array([b / len(spans) - abs(b) * 1e-15 - 1 if b > -np.inf else b for b in bounds.tolist()], float)  # at most too low
    alive, sure = np.arange(len(x)), np.zeros(len(x), bool)
    norms = lambda m: np.sqrt(np.stack([np.square(m[:, s].astype(float)).sum(1) for s in spans]))
    q_norms, x_norms = norms(q), norms(x)
    for n, s in enumerate(spans):
        todo = alive[~sure[alive]]
        if not len(todo):
            break
        (scores,) = products(q, x[todo], [s])
        sure[todo] |= (scores >= share[:, None]).any(0)
        later = [m for m in range(n + 1, len(spans))]
        may = np.zeros(len(todo), bool)
        for m in later:  # a slice's product is at most the product of its norms; 1e-9 allows for their rounding, and what is no number may be anything
            may |= (~(np.outer(q_norms[m], x_norms[m][todo]) * (1 + 1e-9) < share[:, None])).any(0)
        alive = np.sort(np.concatenate([alive[sure[alive]], todo[may & ~sure[todo]]]))
    return alive[sure[alive]]


def sufficient(files: list[str], k: int, scale: int, slices: int, query_block: int):
    """Phases 2 and 3: of each chunk the rows that suffice, resolved exactly; its k best per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, scale):
            for block in asked(files, scale, query_block):
                best: dict[int, list[tuple[int, int]]] = {}
                for dim, ids, x in chunk:
                    if dim not in block.by:
                        continue
                    own, q, bounds = block.by[dim]
                    left = survivors(q, x, bounds, cut(dim, slices))
                    if not len(left):
                        continue
                    (total,) = products(q, x[left], [slice(0, dim)])
                    least = bounds if total.dtype == object else bounds.astype(float)  # doubles here are whole numbers below 2^53
                    reach = (total >= least[:, None]).astype(bool) & (ids[left][None, :] != own[:, None])
                    for i in np.flatnonzero(reach.any(1)).tolist():
                        at = np.flatnonzero(reach[i])
                        scores, names = total[i][at], ids[left[at]]
                        found = first_of(names, scores, k)
                        me = int(own[i])
                        merged = [*best.get(me, []), *zip(whole(scores[found]), names[found].tolist(), strict=True)]
                        best[me] = sorted(merged, key=lambda p: (-p[0], p[1]))[:k]
                yield table(["query_id", "vec_id", "score"], [(me, v, s) for me, found in best.items() for s, v in found])

    return run


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = K, scale: int = SCALE, slices: int = SLICES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among all rows but its own."""
    pick = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = pick(vectors)
    asking = materialise(pick(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    lists = rows.mapInArrow(local_lists(asking.inputFiles(), k, scale, slices, query_block), "query_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    bounds = lists.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("bound"))
    bounded = materialise(asking.join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "v", "bound"), "bounded-queries")
    found = rows.mapInArrow(sufficient(bounded.inputFiles(), k, scale, slices, query_block), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
