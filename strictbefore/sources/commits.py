"""A stored table whose merges rewrite the partitions they touch and commit at once.

Each commit is one manifest, ``manifests/<number>.json``: the folder of every partition, and per stream the last batch that is in.
A merge reads the touched partitions' folders, writes the merged rows beside them and then puts the next manifest in
place by a rename that fails if another writer was first; nothing is seen before that, and untouched partitions keep their files. The batch is
recorded in the same file as the rows, so a batch that is replayed after a crash between commit and checkpoint changes nothing.

A key must stay in its partition. The number of partitions that one merge touches comes to the driver, and so does the manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.operators.reconcile import merge as merged


class CommitConflict(Exception):
    """Another writer has committed since this one read the table."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    where = _path(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, path), _path(spark, f"{path}/manifests")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict]:
    """The newest manifest, or that of a number; 0 and an empty one before the first commit."""
    known = _numbers(spark, path)
    if number is None:
        number = known[-1] if known else 0
    if not number:
        return 0, {"schema": None, "parts": {}, "batches": {}}
    text = spark.read.text(f"{path}/manifests/{number:012d}.json", wholetext=True).first()[0]
    return number, json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, found: dict) -> None:
    jvm = spark.sparkContext._jvm
    fs, draft, place = _files(spark, path), _path(spark, f"{path}/drafts/{uuid.uuid4().hex}"), _path(spark, f"{path}/manifests/{number:012d}.json")
    fs.mkdirs(place.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, place, how)
    except Exception as e:
        if fs.exists(place):
            raise CommitConflict(f"{place} is there already") from e
        raise


def read(spark: SparkSession, path: str, number: int | None = None, parts: list | None = None) -> DataFrame | None:
    """The table as of a commit, the newest by default, or some of its partitions; None where there is nothing."""
    _, found = manifest(spark, path, number)
    folders = [f for value, f in found["parts"].items() if parts is None or json.loads(value) in parts]
    return spark.read.schema(found["schema"]).parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def merge(new: DataFrame, path: str, keys: list[str], by: str, new_wins: bool = True, batch: tuple[str, int] | None = None, attempts: int = 3) -> int:
    """Merge ``new``, of distinct keys, field by field (see ``reconcile.merge``) into the partitions by ``by`` that it has rows of; returns the commit's number.

    ``batch`` names a stream and its batch: one that is in already is not merged again. A conflict with another writer starts over, ``attempts`` times in all.
    """
    spark = new.sparkSession
    for left in range(attempts - 1, -1, -1):
        number, found = manifest(spark, path)
        if batch and found["batches"].get(batch[0], -1) >= batch[1]:
            return number
        try:
            return _merged(new, path, keys, by, new_wins, batch, number, found)
        except CommitConflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def _merged(new: DataFrame, path: str, keys: list[str], by: str, new_wins: bool, batch: tuple[str, int] | None, number: int, found: dict) -> int:
    spark = new.sparkSession
    values = sorted(r[0] for r in new.select(_as_json(by)).distinct().collect())
    schema = found["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    folders = [f"{path}/{found['parts'][v]}" for v in values if v in found["parts"]]
    rows = new
    if folders:
        old = spark.read.schema(schema).parquet(*folders)
        rows = merged(old, new.select(*old.columns), keys, new_wins).drop("conflicts").select(*old.columns)
    staged = f"data/{uuid.uuid4().hex}"
    place = F.array_position(F.array(*map(F.lit, values)), _as_json(by)) - 1
    if values:
        rows.withColumn("_part", place).repartition("_part").write.partitionBy("_part").parquet(f"{path}/{staged}")
    after = {"schema": schema, "parts": found["parts"] | {v: f"{staged}/_part={i}" for i, v in enumerate(values)}, "batches": found["batches"] | ({batch[0]: batch[1]} if batch else {})}
    _commit(spark, path, number + 1, after)
    return number + 1


def _as_json(by: str) -> Column:
    """A partition's value as it stands in the manifest."""
    text = F.to_json(F.struct(F.col(by).alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` manifests and the folders that none of these names; returns how many folders went.

    Not to be run while a merge is under way: what that has staged is named by no manifest yet.
    """
    known, fs = _numbers(spark, path), _files(spark, path)
    named = {f.split("/")[1] + "/" + f.split("/")[2] for n in known[-keep:] for f in manifest(spark, path, n)[1]["parts"].values()}
    gone = 0
    for n in known[:-keep]:
        fs.delete(_path(spark, f"{path}/manifests/{n:012d}.json"), False)
    for staged in fs.listStatus(_path(spark, f"{path}/data")):
        inside = [f.getPath() for f in fs.listStatus(staged.getPath()) if f.isDirectory()]
        dead = [p for p in inside if f"{staged.getPath().getName()}/{p.getName()}" not in named]
        gone += len(dead)
        for p in [staged.getPath()] if len(dead) == len(inside) else dead:
            fs.delete(p, True)
    return gone


def merge_stream(stream: DataFrame, path: str, keys: list[str], by: str, latest: str, checkpoint: str, new_wins: bool = True):
    """Start merging a stream into the table, batch by batch; of a key's rows in a batch the one of greatest ``latest`` counts.

    Batches are recorded under the checkpoint's path, as their numbers go on with it.
    """

    def put(rows: DataFrame, number: int) -> None:
        others = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(latest, *[c for c in others if c != latest])).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
        merge(one, path, keys, by, new_wins, (checkpoint, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
