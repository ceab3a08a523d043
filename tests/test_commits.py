"""A stored table's merges: partitions, replays, writers in each other's way."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from strictbefore.sources import commits

SCHEMA = "id long, part string, a long, b long, sent int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def stored(spark, path):
    return sorted(tuple(r) for r in commits.read(spark, path).select("id", "a", "b").collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def test_merges_touch_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read(spark, path) is None
    commits.merge(rows(spark, (1, "x", 1, None, 0), (2, "y", 2, 2, 0), (3, None, 3, 3, 0), (4, 'q"/ü', 4, 4, 0)), path, ["id"], "part")
    before, parts = files(path), commits.manifest(spark, path)[1]["parts"]
    assert len(parts) == 4
    commits.merge(rows(spark, (1, "x", 9, 1, 1), (5, "x", 5, 5, 1), (3, None, None, 7, 1)), path, ["id"], "part")
    assert stored(spark, path) == [(1, 9, 1), (2, 2, 2), (3, 3, 7), (4, 4, 4), (5, 5, 5)]
    after = commits.manifest(spark, path)[1]["parts"]
    assert {v for v in after if after[v] != parts[v]} == {'"x"', "null"}
    assert all(files(path)[f] == t for f, t in before.items())
    assert stored_as_of(spark, path, 1) == [(1, 1, None), (2, 2, 2), (3, 3, 3), (4, 4, 4)]
    assert [r["id"] for r in commits.read(spark, path, parts=['q"/ü']).collect()] == [4]
    commits.merge(rows(spark, (1, "x", 100, 100, 2)), path, ["id"], "part", new_wins=False)
    assert stored(spark, path)[0] == (1, 9, 1)
    assert commits.expire(spark, path, 1) == 3 and stored(spark, path)[0] == (1, 9, 1)
    assert commits.manifest(spark, path)[0] == 3
    commits.merge(rows(spark), path, ["id"], "part")  # an empty delivery
    assert len(stored(spark, path)) == 5


def stored_as_of(spark, path, number):
    return sorted(tuple(r) for r in commits.read(spark, path, number).select("id", "a", "b").collect())


def test_one_of_two_writers_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.merge(rows(spark, (1, "x", 1, 1, 0)), path, ["id"], "part")
    number, found = commits.manifest(spark, path)
    args = path, ["id"], "part", True, None, number, found  # both have read the same commit
    assert commits._merged(rows(spark, (2, "x", 2, 2, 0)), *args) == 2
    with pytest.raises(commits.CommitConflict):
        commits._merged(rows(spark, (3, "x", 3, 3, 0)), *args)
    assert stored(spark, path) == [(1, 1, 1), (2, 2, 2)]
    assert commits.merge(rows(spark, (3, "x", 3, 3, 0)), path, ["id"], "part") == 3  # it starts over
    assert stored(spark, path) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def test_a_conflict_is_tried_again(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), commits._commit
    commits.merge(rows(spark, (1, "x", 1, 1, 0)), path, ["id"], "part")
    lost = []

    def beaten(spark, where, number, found):
        if not lost:
            lost.append(number)
            raise commits.CommitConflict
        real(spark, where, number, found)

    monkeypatch.setattr(commits, "_commit", beaten)
    assert commits.merge(rows(spark, (2, "x", 2, 2, 0)), path, ["id"], "part") == 2
    assert stored(spark, path) == [(1, 1, 1), (2, 2, 2)]
    lost.clear()
    with pytest.raises(commits.CommitConflict):
        commits.merge(rows(spark, (3, "x", 3, 3, 0)), path, ["id"], "part", attempts=1)


def test_a_stream_merges_each_batch_once(spark, tmp_path):
    """Repeated keys in a batch, a restart, and a batch whose checkpoint was lost after its commit."""
    path, source, checkpoint = (str(tmp_path / n) for n in ("t", "in", "c"))
    run = lambda: commits.merge_stream(spark.readStream.schema(SCHEMA).parquet(source), path, ["id"], "part", "sent", checkpoint).awaitTermination()
    rows(spark, (1, "x", 1, 1, 0), (1, "x", 5, None, 3), (1, "x", 4, 4, 2), (2, "y", 2, 2, 0)).coalesce(1).write.mode("append").parquet(source)
    run()
    assert stored(spark, path) == [(1, 5, None), (2, 2, 2)]
    rows(spark, (2, "y", 8, 8, 1)).coalesce(1).write.mode("append").parquet(source)
    run()
    number, found = commits.manifest(spark, path)
    assert stored(spark, path) == [(1, 5, None), (2, 8, 8)] and found["batches"] == {checkpoint: 1}
    # the process dies after the commit and before the checkpoint notes it: the batch comes again
    for f in glob.glob(f"{checkpoint}/commits/*1*"):
        os.remove(f)
    for f in glob.glob(f"{checkpoint}/commits/.*1*"):
        os.remove(f)
    run()
    assert commits.manifest(spark, path) == (number, found)
    assert json.load(open(f"{path}/manifests/{number:012d}.json")) == found
    assert commits.read(spark, path).filter(F.col("id") == 2).count() == 1
