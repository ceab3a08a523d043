"""Matching by name against brute force over all pairs of a cohort."""

from pyspark.sql import functions as F

from strictbefore.functions import text
from strictbefore.operators import reconcile
from strictbefore.plans import library


def brute(left, right, least=0.85):
    """(a, b) of ids: every pair of a cohort is scored, ties are rejected."""
    pairs = left.join(right.withColumnRenamed("g", "h"), F.col("g") == F.col("h")).withColumn("score", text.name_score(F.col("n"), F.col("m")))
    by = {}
    for r in pairs.collect():
        if r["score"] >= least:
            by.setdefault(r["a"], []).append((r["score"], r["b"]))
    best = {a: [x for x in own if x[0] == max(own)[0]] for a, own in by.items()}
    return {(a, *own[0][::-1]) for a, own in best.items() if len(own) == 1}


def test_best_names_against_all_pairs(spark):
    names = ["Athletic Bilbao", "Athletic Club", "Barça", "Barcelona", "Diddeleng", "Inter", "Internazionale", "A", "a", "Ars", "Yarsenal", "Real Unión", "Union Berlin", "FC Köln", "1. FC Koln", "köln", "", None, "Xy Zed", "Nowhere", "Nowhere"]
    left = spark.createDataFrame([(i, i % 3, names[i * 5 % len(names)]) for i in range(150)], "a long, g int, n string")
    right = spark.createDataFrame([(i, i % 3, names[i * 4 % len(names)]) for i in range(40)], "b long, g int, m string")
    few = right.filter("b < 14")
    for other in (right, few):
        got = [(r["a"], r["b"], r["score"]) for r in reconcile.best_names(left, other, "g", "n", "m").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(left, other)
    assert brute(left, few)


def test_matched_names_against_all_pairs(spark):
    from strictbefore.plans import stream_queries

    found = library.QUERIES["matched_names"](spark, "/root/testdata/sf0.01").collect()
    c, s = stream_queries.named_sides(spark, "/root/testdata/sf0.01")
    left, right = c.selectExpr("c_custkey a", "c_nationkey g", "c_name n"), s.selectExpr("s_suppkey b", "c_nationkey g", "s_name m")
    assert {(r["c_custkey"], r["s_suppkey"], r["score"]) for r in found} == brute(left, right)
    assert len(found) > 20 and {r["score"] for r in found} == {0.85, 0.95, 1.0}
    assert any(r["c_custkey"] % 97 != r["s_suppkey"] % 97 for r in found)


def test_alias_names_cover_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    found = library.QUERIES["alias_suffix_names"](spark, sf).collect()
    numbers = {int(r["customer_name"].split("-")[1]): r["customers"] for r in found}
    counts = spark.read.parquet(f"{sf}/customer.parquet").groupBy((F.col("c_custkey") % 90).alias("n")).count().collect()
    assert numbers and all(numbers[r["n"]] == r["count"] for r in counts if r["n"] in numbers)
    pairs = [(r["s_suppkey"], r["c_custkey"]) for r in library.QUERIES["alias_suffix_matches"](spark, sf).collect()]
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey % 4 != 1").select("s_suppkey").collect()
    assert sorted(pairs) == sorted((r[0], r[0]) for r in suppliers)  # A.F.C isn't a suffix
