"""Curated competition knowledge: a catalogue's JSON as tables, its editions, and what is known or missing of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<name:string,url:string,retrieved_at:string,confidence:string>"
RULE = "struct<type:string,from:int,to:int,editions:array<int>,future_to:int>"
COMPETITION = f"struct<league_id:long,name:string,aliases:array<string>,country:string,format:string,edition_rule:{RULE},evidence:array<struct<fact:string,source:string>>>"


def catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Competitions, and the evidence for them with its sources resolved; an unknown source leaves its columns null."""
    raw = spark.read.schema(f"sport string, sources map<string,{SOURCE}>, competitions array<{COMPETITION}>").option("multiLine", True).json(path)
    rows = raw.select("sport", "sources", F.explode("competitions").alias("c")).select("sport", "sources", "c.*")
    evidence = rows.select("sport", "league_id", "sources", F.explode("evidence").alias("e"))
    source = F.try_element_at("sources", F.col("e.source"))
    resolved = evidence.select("sport", "league_id", F.col("e.fact").alias("fact"), F.col("e.source").alias("source"), source["url"].alias("source_url"), source["confidence"].alias("confidence"), source["retrieved_at"].alias("retrieved_at"))
    return rows.drop("sources", "evidence"), resolved


def edition_years(rule: Column, include_future: bool = False) -> Column:
    """The years a competition is staged: the editions it lists, or its range; null where neither is stated."""
    listed = F.when(F.size(rule["editions"]) > 0, F.array_sort(F.array_distinct(rule["editions"])))
    spanned = F.when(rule["to"] >= rule["from"], F.sequence(rule["from"], rule["to"]))
    years = F.coalesce(listed, spanned)
    if not include_future:
        return years
    ahead = F.when(rule["future_to"] > rule["to"], F.sequence(rule["to"] + 1, rule["future_to"]))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(years, F.array().cast("array<int>")), F.coalesce(ahead, F.array().cast("array<int>")))))


def gap_report(competitions: DataFrame, required: DataFrame, known: DataFrame, start: int, horizon: int) -> DataFrame:
    """One row per competition and season from ``start`` to ``horizon``, documented editions outside that included.

    ``required`` (sport, league_id, name) is what should be in the catalogue: what isn't stays visible as a gap. ``known``
    (league_id, season, participants, fixture_total) is the evidence held.
    """
    lattice = F.sequence(F.lit(start), F.lit(horizon))
    documented = F.coalesce(edition_years(F.col("edition_rule"), True), F.array().cast("array<int>"))
    own = competitions.select("sport", "league_id", "name", F.explode(F.array_sort(F.array_union(lattice, documented))).alias("season"), documented.alias("_doc"), F.lit(True).alias("catalogued"))
    missing = required.join(competitions.select("sport", "league_id"), ["sport", "league_id"], "left_anti").select("sport", "league_id", "name", F.explode(lattice).alias("season"), F.array().cast("array<int>").alias("_doc"), F.lit(False).alias("catalogued"))
    rows = own.unionByName(missing).join(known, ["league_id", "season"], "left")
    staged = F.array_contains("_doc", F.col("season"))
    gaps = F.array_compact(F.array(
        F.when(~F.col("catalogued"), "competition_not_catalogued"), F.when(F.col("catalogued") & ~staged, "edition_not_documented"),
        F.when(staged & F.col("participants").isNull(), "participants_unknown"), F.when(staged & F.col("fixture_total").isNull(), "fixture_total_unknown"),
    ))
    return rows.select("sport", "league_id", "name", "season", F.when(F.col("catalogued"), staged).alias("exists"), "participants", "fixture_total", gaps.alias("evidence_gaps"))


def expected_fixtures(fmt: Column, participants: Column, documented: Column) -> Column:
    """The documented total; in a league otherwise every ordered pair of its teams; null for other formats."""
    return F.coalesce(documented, F.when(fmt == "league", participants * (participants - 1)))


def recovery_plan(report: DataFrame) -> DataFrame:
    """What to do about the gaps: the first action that applies, with the seasons it is for."""
    has = lambda gap: F.array_contains("evidence_gaps", gap)
    action = F.when(has("competition_not_catalogued"), "catalogue").when(has("edition_not_documented"), "document_edition").when(has("participants_unknown"), "find_participants").when(has("fixture_total_unknown"), "find_fixture_total")
    rows = report.withColumn("action", action).filter("action is not null")
    return rows.groupBy("sport", "league_id", "action").agg(F.count("*").alias("seasons"), F.min("season").alias("first"), F.max("season").alias("last"))
