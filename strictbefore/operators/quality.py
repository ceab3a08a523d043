"""Audits of stored data: participation, structure, coverage of fields, identity conflicts and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def participation(found: DataFrame, *cohort: str) -> DataFrame:
    """Matches per team: at home, away and in all."""
    sides = F.array(F.struct(F.col("home_id").alias("team_id"), F.lit(1).alias("home")), F.struct(F.col("away_id").alias("team_id"), F.lit(0).alias("home")))
    rows = found.select(*cohort, F.explode(sides).alias("s")).select(*cohort, "s.*")
    return rows.groupBy(*cohort, "team_id").agg(F.sum("home").cast("long").alias("home"), F.sum(1 - F.col("home")).cast("long").alias("away"), F.count("*").alias("matches"))


def structure(found: DataFrame, expected_teams: int, *cohort: str) -> DataFrame:
    """A verdict per cohort on a double round robin: universe of teams, number of fixtures, balance; the first failure is named."""
    teams = participation(found, *cohort).groupBy(*cohort).agg(F.count("*").alias("teams"), F.min("matches").alias("fewest"), F.max("matches").alias("most"))
    fixtures = found.groupBy(*cohort).agg(
        F.count("*").alias("fixtures"), F.count_distinct("fixture_id").alias("ids"), F.count_distinct(F.struct("home_id", "away_id", F.to_date("kickoff_at"))).alias("logical")
    )
    wanted = expected_teams * (expected_teams - 1)
    verdict = (
        F.when(F.col("fixtures") > F.col("ids"), "duplicate_ids").when(F.col("fixtures") > F.col("logical"), "duplicate_fixtures")
        .when(F.col("teams") != expected_teams, "team_universe_mismatch").when(F.col("fixtures") != wanted, "fixture_count_mismatch")
        .when(F.col("fewest") != F.col("most"), "team_participation_imbalance").otherwise("verified")
    )
    return fixtures.join(teams, list(cohort)).withColumn("verdict", verdict)


def field_coverage(rows: DataFrame, fields: list[str], *cohort: str) -> DataFrame:
    """The share of rows that have each field."""
    got = rows.groupBy(*cohort).agg(F.count("*").alias("rows"), *[F.count(f).alias(f"n_{f}") for f in fields])
    return got.select(*cohort, "rows", *[F.try_divide(F.col(f"n_{f}"), F.col("rows")).alias(f"{f}_coverage") for f in fields])


def conflicting_names(rows: DataFrame, name: str, identity: str, *scope: str) -> DataFrame:
    """Names that stand for more than one identity in a scope."""
    got = rows.groupBy(*scope, name).agg(F.count_distinct(identity).alias("identities"), F.min(identity).alias("first"), F.max(identity).alias("last"))
    return got.filter("identities > 1")


def ledger(rows: DataFrame, key: str, fields: dict[str, Column], reason: Column) -> DataFrame:
    """One row per key and field with its outcome: present, or why not."""
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.when(col.isNotNull(), "present").otherwise(reason).alias("outcome")) for name, col in fields.items()])
    return rows.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of the fields that are null, in order."""
    return F.array_compact(F.array(*[F.when(col.isNull(), F.lit(name)) for name, col in fields.items()]))


def lifecycle(first: Column, last: Column, rows: Column, latest: Column, today: Column, verified: Column, grace_days: int = 21) -> Column:
    """UPCOMING, ONGOING, COMPLETED or UNKNOWN from a season's window and what is stored of it; the first rule that applies."""
    late = latest > F.date_add(last, grace_days)
    return (
        F.when(first.isNull() | last.isNull(), "UNKNOWN")
        .when(rows == 0, F.when(today < first, "UPCOMING").when(today <= last, "ONGOING").otherwise("UNKNOWN"))
        .when(~verified, F.when(today <= last, "ONGOING").otherwise("UNKNOWN"))
        .when(today < first, "UPCOMING").when(today <= last, "ONGOING").when(late, "UNKNOWN").otherwise("COMPLETED")
    )
