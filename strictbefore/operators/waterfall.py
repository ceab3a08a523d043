"""Provider waterfalls: a later provider is asked only for what the earlier ones left open, and says so.

``cascade`` asks the tiers in turn. What a tier answers is written once; a verdict over all answers so far closes keys, and only keys that are still open, by an
anti join, reach the next tier. The log has a row for each key and tier that was read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.sources.sinks import stored

# Verdicts on a provider's list.
ERROR, EMPTY, MALFORMED, DATA = "PROVIDER_ERROR", "VALID_EMPTY", "INSUFFICIENT_MALFORMED", "VALID_DATA"

Tier = tuple[str, Callable[[DataFrame], DataFrame]]


def cascade(asked: DataFrame, tiers: list[Tier], keys: list[str], enough: Callable[[DataFrame], DataFrame], unique: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, log) of asking ``tiers`` for the keys of ``asked``.

    A tier is a name and a function from open keys to rows with these keys. ``enough`` takes all rows so far, with ``provider`` and ``tier``, and returns the
    keys that need no more. Of rows that agree on the keys and ``unique`` the one of the earliest tier stays; without ``unique`` all stay. Keys are not null.
    """
    open_, rows, log = stored(asked.select(*keys).distinct(), "asked"), None, None
    for n, (name, ask) in enumerate(tiers):
        got = ask(open_).withColumns({"provider": F.lit(name), "tier": F.lit(n)})
        if unique and rows is not None:
            got = got.join(rows.select(*keys, *unique), [*keys, *unique], "left_anti")
        got = stored(got, "answers")
        rows = got if rows is None else rows.unionByName(got)
        done = stored(enough(rows).select(*keys).distinct(), "closed")
        counts = got.groupBy(*keys).agg(F.count("*").alias("rows_read"))
        seen = open_.join(counts, keys, "left").join(done.withColumn("enough", F.lit(True)), keys, "left")
        seen = seen.select(*keys, F.lit(n).alias("tier"), F.lit(name).alias("provider"), F.coalesce("rows_read", F.lit(0)).alias("rows_read"), F.coalesce("enough", F.lit(False)).alias("enough"))
        log = seen if log is None else log.unionByName(seen)
        open_ = stored(open_.join(done, keys, "left_anti"), "open")
    return rows, log


def pair(home: str, away: str) -> Column:
    """Two teams in either role."""
    return F.struct(F.least(home, away).alias("one"), F.greatest(home, away).alias("other"))


def latest_meetings(asked: DataFrame, found: DataFrame, n: int, key: str = "ask") -> DataFrame:
    """The last ``n`` of the finished matches ``found`` (fixture_id, ts, home_id, away_id, goals) between each ask's two teams strictly before it.

    ``asked`` has ``key``, ts, home_id, away_id. Matches are numbered per pair in time; an ask counts the ones before it and names the numbers it wants, so asks and matches of a
    busy pair meet by equality, n rows an ask, and never all with all.
    """
    known = found.filter("fixture_id is not null and ts is not null and home_id is not null and away_id is not null and home_goals is not null and away_goals is not null")
    known = known.select(pair("home_id", "away_id").alias("_pair"), *found.columns).dropDuplicates(["_pair", "fixture_id"])
    asks = asked.filter("home_id is not null and away_id is not null and home_id != away_id").select(F.col(key).alias("_ask"), F.col("ts").alias("_at"), pair("home_id", "away_id").alias("_pair"))
    w = Window.partitionBy("_pair").orderBy("ts", "fixture_id")
    numbered = known.withColumn("_number", F.row_number().over(w))
    # asks stand before the matches of their instant, so they count what is strictly before
    both = known.select("_pair", F.col("ts").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(asks.schema["_ask"].dataType).alias("_ask")).unionByName(asks.withColumn("_kind", F.lit(0)))
    before = F.sum("_kind").over(Window.partitionBy("_pair").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("_before", before).filter("_kind = 0 and _before > 0")
    wanted = placed.select("_pair", "_ask", F.explode(F.sequence(F.greatest(F.col("_before") - n + 1, F.lit(1).cast("long")), "_before")).alias("_number"))
    return wanted.join(numbered, ["_pair", "_number"]).drop("_pair", "_number").withColumnRenamed("_ask", key)


def meetings(asked: DataFrame, tiers: list[tuple[str, DataFrame]], n: int = 6, key: str = "ask") -> tuple[DataFrame, DataFrame]:
    """(rows, log): the last ``n`` meetings before each ask, from as few providers as have enough of them; each meeting once, from the earliest provider that has it.

    A later provider is asked for 2 n, of which the earlier ones may know up to n - 1 already.
    """
    asks = stored(asked.select(key, "ts", "home_id", "away_id"), "asks")
    ask = lambda found: lambda open_: latest_meetings(asks.join(open_, key, "left_semi"), found, 2 * n, key)
    enough = lambda rows: rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n)
    rows, log = cascade(asks, [(name, ask(found)) for name, found in tiers], [key], enough, ["fixture_id"])
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("fixture_id"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n), log


def missing_fields(columns: list[str], when_finished: list[str]) -> Column:
    """The fields a fixture lacks: ``columns`` always, ``when_finished`` once it is over."""
    done = F.col("status_short").isin("FT", "AET", "PEN")
    lacks = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns] + [F.when(done & F.col(c).isNull(), F.lit(c)) for c in when_finished]
    return F.array_compact(F.array(*lacks))


def days(asked: DataFrame, tiers: list[tuple[str, DataFrame]], fields: list[str], when_finished: list[str], identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, log): the fixtures of each asked league and day, put together field by field from as few providers as leave no field missing.

    Tiers hold ``league_id``, ``day``, the ``identity`` columns, ``status_short`` and the fields. A day is closed when it has fixtures and each of them, merged over the tiers
    so far, has all it needs. A field comes from the earliest tier that says it; ``<field>_provider`` names that, ``disputed`` the fields whose providers differ.
    """
    keys, every = ["league_id", "day"], list(dict.fromkeys([*fields, *when_finished, "status_short"]))

    def put_together(rows: DataFrame) -> DataFrame:
        best = [F.min(F.when(F.col(f).isNotNull(), F.struct("tier", "provider", F.col(f).alias("value")))).alias(f"_{f}") for f in every]
        differ = [(F.min(f) != F.max(f)).alias(f"_d_{f}") for f in every]
        got = rows.groupBy(*keys, *identity).agg(*best, *differ, F.count_distinct("provider").alias("providers"))
        disputed = F.array_compact(F.array(*[F.when(F.col(f"_d_{f}"), F.lit(f)) for f in every]))
        return got.select(*keys, *identity, "providers", *[F.col(f"_{f}.value").alias(f) for f in every], *[F.col(f"_{f}.provider").alias(f"{f}_provider") for f in every], disputed.alias("disputed"))

    def enough(rows: DataFrame) -> DataFrame:
        gaps = put_together(rows).withColumn("_gaps", F.size(missing_fields(["status_short", *fields], when_finished)))
        return gaps.groupBy(*keys).agg(F.max("_gaps").alias("_most")).filter("_most = 0")

    rows, log = cascade(asked, [(name, lambda open_, found=found: found.join(open_, keys, "left_semi")) for name, found in tiers], keys, enough)
    return put_together(rows), log


def verdict(log: DataFrame, *keys: str) -> DataFrame:
    """Per key how its waterfall ended: the tiers read, rows read from all, and PRIMARY_SUCCESS, FALLBACK_SUCCESS, PARTIAL or NO_DATA."""
    per = log.groupBy(*keys).agg(F.max("tier").alias("_last"), F.sum("rows_read").alias("rows_read"), F.bool_or("enough").alias("_enough"), F.max_by("provider", "tier").alias("last_provider"))
    status = F.when(F.col("_enough") & (F.col("_last") == 0), "PRIMARY_SUCCESS").when(F.col("_enough"), "FALLBACK_SUCCESS").when(F.col("rows_read") > 0, "PARTIAL").otherwise("NO_DATA")
    return per.select(*keys, (F.col("_last") + 1).alias("tiers_read"), "rows_read", "last_provider", status.alias("resolver_status"))


# verdicts on payloads


def list_verdict(payload: Column, item: str, fit: Callable[[Column], Column]) -> Column:
    """struct<status, items> of a JSON list: items of shape ``item`` that are ``fit``; null or no list is a provider's error, a list without a fit item is malformed."""
    text = F.trim(payload)
    items = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))  # each item's text, whatever it is
    clean = F.filter(F.transform(items, lambda x: F.from_json(x, item)), lambda x: F.coalesce(fit(x), F.lit(False)))
    status = F.when(items.isNull(), ERROR).when(F.size(items) == 0, EMPTY).when(F.size(clean) == 0, MALFORMED).otherwise(DATA)
    return F.struct(status.alias("status"), F.coalesce(clean, F.array().cast(f"array<{item}>")).alias("items"))


def fixtures_verdict(payload: Column) -> Column:
    """A list of fixtures; a fit one has the objects fixture and teams."""
    return list_verdict(payload, "struct<fixture:struct<id:string,date:string>,teams:struct<home:struct<id:string>,away:struct<id:string>>>", lambda x: x["fixture"].isNotNull() & x["teams"].isNotNull())


def standings_verdict(payload: Column) -> Column:
    """A list of table rows; a fit one names its team."""
    return list_verdict(payload, "struct<team:struct<id:string,name:string>>", lambda x: x["team"]["name"] != "")


def statistics_suffice(payload: Column, least: int = 5) -> Column:
    """Whether a team's statistics rest on ``least`` matches or more and give goals for and against, as averages or totals."""
    side = "struct<average:struct<total:string>,total:struct<total:string>>"
    s = F.from_json(payload, f"struct<fixtures:struct<played:struct<total:string>>,goals:struct<for:{side},against:{side}>>")
    played = s["fixtures"]["played"]["total"].try_cast("int")
    says = lambda x: x["average"]["total"].isNotNull() | (x["total"]["total"].try_cast("double").isNotNull() & (played > 0))
    return F.coalesce((played >= least) & says(s["goals"]["for"]) & says(s["goals"]["against"]), F.lit(False))


def acquisition_suffices(rows: Column, partial: Column, complete: Column, verified: Column) -> Column:
    """Whether a provider's season may stand: it has rows, the provider doesn't call it partial or incomplete, and its structure is verified independently; that a provider calls it complete proves nothing."""
    return F.coalesce(rows > 0, F.lit(False)) & ~F.coalesce(partial, F.lit(False)) & F.coalesce(complete, F.lit(True)) & F.coalesce(verified, F.lit(False))
