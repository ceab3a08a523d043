"""Bringing records of the same thing together: band joins, unique best matches, field-level reconciliation and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.functions import text


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int = 1) -> DataFrame:
    """Pairs that agree on the keys and whose days differ by at most ``days``: the left side names every day it accepts.

    That makes the range an equality, so the join hashes on keys and day; columns of ``right`` get the prefix ``r_``.
    """
    offsets = F.array(*[F.date_add(F.col(left_day), d) for d in range(-days, days + 1)])
    asked = left.withColumn("_day", F.explode(offsets))
    other = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    same = F.col("_day") == F.col(f"r_{right_day}")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    return asked.join(other, same).drop("_day")


def unique_best(pairs: DataFrame, key: str, score: Column, least: float | None = None) -> DataFrame:
    """Per key the pair of highest score, if no other pair reaches it: ties are rejected, not guessed."""
    scored = pairs.withColumn("_score", score)
    if least is not None:
        scored = scored.filter(F.col("_score") >= least)
    w = Window.partitionBy(key)
    top = scored.withColumn("_top", F.max("_score").over(w)).filter("_score = _top")
    return top.withColumn("_ties", F.count("*").over(w)).filter("_ties = 1").drop("_score", "_top", "_ties")


def best_names(left: DataFrame, right: DataFrame, cohort: str, left_name: str, right_name: str, least: float = 0.85) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` in their cohort whose name scores best, if at least ``least`` and no other row reaches it.

    Distinct names meet by equality: one is a substring of the other (three letters or more) or equals it, or they share
    the first four letters of a word, as equal words and stems do. These are all tiers of name_score() from 0.85 up; the
    ratio alone, which no equality finds, makes no pair. Rows join by their name's one match, so common names don't multiply.
    """
    tight = lambda c: F.replace(text.fold(F.trim(c)), F.lit(" "), F.lit(""))
    starts = lambda c: F.array_distinct(F.transform(F.filter(F.split(text.fold(F.trim(c)), "[^a-z0-9]+"), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))
    cuts = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.length(c) - i + 1, F.lit(3))), lambda n: F.substr(c, i, n)))))

    def keys(side: DataFrame, *offers: tuple[str, Column]) -> DataFrame:
        marked = F.concat(*[F.transform(values, lambda v, m=mark: F.concat(F.lit(m), v)) for mark, values in offers])
        return side.withColumn("_key", F.explode(F.array_distinct(marked)))

    a = left.filter(F.col(left_name).isNotNull()).select(F.col(cohort).alias("_cohort"), F.col(left_name).alias("_a")).distinct()
    b = right.filter(F.col(right_name).isNotNull()).groupBy(F.col(cohort).alias("_cohort"), F.col(right_name).alias("_b")).agg(F.count("*").alias("_rows"))
    x, y = tight(F.col("_a")), tight(F.col("_b"))
    offered = keys(a, ("w", starts(F.col("_a"))), ("l", F.array(x)), ("r", F.concat(cuts(x), F.array(x))))
    asked = keys(b, ("w", starts(F.col("_b"))), ("r", F.array(y)), ("l", F.concat(cuts(y), F.array(y))))
    pairs = offered.join(asked, ["_cohort", "_key"]).select("_cohort", "_a", "_b", "_rows").distinct()
    scored = pairs.withColumn("score", text.name_score(F.col("_a"), F.col("_b"))).withColumn("_name", F.struct("_cohort", "_a"))
    best = unique_best(scored, "_name", F.col("score"), least).filter("_rows = 1").select("_cohort", "_a", "_b", "score")
    own = left.join(best, (F.col(cohort) == F.col("_cohort")) & (F.col(left_name) == F.col("_a"))).drop("_cohort", "_a")
    other = right.withColumnRenamed(cohort, "_cohort")
    return own.join(other, (F.col(cohort) == F.col("_cohort")) & (F.col("_b") == F.col(right_name))).drop("_cohort", "_b")


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left and right appear in no other pair."""
    a, b = Window.partitionBy(left), Window.partitionBy(right)
    return pairs.withColumn("_a", F.count("*").over(a)).withColumn("_b", F.count("*").over(b)).filter("_a = 1 and _b = 1").drop("_a", "_b")


def first_of_sources(rows: DataFrame, key: str, source: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per key: each field from the first source that has it, with that source's name; disputes where sources differ.

    A map-side combined aggregate: minima of (place, value), so no group is collected.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(source)).cast("int")
    rows = rows.withColumn("_place", F.when(place > 0, place).otherwise(len(order) + 1))
    aggs = []
    for f in fields:
        present = F.when(F.col(f).isNotNull(), F.struct("_place", F.col(source).alias("source"), F.col(f).alias("value")))
        aggs += [F.min(present).alias(f"_{f}"), (F.min(f) != F.max(f)).alias(f"{f}_disputed")]
    got = rows.groupBy(key).agg(*aggs)
    cols = [c for f in fields for c in (F.col(f"_{f}.value").alias(f), F.col(f"_{f}.source").alias(f"{f}_source"), F.coalesce(f"{f}_disputed", F.lit(False)).alias(f"{f}_disputed"))]
    return got.select(key, *cols)


def merge(old: DataFrame, new: DataFrame, keys: list[str], new_wins: bool = True) -> DataFrame:
    """Old and new rows by key, each field from the winning side unless that is null; conflicts lists fields that differ."""
    fields = [c for c in old.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = new.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(f).alias(f"_b_{f}") for f in fields])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    joined = a.join(b, same, "full_outer")
    first, second = ("_b_", "_a_") if new_wins else ("_a_", "_b_")
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_a_{f}") != F.col(f"_b_{f}"), F.lit(f)) for f in fields]))
    return joined.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], *[F.coalesce(f"{first}{f}", f"{second}{f}").alias(f) for f in fields], conflicts.alias("conflicts")
    )


def keep_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def as_of(facts: DataFrame, dimension: DataFrame, key: str, at: str, valid_from: str) -> DataFrame:
    """Each fact with its dimension row as it stood strictly before, columns prefixed ``d_``; of versions of one instant the greatest counts.

    Facts and versions stand in one ordered window, facts first at an instant, so that a fact sees the last version before it: a
    hot key costs a sort, not a comparison of all its facts with all its versions.
    """
    others = [c for c in dimension.columns if c != key]
    version = F.struct(*[F.col(c) for c in (valid_from, *[c for c in others if c != valid_from])])
    left = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(dimension.select(version).schema[0].dataType).alias("_version"))
    right = dimension.select(F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), version.alias("_version"))
    w = Window.partitionBy("_key").orderBy("_at", "_kind", "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = left.unionByName(right).withColumn("_last", F.last("_version", ignorenulls=True).over(w)).filter("_kind = 0")
    # a null key or instant has no version
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return got.select("_fact.*", *[F.when(known, F.col("_last")[c]).alias(f"d_{c}") for c in others])


def fill_forward(rows: DataFrame, cohort: list[str], order: str | list[str], *cols: str) -> DataFrame:
    """Nulls replaced by the last value before them; ``order`` names the rows' order, a unique column last."""
    w = Window.partitionBy(*cohort).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def midnight_twins(rows: DataFrame, least: float) -> DataFrame:
    """Fixtures stored at midnight, with the kickoff of their one twin: same league, season and day, names alike enough.

    fixture_id, twin_id, kickoff_at; two candidates or none leave a fixture as it is. Pairs meet by league, season and day.
    """
    from strictbefore.functions.text import pair_similarity
    from strictbefore.functions.time import is_midnight

    slim = rows.select("fixture_id", "league_id", "season", F.to_date("kickoff_at").alias("day"), "kickoff_at", "home_team", "away_team")
    bare = slim.filter(is_midnight(F.col("kickoff_at"))).drop("kickoff_at")
    full = slim.filter(~is_midnight(F.col("kickoff_at"))).select("league_id", "season", "day", F.col("fixture_id").alias("twin_id"), "kickoff_at", F.col("home_team").alias("_h"), F.col("away_team").alias("_a"))
    pairs = bare.join(full, ["league_id", "season", "day"]).filter(pair_similarity(F.col("home_team"), F.col("away_team"), F.col("_h"), F.col("_a")) >= least)
    w = Window.partitionBy("fixture_id")
    return pairs.withColumn("_n", F.count("*").over(w)).filter("_n = 1").select("fixture_id", "twin_id", "kickoff_at")


def strict_matches(left: DataFrame, right: DataFrame, with_day: bool = True) -> DataFrame:
    """Pairs (left_id, right_id) of two providers' fixtures that agree on sport, league, season, day and both sides' canonical ids in their roles.

    Provider ids play no part, and a fixture without one of these matches nothing; without the day a pair may meet more than once.
    """
    keys = ["sport", "league_id", "season", *(["day"] if with_day else []), "canonical_home_id", "canonical_away_id"]
    side = lambda df, name: df.select(F.col("fixture_id").alias(name), *keys)
    return side(left, "left_id").join(side(right, "right_id"), keys).select("left_id", "right_id")


def provenance_only(rows: DataFrame, key: str, sources: list[str], fields: list[str], peer_field: str) -> DataFrame:
    """Rows of the given sources that say nothing themselves, all fields null, while a row of the same key has ``peer_field``."""
    empty = F.col("source").isin(*sources)
    for f in fields:
        empty = empty & F.col(f).isNull()
    peers = rows.filter(F.col(peer_field).isNotNull()).select(key).distinct()
    return rows.filter(empty).join(peers, key, "left_semi")
