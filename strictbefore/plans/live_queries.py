"""Streams over the stored events and matches, run to their end: ratings and a cache with state, live scores, replayed merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.plans.catalog import ORACLE_SQL, query
from strictbefore.plans.matches import MATCHES_SQL, matches, played
from strictbefore.plans.model_queries import GRID_SQL
from strictbefore.plans.stored_queries import SLIM, deliveries, merged_sql
from strictbefore.sources import commits, sinks
from strictbefore.streaming import live, stateful

#: After all rows of a table: what moves the watermark over its last ones.
THE_END = dt.datetime(9000, 1, 1)


def landed(rows: DataFrame, label: str, end: str | None = None) -> DataFrame:
    """A stream over ``rows``, written first; ``end`` names the time column of one more row that closes all windows."""
    spark = rows.sparkSession
    path = sinks.scratch(spark, label)
    rows.write.parquet(path)
    if end:
        spark.range(1).select(F.lit(THE_END).alias(end)).select(*[F.col(c) if c == end else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("streamed_ratings", ORACLE_SQL["elo_ratings"].replace("fixture_id, o.league_id, o.season, home_id, away_id, round", "fixture_id, o.league_id, o.season, round"))
def streamed_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings that a stream of all finished matches gives, equal to the fold over the stored ones."""
    found = played(matches(spark, sf_dir)).select("league_id", "season", F.col("kickoff_at").alias("ts"), "fixture_id", "home_id", "away_id", "home_goals", "away_goals")
    rated = live.live_ratings(landed(found, "finished", "ts"), "1 hour", ("league_id", "season"))
    got = stateful.drained(rated, sinks.scratch(spark, "rated"), sinks.scratch(spark, "rated-checkpoint"))
    return got.select("fixture_id", "league_id", "season", F.round("home_rating", 4).alias("home_rating"), F.round("away_rating", 4).alias("away_rating"))


@query(
    "cached_lookups",
    """WITH e AS (SELECT user_id % 16 AS key, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS put, props AS payload, CASE WHEN event_id % 11 > 0 THEN (event_id % 7 + 1) * 3600000000 END AS ttl FROM events),
    p AS (SELECT key, us, payload, ttl FROM e WHERE put),
    j AS (SELECT g.event_id, g.us, p.us AS fetched, p.payload, p.us IS NOT NULL AND (p.ttl IS NULL OR p.us + p.ttl >= g.us) AS hit FROM (SELECT * FROM e WHERE NOT put) g ASOF LEFT JOIN p ON g.key = p.key AND g.us > p.us)
    SELECT event_id AS id, hit, CASE WHEN hit THEN payload END AS payload, CASE WHEN hit THEN (us - fetched) // 1000 END AS age_ms FROM j""",
)
def cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases put what others then look up, for one to seven hours or, one in eleven, for ever."""
    k = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 16).alias("key"), F.col("ts").cast("timestamp").alias("ts"), k.alias("id"), (F.col("event_type") == "purchase").alias("put"), F.col("props").alias("payload"),
        F.when(k % 11 > 0, (k % 7 + 1) * 3_600_000).alias("ttl_ms"),
    )
    answers = stateful.cache_lookups(landed(events, "lookups", "ts"), "key")
    return stateful.drained(answers, sinks.scratch(spark, "answers"), sinks.scratch(spark, "answers-checkpoint"))


LIVE = ["home_win", "draw", "away_win", "home_or_draw", "away_or_draw", "home_or_away", "over_1_5", "under_1_5", "over_2_5", "under_2_5", "over_3_5", "under_3_5", "btts", "btts_no"]


def final(who: str) -> str:
    """A condition on final goals h and a in the SQL's grid."""
    return f"sum(p) FILTER ({who.replace('h', '(x + hg)').replace('a', '(y + ag)')})"


LIVE_SQL = {
    "home_win": final("h > a"), "draw": final("h = a"), "away_win": final("h < a"), "home_or_draw": final("h >= a"), "away_or_draw": final("h <= a"), "home_or_away": final("h <> a"),
    **{f"over_{n}_5": final(f"h + a > {n}") for n in (1, 2, 3)}, **{f"under_{n}_5": final(f"h + a <= {n}") for n in (1, 2, 3)},
    "btts": "any_value(yes)", "btts_no": "any_value(1 - yes)",
}


@query(
    "live_scored_events",
    f"""WITH {MATCHES_SQL}, s AS (
      SELECT fixture_id, k, CASE k WHEN 0 THEN NULL WHEN 1 THEN 45 ELSE (fixture_id % 96)::INT END AS elapsed, CASE k WHEN 0 THEN 'NS' WHEN 1 THEN 'HT' ELSE '2H' END AS status_short,
        CASE k WHEN 0 THEN 0 WHEN 1 THEN home_goals // 2 ELSE home_goals END AS hg, CASE k WHEN 0 THEN 0 WHEN 1 THEN away_goals // 2 ELSE away_goals END AS ag, 0.4e0 + home_id / 60e0 AS hx, 0.3e0 + away_id / 80e0 AS ax
      FROM played, range(3) AS r(k)),
    m AS (SELECT *, CASE WHEN k = 0 THEN 90 WHEN k = 1 THEN 45 ELSE greatest(90 - elapsed, 1) END AS minutes_left FROM s),
    rows AS (SELECT fixture_id * 3 + k AS fixture_id, hx * minutes_left / 90 AS home_xg, ax * minutes_left / 90 AS away_xg FROM m),
    {GRID_SQL.format(rows="rows")},
    b AS (SELECT *, (CASE WHEN hg >= 1 THEN 1 ELSE 1 - exp(-hx * minutes_left / 90) END) * (CASE WHEN ag >= 1 THEN 1 ELSE 1 - exp(-ax * minutes_left / 90) END) AS yes FROM m)
    SELECT b.fixture_id, k, any_value(minutes_left)::INT AS minutes_left, {", ".join(f"round(coalesce({LIVE_SQL[c]}, 0), 6) AS {c}" for c in LIVE)}
    FROM grid JOIN b ON grid.fixture_id = b.fixture_id * 3 + k GROUP BY b.fixture_id, k""",
)
def live_scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of every match, before it, at half time and later, as a stream against a table of expected goals in two versions."""
    found = played(matches(spark, sf_dir))
    parts = [F.struct(F.lit(k).alias("k"), e.cast("int").alias("elapsed"), F.lit(s).alias("status_short"), h.cast("int").alias("home_goals"), a.cast("int").alias("away_goals")) for k, e, s, h, a in (
        (0, F.lit(None), "NS", F.lit(0), F.lit(0)), (1, F.lit(45), "HT", F.floor(F.col("home_goals") / 2), F.floor(F.col("away_goals") / 2)), (2, F.col("fixture_id") % 96, "2H", F.col("home_goals"), F.col("away_goals")))]
    scores = found.select("fixture_id", F.explode(F.array(*parts)).alias("s")).select("fixture_id", "s.*")
    newer = found.select("fixture_id", (0.4 + F.col("home_id") / 60).alias("home_xg"), (0.3 + F.col("away_id") / 80).alias("away_xg"), F.lit(2).alias("version"))
    older = found.select("fixture_id", F.lit(9.0).alias("home_xg"), F.lit(9.0).alias("away_xg"), F.lit(1).alias("version"))
    out = live.scored(landed(scores, "scores"), older.unionByName(newer)).select("fixture_id", "k", F.col("minutes_left").cast("int").alias("minutes_left"), *LIVE)
    got = stateful.drained(out, sinks.scratch(spark, "scored"), sinks.scratch(spark, "scored-checkpoint"))
    return got.select("fixture_id", "k", "minutes_left", *[F.round(c, 6).alias(c) for c in LIVE])


def in_seasons(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    seasons = matches(spark, sf_dir).select("fixture_id", "season")
    return [rows.join(seasons, "fixture_id").withColumn("sent", F.lit(k)) for k, rows in enumerate(deliveries(spark, sf_dir))]


@query("replayed_merges", merged_sql("b", "a"))
def replayed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries stream into a table by season; the second batch comes again, as after a crash before its checkpoint, and changes nothing."""
    first, later = in_seasons(spark, sf_dir)
    path, source, checkpoint = (sinks.scratch(spark, n) for n in ("merges", "deliveries", "merges-checkpoint"))
    for rows in (first, later):
        rows.write.mode("append").parquet(source)
        commits.merge_stream(spark.readStream.schema(rows.schema).parquet(source), path, ["fixture_id"], "season", "sent", checkpoint).awaitTermination()
    before = commits.manifest(spark, path)
    _, found = before
    wrong = later.withColumn("home_goals", F.lit(99).cast("long"))
    commits.merge(wrong.select(*first.columns), path, ["fixture_id"], "season", batch=(checkpoint, found["batches"][checkpoint]))
    if commits.manifest(spark, path) != before:
        raise AssertionError("a replayed batch changed the table")
    return commits.read(spark, path).select(*SLIM)


@query(
    "touched_partitions",
    f"""WITH {MATCHES_SQL}, c AS (SELECT season, count(*) AS n, count(*) FILTER (season % 2 = 0 AND status_short <> 'NS') AS later FROM matches GROUP BY season)
    SELECT season, n, later > 0 AS rewritten FROM c""",
)
def touched_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which seasons' files a merge replaced, and how many rows the season has after it: those it had rows of."""
    first, later = in_seasons(spark, sf_dir)
    path = sinks.scratch(spark, "seasons")
    commits.merge(first, path, ["fixture_id"], "season")
    before = commits.manifest(spark, path)[1]["parts"]
    commits.merge(later.filter("season % 2 = 0"), path, ["fixture_id"], "season")
    after = commits.manifest(spark, path)[1]["parts"]
    changed = spark.createDataFrame([(int(s), before[s] != after[s]) for s in after], "season int, rewritten boolean")
    return commits.read(spark, path).groupBy("season").agg(F.count("*").alias("n")).join(F.broadcast(changed), "season").select("season", "n", "rewritten")
