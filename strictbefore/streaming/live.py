"""Streams: event-time windows, late and repeated rows, sessions, and ratings that follow matches as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictbefore.functions import model
from strictbefore.functions.time import remaining_minutes
from strictbefore.operators.reconcile import keep_first
from strictbefore.streaming.stateful import live_ratings

__all__ = ["live_ratings", "scored", "sessions", "windowed_counts", "without_repeats"]
#: Fixtures whose expected goals are sent to all tasks; more of them meet the stream by a shuffle.
BROADCAST_ROWS = 500_000


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and values per event-time window and type; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """A user's events without a longer pause."""
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, whatever the source delivers twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def scored(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """The markets of each score (fixture_id, elapsed, status_short, home_goals, away_goals, and more) of a stream.

    ``expected`` is a stored table (fixture_id, home_xg, away_xg, version) of which the newest version of a fixture counts. Nothing is kept by key: a
    score is joined with that table as it stood when the stream was started, and scored by itself. Scores of unknown fixtures have no markets.
    """
    newest = keep_first(expected, ["fixture_id"], F.desc("version")).select("fixture_id", F.col("home_xg").alias("_home"), F.col("away_xg").alias("_away"))
    newest = F.broadcast(newest) if newest.count() <= BROADCAST_ROWS else newest.hint("merge")
    left = remaining_minutes(F.col("elapsed"), F.col("status_short"))
    rows = scores.join(newest, "fixture_id").withColumn("minutes_left", left)
    rows = rows.withColumns({"home_to_come": F.col("_home") * F.col("minutes_left") / 90, "away_to_come": F.col("_away") * F.col("minutes_left") / 90}).drop("_home", "_away")
    to_come = F.col("home_to_come"), F.col("away_to_come")
    markets = model.live_markets(*to_come, F.col("home_goals"), F.col("away_goals"))
    return model.with_outlook(rows, *to_come).withColumns(markets).drop(model.MARGINS, model.TOTALS)
