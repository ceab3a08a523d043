"""Timestamps: strict UTC parsing, strictly-before, dates, season windows and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a timestamp text must end with: a zone. Naive texts are rejected, not guessed.
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_utc(text: Column) -> Column:
    """An ISO-8601 text with a zone as a timestamp; null for anything else."""
    trimmed = F.trim(text)
    shaped = trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}" + r".*" + ZONE)
    return F.when(shaped, F.try_to_timestamp(trimmed))


def strictly_before(at: Column, cutoff: Column) -> Column:
    """False when either side is missing."""
    return F.coalesce(at < cutoff, F.lit(False))


def format_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def kickoff_date(text: Column) -> Column:
    """The UTC date of a kickoff text, or its first ten characters where it has no zone."""
    return F.coalesce(F.to_date(parse_utc(text)), F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd"))


def parse_date(text: Column) -> Column:
    """A date written day first with a two- or four-digit year, or year first."""
    t = F.trim(text)
    return F.coalesce(
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(t, "d/M/yy")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
    )


def is_midnight(at: Column) -> Column:
    return F.date_format(at, "HH:mm") == "00:00"


def season_of(day: Column, first_month: int = 7) -> Column:
    """The year in which a season that starts in ``first_month`` began."""
    return F.year(day) - (F.month(day) < first_month).cast("int")


def season_code(season: Column) -> Column:
    """2024 -> 2425."""
    return F.concat(F.lpad(F.pmod(season, F.lit(100)).cast("string"), 2, "0"), F.lpad(F.pmod(season + 1, F.lit(100)).cast("string"), 2, "0"))


def season_start(label: Column) -> Column:
    """The first year of a label such as 2024, 2024/25, 2024-25 or 2024-2025; null for others, and where the years don't follow."""
    first = F.regexp_extract(F.trim(label), r"^(\d{4})(?:[/-](\d{2}|\d{4}))?$", 1)
    second = F.regexp_extract(F.trim(label), r"^(\d{4})(?:[/-](\d{2}|\d{4}))?$", 2)
    start = F.when(first != "", first.cast("int"))
    follows = (second == "") | (second.try_cast("int") == F.when(F.length(second) == 2, F.pmod(start + 1, F.lit(100))).otherwise(start + 1))
    return F.when(follows, start)


def season_window(season: Column, start: tuple[int, int, int], end: tuple[int, int, int]) -> tuple[Column, Column]:
    """First and last day from (year offset, month, day)."""
    return tuple(F.make_date(season + offset, F.lit(month), F.lit(day)) for offset, month, day in (start, end))


def season_months(season: Column, first_month: int = 10, months: int = 9) -> Column:
    """First days of a season's months."""
    first = F.make_date(season, F.lit(first_month), F.lit(1))
    return F.sequence(first, F.add_months(first, months - 1), F.expr("interval 1 month"))


def remaining_minutes(elapsed: Column, status: Column) -> Column:
    """45 at half time, 90 before a minute is known, otherwise what is left, 1 at least."""
    return F.when(status == "HT", F.lit(45)).when(elapsed.isNull(), F.lit(90)).otherwise(F.greatest(F.lit(90) - elapsed, F.lit(1)))


def parse_loose(text: Column) -> Column:
    """struct<at, precision>: a text without a zone counts as UTC, a bare day as its midnight; precision is day or minute. Null for anything else."""
    t = F.trim(text)
    bare = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    naive = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    at = F.coalesce(parse_utc(t), F.when(bare | naive, F.try_to_timestamp(F.concat(t, F.when(bare, "T00:00:00Z").otherwise("Z")))))
    return F.when(at.isNotNull(), F.struct(at.alias("at"), F.when(bare, "day").otherwise("minute").alias("precision")))
