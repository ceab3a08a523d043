"""Names and labels as Column expressions; the one score without a SQL form is an Arrow-batched function."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Noise words, suffixes.
NOISE = ("fc", "cf", "afc", "sc", "club")
SUFFIXES = (" fc", " afc", " cf", " sc", " bc", " basketball", " football club")
NOT_SENIOR = ("u18", "u19", "u20", "u21", "u23", "youth", "reserve", "women", "ladies", "academy", "friendly")
NATIONAL = ("national team", "football team", "national", "team")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without(tokens: Column, noise: tuple[str, ...]) -> Column:
    """The tokens that aren't noise; all of them if nothing else is left."""
    left = F.filter(tokens, lambda w: ~w.isin(*noise))
    return F.when(F.size(left) > 0, left).otherwise(tokens)


@functools.cache
def folding() -> tuple[str, str]:
    """Characters and what they stand for once compatibility forms are decomposed and combining marks are gone; those beyond the second text's end go.

    Made from the character database: every character whose decomposition without marks is one character. The few that
    decompose into several, ligatures and the like, are in LIGATURES.
    """
    one, to, gone = [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        if unicodedata.combining(c):
            gone.append(c)
        elif len(plain := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and plain != c:
            one.append(c)
            to.append(plain)
    return "".join(one + gone), "".join(to)


#: Letters that decompose into several, by what they stand for.
LIGATURES = {x: unicodedata.normalize("NFKD", x) for x in "ﬀﬁﬂﬃﬄﬅﬆĲĳŉǄǅǆǇǈǉǊǋǌ№™½¼¾…"}


def without_marks(text: Column) -> Column:
    """Compatibility forms decomposed, combining marks gone."""
    out = F.translate(text, *folding())
    ligature = text.rlike("[" + "".join(LIGATURES) + "]")
    spelt = out
    for old, new in LIGATURES.items():
        spelt = F.replace(spelt, F.lit(old), F.lit("".join(c for c in new if not unicodedata.combining(c))))
    return F.when(ligature, spelt).otherwise(out)


def fold(text: Column) -> Column:
    """Lower case without accents, full width and other compatibility forms."""
    return F.lower(without_marks(text))


def team_name(text: Column) -> Column:
    """A club's name for comparison: folded, ``&`` spelt out, punctuation and club marks gone; empty for null and blank."""
    plain = F.replace(F.replace(fold(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" ")), F.lit("&"), F.lit(" and "))
    return F.array_join(without(words(F.regexp_replace(plain, r"[^\p{L}\p{N}\s_]", " ")), NOISE), " ")


def slug(text: Column) -> Column:
    name = team_name(text)
    return F.when(name == "", "unknown").otherwise(F.replace(name, F.lit(" "), F.lit("_")))


def national_name(text: Column) -> Column:
    """A national side's name without the words that say so, one suffix only."""
    return F.trim(F.regexp_replace(team_name(text), " (" + "|".join(NATIONAL) + ")$", ""))


def odds_name(text: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    for old, new in (("&", "and"), (".", " "), (",", " "), ("'", ""), ("-", " "), ("_", " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.array_join(words(plain), " ")


def same_odds_name(a: Column, b: Column) -> Column:
    """Equal names, or names that differ by one club suffix."""
    x, y = odds_name(a), odds_name(b)
    same = x == y
    for suffix in SUFFIXES:
        same = same | (y == F.concat(x, F.lit(suffix))) | (x == F.concat(y, F.lit(suffix)))
    return (x != "") & (y != "") & same


def market_category(label: Column) -> Column:
    """The market that a label speaks of; the first rule that applies."""
    low = F.lower(label)
    has = lambda *xs: F.greatest(*[low.contains(x) for x in (*xs, xs[0])])
    side = F.when(has("home over", "home under", "away over", "away under"), "team_goals").otherwise("over_under")
    pair = F.when(has("home or", "away or", "home_or", "away_or"), "double_chance").otherwise("match_result")
    win = F.when(has("home win", "away win", "draw") | low.isin("home_win", "draw", "away_win"), "match_result").otherwise("moneyline")
    return (
        F.when(has("btts"), "btts").when(has("cards"), "cards").when(has("over", "under"), side)
        .when(has("draw", "or"), pair).when(has("win", "home", "away"), win).when(has("points"), "total_points").otherwise("other")
    )


def goal_market(key: Column) -> Column:
    """struct<side, direction, line> of keys such as over_2_5 and home_over_1_5; null for others."""
    part = lambda i: F.regexp_extract(key, r"^(?:(home|away)_)?(over|under)_(\d+)_(\d+)$", i)
    line = F.concat(part(3), F.lit("."), part(4)).try_cast("double")
    return F.when(part(2) != "", F.struct(F.when(part(1) != "", part(1)).otherwise("total").alias("side"), part(2).alias("direction"), line.alias("line")))


def made_attempted(text: Column) -> Column:
    """struct<made, attempted> of ``7-15``."""
    half = lambda i: F.regexp_extract(F.trim(text), r"^(\d+)-(\d+)$", i).try_cast("int")
    return F.when(half(1).isNotNull(), F.struct(half(1).alias("made"), half(2).alias("attempted")))


def uid_parts(text: Column) -> Column:
    """map of ``s:40~l:46~e:401``."""
    return F.str_to_map(text, F.lit("~"), F.lit(":"))


def stable_id(prefix: str, value: Column) -> Column:
    """A 32-bit id from a text, the same everywhere."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{prefix}:"), value), 256), 1, 8), 16, 10).cast("long")


def synthetic_fixture_key(provider: Column, home: Column, away: Column, day: Column, league: Column, season: Column) -> Column:
    parts = [F.lower(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(" "), F.lit("_"))) for c in (provider, league, season, home, away, day)]
    return F.concat_ws(":", *parts)


def clean_number(text: Column) -> Column:
    """A non-negative number, a percent sign allowed."""
    number = F.replace(F.trim(text), F.lit("%"), F.lit("")).try_cast("double")
    return F.when(number >= 0, number)


def side_kind(name: Column) -> Column:
    """What marks a side as not the first team, in order and joined by commas; empty for a first team."""
    low = fold(name)
    marks = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in NOT_SENIOR]))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"u\d{2}"), F.lit(0)), marks))), ",")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; use it on pairs that an equality has brought together."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_score(a: Column, b: Column) -> Column:
    """Agreement of two names in tiers: equal, contained, a long word or stem in common, close words, else the ratio."""
    x, y = fold(F.trim(a)), fold(F.trim(b))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    short = F.when(F.length(tight(x)) <= F.length(tight(y)), tight(x)).otherwise(tight(y))
    long = F.when(F.length(tight(x)) <= F.length(tight(y)), tight(y)).otherwise(tight(x))
    long_words = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    stem = F.exists(long_words(x), lambda p: F.exists(long_words(y), lambda q: _stem(p, q)))
    close = _close_words(F.array_join(long_words(x), " "), F.array_join(long_words(y), " "))
    return (
        F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0)
        .when((F.length(short) >= 3) & long.contains(short), 0.95).when(F.arrays_overlap(long_words(x), long_words(y)), 0.85)
        .when(stem, 0.85).when(close, 0.80).otherwise(ratio(x, y))
    )


def _stem(p: Column, q: Column) -> Column:
    same = lambda n: (F.length(p) >= n) & (F.length(q) >= n) & (F.substring(p, 1, n) == F.substring(q, 1, n))
    return same(5) | (same(4) & (F.abs(F.length(p) - F.length(q)) >= 3))


@F.pandas_udf(T.BooleanType())
def _close_words(a: pd.Series, b: pd.Series) -> pd.Series:
    def close(x, y):
        return any(min(len(p), len(q)) >= 5 and difflib.SequenceMatcher(None, p, q).ratio() >= 0.72 for p in (x or "").split() for q in (y or "").split())

    return pd.Series([close(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


def pair_similarity(home_a: Column, away_a: Column, home_b: Column, away_b: Column) -> Column:
    """How alike two pairs of names are, in the better of both orders."""
    n = team_name
    forward = (ratio(n(home_a), n(home_b)) + ratio(n(away_a), n(away_b))) / 2
    reverse = (ratio(n(home_a), n(away_b)) + ratio(n(away_a), n(home_b))) / 2
    return F.greatest(forward, reverse)


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


# Number words, and what may stand before or after a quantity.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
ASKING, ASKED = "top|give|show|find|get|pick|list|sample", "predictions?|picks?|tips?|games?|matches?|fixtures?"
MOST_ASKED = 500


def quantity(text: Column, default: int = 1) -> Column:
    """How many a text asks for: a number beside a word that asks, a number word, or any number of two digits; days are no quantities."""
    plain = F.regexp_replace(normal_text(F.coalesce(text, F.lit(""))), r"\b\d{4}-\d{2}-\d{2}\b", " ")
    found = lambda pattern: F.regexp_extract(plain, pattern, 1).try_cast("int")
    positive = lambda n: F.when(n > 0, F.least(n, F.lit(MOST_ASKED)))
    beside = [found(rf"\b(?:{ASKING})\s+(\d{{1,3}})\b"), found(rf"\b(\d{{1,3}})\s+(?:{ASKED}|sample)\b"), found(rf"\b(?:{ASKED})\s+(\d{{1,3}})\b")]
    words = F.array(*map(F.lit, NUMBER_WORDS))
    word = F.get(F.filter(F.transform(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), lambda w: F.array_position(words, w)), lambda n: n > 0), F.lit(0)).cast("int")
    return F.coalesce(*map(positive, beside), word, positive(found(r"\b(\d{1,2})\b")), F.lit(default))
