"""Point-in-time features: what was known strictly before each match.

Frames are RANGE frames that end one microsecond before the row's instant, so matches at the same instant, the row's
own included, never count. Counts and sums of goals are integers; averages are taken once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lengths of the form and meetings windows.
FORM, MEETINGS = 8, 6


def before(*keys: str):
    """All rows of the keys at instants before the row's own."""
    return Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)


def team_averages(rows: DataFrame, *cohort: str) -> DataFrame:
    """Per team row: matches played before, mean goals for and against; null where there are none."""
    w = before(*cohort, "team_id")
    return rows.select("fixture_id", "ts", *cohort, "team_id", F.count("*").over(w).alias("prior_matches"), F.avg("gf").over(w).alias("avg_for"), F.avg("ga").over(w).alias("avg_against"))


def cards_per_match(rows: DataFrame, *cohort: str) -> DataFrame:
    """Per team row (ts, team_id, yellow, and more): mean yellow cards over the team's earlier matches that have a figure, and how many these are; null where there are none."""
    w = before(*cohort, "team_id")
    others = [c for c in rows.columns if c not in ("ts", "yellow")]
    return rows.select(*others, F.avg("yellow").over(w).alias("avg_cards"), F.count("yellow").over(w).alias("prior_matches"))


def league_average(found: DataFrame, *cohort: str) -> DataFrame:
    """Per match: mean goals per team of the cohort's earlier matches.

    A cohort is one league or league-season, so goals are summed per instant first and the frame runs over instants.
    """
    instants = found.groupBy(*cohort, "ts").agg(F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"), F.count("*").alias("n"))
    w = before(*cohort)
    prior = instants.select(*cohort, "ts", F.sum("goals").over(w).alias("goals"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("prior_matches"))
    per = prior.withColumn("league_avg", F.try_divide(F.col("goals"), 2 * F.col("prior_matches"))).drop("goals")
    return found.join(per, [*cohort, "ts"]).select("fixture_id", *cohort, "prior_matches", "league_avg")


def with_league_average(found: DataFrame, *cohort: str) -> DataFrame:
    """Matches with league_average()'s league_avg beside all their columns."""
    instants = found.groupBy(*cohort, "ts").agg(F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"), F.count("*").alias("n"))
    w = before(*cohort)
    prior = instants.select(*cohort, "ts", F.try_divide(F.sum("goals").over(w), 2 * F.sum("n").over(w)).alias("league_avg"))
    return found.join(prior, [*cohort, "ts"])


def last_before(rows: DataFrame, keys: list[str], n: int, values: list[str]) -> DataFrame:
    """Each row with ``last``: its n latest predecessors strictly before, oldest first, as structs of ``values``.

    Rows of one instant are grouped first, the last n of them; the n instants before an instant hold its predecessors. One
    shuffle by the keys serves the grouping, the frame and the rows that go out.
    """
    entry = F.struct("fixture_id", *values)
    per = rows.repartition(*keys).groupBy(*keys, "ts").agg(F.array_sort(F.collect_list(entry)).alias("_own"), F.collect_list(F.struct(*[c for c in rows.columns if c not in (*keys, "ts")])).alias("_rows"))
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-n, -1)
    cut = F.slice("_own", F.greatest(F.size("_own") - n, F.lit(0)) + 1, n)
    past = F.flatten(F.collect_list(cut).over(w))
    got = per.withColumn("last", past).select(*keys, "ts", F.explode("_rows").alias("_r"), F.slice("last", F.greatest(F.size("last") - n, F.lit(0)) + 1, n).alias("last"))
    return got.select(*keys, "ts", "_r.*", F.when(F.size("last") > 0, F.col("last")).alias("last")).withColumn("available", F.coalesce(F.size("last"), F.lit(0)))


def recent_form(rows: DataFrame, *cohort: str, window: int = FORM) -> DataFrame:
    """Per team row: wins, draws, losses, points and goals of its last ``window`` matches, and the sequence oldest first."""
    got = last_before(rows, [*cohort, "team_id"], window, ["gf", "ga"])
    total = lambda f: F.coalesce(F.aggregate("last", F.lit(0).cast("long"), lambda acc, m: acc + f(m)), F.lit(0))
    won, drawn = lambda m: (m["gf"] > m["ga"]).cast("long"), lambda m: (m["gf"] == m["ga"]).cast("long")
    letter = F.transform("last", lambda m: F.when(m["gf"] > m["ga"], "W").when(m["gf"] == m["ga"], "D").otherwise("L"))
    out = got.select(
        "fixture_id", *cohort, "team_id", F.col("available").cast("long").alias("matches"), total(won).alias("wins"), total(drawn).alias("draws"),
        total(lambda m: (m["gf"] < m["ga"]).cast("long")).alias("losses"), total(lambda m: m["gf"]).alias("goals_for"), total(lambda m: m["ga"]).alias("goals_against"),
        F.coalesce(F.array_join(letter, ""), F.lit("")).alias("sequence"),
    )
    points = 3 * F.col("wins") + F.col("draws")
    return out.withColumn("points", points).withColumn("points_per_match", F.try_divide(points, F.col("matches")))


def head_to_head(found: DataFrame, window: int = MEETINGS) -> DataFrame:
    """Per match: the pair's last meetings at either ground, seen from this match's home team."""
    pair = found.withColumn("low", F.least("home_id", "away_id")).withColumn("high", F.greatest("home_id", "away_id"))
    slim = pair.select("fixture_id", "ts", "league_id", "low", "high", "home_id", "home_goals", "away_goals")
    got = last_before(slim, ["low", "high"], window, ["home_id", "home_goals", "away_goals"])
    own = lambda m: F.when(m["home_id"] == F.col("home_id"), m["home_goals"]).otherwise(m["away_goals"])
    other = lambda m: F.when(m["home_id"] == F.col("home_id"), m["away_goals"]).otherwise(m["home_goals"])
    total = lambda f: F.coalesce(F.aggregate("last", F.lit(0).cast("long"), lambda acc, m: acc + f(m).cast("long")), F.lit(0))
    rate = lambda f: F.try_divide(total(f), F.col("available"))
    return got.select(
        "fixture_id", F.col("available").cast("long").alias("meetings"), total(lambda m: own(m) > other(m)).alias("home_wins"), total(lambda m: own(m) == other(m)).alias("draws"),
        total(lambda m: own(m) < other(m)).alias("away_wins"), F.try_divide(total(own), F.col("available")).alias("avg_for"), F.try_divide(total(other), F.col("available")).alias("avg_against"),
        rate(lambda m: (m["home_goals"] > 0) & (m["away_goals"] > 0)).alias("btts_rate"),
        *[rate(lambda m, line=line: m["home_goals"] + m["away_goals"] > line).alias(f"over_{line:.1f}".replace(".", "_")) for line in (1.5, 2.5, 3.5)],
    )


def both_sides(found: DataFrame, per_team: DataFrame, values: list[str], *cohort: str) -> DataFrame:
    """A match with its home and its away team's values: home_<value>, away_<value>."""
    side = lambda name: per_team.select(F.col("fixture_id"), F.col("team_id").alias(f"{name}_id"), *[F.col(v).alias(f"{name}_{v}") for v in values])
    return found.join(side("home"), ["fixture_id", "home_id"]).join(side("away"), ["fixture_id", "away_id"])


def has_history(home: Column, away: Column, minimum: int) -> Column:
    return F.coalesce((home >= minimum) & (away >= minimum), F.lit(False))


def team_records(rows: DataFrame, *cohort: str) -> DataFrame:
    """Per team row what the team had done before: matches, goals for and against, matches and goals at home."""
    w = before(*cohort, "team_id")
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    at_home = F.col("at_home").cast("long")
    return rows.select(
        "fixture_id", *cohort, "team_id", F.count("*").over(w).alias("matches"), total(F.col("gf")).alias("goals_for"), total(F.col("ga")).alias("goals_against"), total(at_home).alias("at_home"), total(F.col("gf") * at_home).alias("goals_at_home")
    )
