"""Basketball summaries, one JSON document a line: team rows, points by period and player rows.

A summary without a usable team block yields nothing. The final score stands in the header, not among the statistics, and fills a team's points where those lack
them. Players' figures are a list of values beside a list of keys that may be longer or shorter; what has no key, or a key nobody knows, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The provider's names of team and player figures, and the columns they fill; a name with two columns holds "made-attempted".
TEAM = {
    "points": ("points",), "fieldGoalsMade-fieldGoalsAttempted": ("field_goals_made", "field_goals_attempted"), "fieldGoalPct": ("field_goal_pct",),
    "threePointFieldGoalsMade-threePointFieldGoalsAttempted": ("three_point_made", "three_point_attempted"), "threePointFieldGoalPct": ("three_point_pct",),
    "freeThrowsMade-freeThrowsAttempted": ("free_throws_made", "free_throws_attempted"), "freeThrowPct": ("free_throw_pct",), "offensiveRebounds": ("offensive_rebounds",), "defensiveRebounds": ("defensive_rebounds",),
    "totalRebounds": ("total_rebounds",), "assists": ("assists",), "steals": ("steals",), "blocks": ("blocks",), "turnovers": ("turnovers",), "fouls": ("personal_fouls",),
}
PLAYER = {
    "minutes": ("minutes",), "points": ("points",), "fieldGoalsMade-fieldGoalsAttempted": ("field_goals_made", "field_goals_attempted"), "threePointFieldGoalsMade-threePointFieldGoalsAttempted": ("three_point_made", "three_point_attempted"),
    "freeThrowsMade-freeThrowsAttempted": ("free_throws_made", "free_throws_attempted"), "rebounds": ("total_rebounds",), "assists": ("assists",), "turnovers": ("turnovers",), "steals": ("steals",), "blocks": ("blocks",), "fouls": ("personal_fouls",), "plusMinus": ("plus_minus",),
}
REGULAR_PERIODS = 4

FIGURE = "struct<name:string,displayValue:string,value:string>"
TEAM_BLOCK = f"struct<homeAway:string,team:struct<id:string,displayName:string>,statistics:array<{FIGURE}>>"
ATHLETE = "struct<id:string,athlete:struct<id:string,displayName:string>,starter:boolean,didNotPlay:boolean,stats:array<string>>"
PLAYERS = f"struct<team:struct<id:string>,statistics:array<struct<keys:array<string>,athletes:array<{ATHLETE}>>>>"
COMPETITOR = "struct<homeAway:string,score:string,linescores:array<struct<displayValue:string,value:string>>>"
SCHEMA = f"header struct<id:string,competitions:array<struct<competitors:array<{COMPETITOR}>>>>, boxscore struct<teams:array<{TEAM_BLOCK}>,players:array<{PLAYERS}>>"


def number(text: Column) -> Column:
    """A number that may carry a percent sign; null for anything else."""
    value = F.replace(F.trim(text), F.lit("%"), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def figures(named: Column, kinds: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Columns of an array of (name, text): of values that can be read the last one of a name counts, of pairs only whole ones."""
    out = {}
    called = lambda name: F.transform(F.filter(named, lambda x: x["name"] == name), lambda x: x["text"])
    for name, columns in kinds.items():
        texts = called(name)
        if len(columns) == 1:
            out[columns[0]] = F.try_element_at(F.filter(F.transform(texts, number), lambda v: v.isNotNull()), F.lit(-1))
            continue
        halves = F.transform(texts, lambda t: F.struct(number(F.substring_index(t, "-", 1)).alias("made"), F.when(F.instr(t, "-") > 0, number(F.substr(t, F.instr(t, "-") + 1))).alias("attempted")))
        whole = F.try_element_at(F.filter(halves, lambda p: p["made"].isNotNull() & p["attempted"].isNotNull()), F.lit(-1))
        out |= {columns[0]: whole["made"], columns[1]: whole["attempted"]}
    return out


def usable(spark: SparkSession, path: str) -> DataFrame:
    """The summaries with a team block that says something, as game_id, competitors, teams (typed) and players."""
    raw = spark.read.schema(SCHEMA).json(path).select(F.col("header.id").try_cast("long").alias("game_id"), F.coalesce(F.get("header.competitions", F.lit(0))["competitors"], F.array().cast(f"array<{COMPETITOR}>")).alias("competitors"), "boxscore.teams", "boxscore.players")
    sides = F.filter("teams", lambda t: t["homeAway"].isin("home", "away"))

    def final(side: Column) -> Column:
        own = F.filter("competitors", lambda c: c["homeAway"] == side)
        score = lambda c: F.when(F.startswith(c["score"], F.lit("{")), F.coalesce(F.get_json_object(c["score"], "$.value"), F.get_json_object(c["score"], "$.displayValue"))).otherwise(c["score"])
        return F.floor(F.try_element_at(F.filter(F.transform(own, lambda c: number(score(c))), lambda v: v.isNotNull()), F.lit(-1))).cast("double")

    def typed(t: Column) -> Column:
        found = figures(F.transform(t["statistics"], lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["displayValue"], s["value"]).alias("text"))), TEAM)
        found["points"] = F.coalesce(found["points"], final(t["homeAway"]))
        return F.struct(t["homeAway"].alias("home_away"), t["team"]["id"].try_cast("long").alias("team_id"), t["team"]["displayName"].alias("team_name"), *[c.alias(n) for n, c in found.items()])

    some = lambda t: F.coalesce(*[t[c] for columns in TEAM.values() for c in columns]).isNotNull()
    made = raw.withColumn("teams", F.filter(F.transform(sides, typed), some))
    return made.filter(F.size("teams") > 0)


def team_rows(found: DataFrame) -> DataFrame:
    """A row a side, with field_mask, the names of the columns that have a value."""
    names = [c for columns in TEAM.values() for c in columns]
    rows = found.select("game_id", F.inline("teams"))
    return rows.withColumn("field_mask", F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(names)])), ","))


def period_rows(found: DataFrame) -> DataFrame:
    """Points by side and period; a period beyond the fourth is overtime."""
    sides = found.select("game_id", F.explode("competitors").alias("c")).filter(F.col("c.homeAway").isin("home", "away"))
    lines = sides.select("game_id", F.col("c.homeAway").alias("home_away"), F.posexplode("c.linescores").alias("at", "line"))
    points = F.floor(number(F.coalesce("line.displayValue", "line.value"))).cast("int")
    return lines.select("game_id", "home_away", (F.col("at") + 1).alias("period"), points.alias("points"), (F.col("at") >= REGULAR_PERIODS).alias("overtime")).filter("points is not null")


def player_rows(found: DataFrame) -> DataFrame:
    """A row a player and block of figures, for players with a whole id."""
    blocks = found.select("game_id", F.explode("players").alias("g")).select("game_id", F.col("g.team.id").try_cast("long").alias("team_id"), F.explode("g.statistics").alias("b"))
    rows = blocks.select("game_id", "team_id", F.col("b.keys").alias("keys"), F.explode("b.athletes").alias("a"))
    n = F.least(F.size(F.coalesce("keys", F.array().cast("array<string>"))), F.size(F.coalesce("a.stats", F.array().cast("array<string>"))))
    zipped = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("keys", i).alias("name"), F.element_at("a.stats", i).alias("text")))
    named = F.when(n > 0, zipped).otherwise(F.array().cast("array<struct<name:string,text:string>>"))
    got = rows.withColumn("named", named).withColumn("player_id", F.coalesce("a.athlete.id", "a.id").try_cast("long")).filter("player_id is not null")
    return got.select("game_id", "team_id", "player_id", F.col("a.athlete.displayName").alias("player_name"), F.col("a.starter").alias("starter"), F.col("a.didNotPlay").alias("did_not_play"), *[c.alias(k) for k, c in figures(F.col("named"), PLAYER).items()])
