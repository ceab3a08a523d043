"""Readers of landed provider payloads: CSV seasons, Football.TXT, and the JSON shapes of match feeds.

Each yields typed rows; what can't be read keeps its row with a reason, so nothing is lost unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.functions.policy import strict_int
from strictbefore.functions.text import clean_number, stable_id
from strictbefore.functions.time import parse_date, parse_utc

# Columns of the season files by field, and the months of the text format.
REQUIRED = {"Date": "day", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_goals", "FTAG": "away_goals"}
STATISTICS = {"HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target", "HC": "home_corners", "AC": "away_corners", "HY": "home_yellow", "AY": "away_yellow", "HR": "home_red", "AR": "away_red"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def csv_season(spark: SparkSession, path: str, league_id: int, season: int) -> DataFrame:
    """A season's CSV: headers in any case, padded or behind a byte order mark; reject says why a row can't be used."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    tidy = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    col = lambda name: F.col(f"`{tidy[name.lower()]}`") if name.lower() in tidy else F.lit(None).cast("string")
    missing = [name for name in REQUIRED if name.lower() not in tidy]
    if missing:
        raise ValueError(f"the file lacks {', '.join(missing)}")
    rows = raw.select(
        F.lit(league_id).alias("league_id"), F.lit(season).alias("season"), parse_date(col("Date")).alias("day"), F.trim(col("HomeTeam")).alias("home_team"), F.trim(col("AwayTeam")).alias("away_team"),
        strict_int(col("FTHG")).alias("home_goals"), strict_int(col("FTAG")).alias("away_goals"), *[strict_int(col(k)).alias(v) for k, v in STATISTICS.items()],
    )
    reject = (
        F.when(F.col("day").isNull(), "bad_date").when(F.coalesce(F.col("home_team"), F.lit("")) == "", "missing_home").when(F.coalesce(F.col("away_team"), F.lit("")) == "", "missing_away")
        .when(F.col("home_team") == F.col("away_team"), "identical_teams").when((F.col("home_goals") < 0) | (F.col("away_goals") < 0), "negative_score").when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), "missing_score")
    )
    key = F.concat_ws("|", F.lit(league_id), F.lit(season), "home_team", "away_team", F.col("day").cast("string"))
    return rows.withColumn("fixture_id", stable_id("csv", key)).withColumn("reject", reject)


def score_parts(text: Column) -> Column:
    """struct<home, away, status, half_home, half_away, full_home, full_away, pen_home, pen_away> of a score such as
    ``2-1 (1-0)``, ``2-1 a.e.t. (1-1, 0-1)`` or ``4-3 pen. 1-1 a.e.t. (1-1, 0-0)``; the 90-minute score of a match that
    went on is the first in parentheses. Null for anything else."""
    number = r"(\d{1,2})-(\d{1,2})"
    pattern = rf"^{number}(?:\s*(pen)\.?\s*{number})?(?:\s*(a\.?e\.?t)\.?)?(?:\s*\({number}(?:,\s*{number})?\))?$"
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, pattern, i)
    num = lambda i: F.when(part(i) != "", part(i).cast("int"))
    pen, extra = part(3) != "", part(6) != ""
    home, away = F.when(pen, F.coalesce(num(4), num(7))).otherwise(num(1)), F.when(pen, F.coalesce(num(5), num(8))).otherwise(num(2))
    went_on = pen | extra
    half = lambda i, j: F.when(went_on, num(j)).otherwise(num(i))
    return F.when(part(1) != "", F.struct(
        home.alias("home"), away.alias("away"), F.when(pen, "PEN").when(extra, "AET").otherwise("FT").alias("status"), half(7, 9).alias("half_home"), half(8, 10).alias("half_away"),
        F.when(went_on, num(7)).otherwise(num(1)).alias("full_home"), F.when(went_on, num(8)).otherwise(num(2)).alias("full_away"), F.when(pen, num(1)).alias("pen_home"), F.when(pen, num(2)).alias("pen_away"),
    ))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, raw: the lines of text files with what orders them, (block, at) within a file.

    Files are read by blocks of ``spark.sql.files.maxPartitionBytes`` that begin and end with a line, by as many tasks as there are blocks; a block is a stretch of one
    file, named by where it begins, and ``at`` counts on over the lines of a task.
    """
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def carried(rows: DataFrame, order: str) -> DataFrame:
    """``stage``, ``day`` and ``time`` of lines (file, block, ``order``) filled with the last ones before them; a time holds until the next stage or day.

    Each block says what it hands on, one row; what a block is handed comes from the blocks before it, so that no task sorts a whole file.
    """
    heads = F.col("stage").isNotNull() | F.col("day").isNotNull()
    within = Window.partitionBy("file", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_head", F.count(F.when(heads, 1)).over(within))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order)))
    per = rows.groupBy("file", "block").agg(last("stage").alias("s"), last("day").alias("d"), F.max("_head").alias("n"), F.max_by("time", F.when(F.col("time").isNotNull(), F.struct("_head", order))).alias("t"), F.max(F.when(F.col("time").isNotNull(), F.col("_head"))).alias("tn"))
    # a block with a stage or day hands on the time after the last of them, be it none; one without hands on its own time or what it was handed
    per = per.withColumn("t", F.when((F.col("n") > 0) | F.col("t").isNotNull(), F.struct(F.when(F.coalesce("tn", F.lit(-1)) == F.col("n"), F.col("t")).alias("time"))))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = per.select("file", "block", *[F.last(c, True).over(before).alias(f"_{c}") for c in "sdt"])
    rows = rows.join(handed, ["file", "block"])
    after_head = Window.partitionBy("file", "block", "_head").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "file", "block", order, "text", F.coalesce(F.last("stage", True).over(within), "_s").alias("_stage"), F.coalesce(F.last("day", True).over(within), "_d").alias("_day"),
        F.coalesce(F.last("time", True).over(after_head), F.when(F.col("_head") == 0, F.col("_t.time"))).alias("_time"), "stage", "day",
    )


def football_txt(spark: SparkSession, path: str, season: int) -> DataFrame:
    """A Football.TXT season: stage, date and time are carried forward from the lines that state them, within a file however many tasks read it. ``line`` orders a file's rows."""
    files = ordered_lines(spark, path)
    t = F.trim("raw")
    date = r"^(?:\[)?(?:[A-Za-z]{3}[a-z]*\s+)?([A-Za-z]{3})[a-z]*[/ ](\d{1,2})(?:[ /,]+(\d{4}))?(?:\])?$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, date, 1))).cast("int")
    year = F.coalesce(F.regexp_extract(t, date, 3).try_cast("int"), F.when(month >= 7, season).otherwise(season + 1))
    day = F.when(month > 0, F.try_make_timestamp(year, month, F.regexp_extract(t, date, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    rows = files.filter(t != "").filter(~t.rlike("^[#=]")).select(
        "file", "block", "at", t.alias("text"), F.when(t.rlike("^[▪•]"), F.trim(F.regexp_replace(t, "^[▪•]\\s*", ""))).alias("stage"), day.alias("day"), F.nullif(F.regexp_extract(t, r"^(\d{1,2}[:.]\d{2})\s", 1), F.lit("")).alias("time")
    )
    rows = carried(rows, "at").filter("stage is null and day is null").withColumn("line", F.struct("block", "at"))
    body = F.regexp_replace("text", r"^\d{1,2}[:.]\d{2}\s+", "")
    between = r"^(.+?)\s+(?:v|vs)\.?\s+(.+?)\s+(\d{1,2}-\d{1,2}(?:\s.*|\s*\(.*)?)$"
    inside = r"^(.+?)\s+(\d{1,2}-\d{1,2}(?:\s*pen\.?\s*\d{1,2}-\d{1,2})?(?:\s*a\.?e\.?t\.?)?(?:\s*\([^)]*\))?)\s+(\S.*)$"
    versus = body.rlike(between)
    home = F.when(versus, F.regexp_extract(body, between, 1)).otherwise(F.regexp_extract(body, inside, 1))
    away = F.when(versus, F.regexp_extract(body, between, 2)).otherwise(F.regexp_extract(body, inside, 3))
    score = F.when(versus, F.regexp_extract(body, between, 3)).otherwise(F.regexp_extract(body, inside, 2))
    found = rows.select("file", "line", F.col("_stage").alias("stage"), F.col("_day").alias("day"), F.col("_time").alias("time"), F.trim(home).alias("home_team"), F.trim(away).alias("away_team"), score_parts(score).alias("score"))
    return found.filter("day is not null and home_team != '' and away_team != '' and score is not null").select("file", "line", "stage", "day", "time", "home_team", "away_team", "score.*")


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON matches with several results: the full-time row by kind, then by number two, then the last in order."""
    rows = spark.read.schema("matchID long, matchDateTimeUTC string, team1 struct<teamId:long,teamName:string>, team2 struct<teamId:long,teamName:string>, matchIsFinished boolean, matchResults array<struct<resultTypeID:int,resultName:string,resultOrderID:int,pointsTeam1:int,pointsTeam2:int>>").option("multiLine", True).json(path)
    rank = lambda r: F.when(F.lower(r["resultName"]).rlike("end|full"), 0).when(r["resultTypeID"] == 2, 1).otherwise(2)
    ordered = F.array_sort(F.transform("matchResults", lambda r: F.struct(rank(r).alias("rank"), (-r["resultOrderID"]).alias("order"), r["pointsTeam1"].alias("home"), r["pointsTeam2"].alias("away"))))
    best = F.get(ordered, F.lit(0))
    return rows.select(F.col("matchID").alias("fixture_id"), parse_utc(F.col("matchDateTimeUTC")).alias("kickoff_at"), F.col("team1.teamName").alias("home_team"), F.col("team2.teamName").alias("away_team"), F.when(F.col("matchIsFinished"), "FT").otherwise("NS").alias("status_short"), best["home"].alias("home_goals"), best["away"].alias("away_goals"))


def fixture_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Fixture documents, one JSON object a line, as flat typed rows."""
    team = "struct<id:string,name:string>"
    pair = "struct<home:string,away:string>"
    schema = f"fixture struct<id:string,date:string,status:struct<short:string>>, league struct<id:string,season:string>, teams struct<home:{team},away:{team}>, goals {pair}, score struct<fulltime:{pair},penalty:{pair},penalty_shootout:{pair}>, statistics array<struct<team:struct<id:string>,statistics:array<struct<type:string,value:string>>>>"
    rows = spark.read.schema(schema).json(path)
    i = lambda c: strict_int(F.col(c))
    stats = F.flatten(F.transform("statistics", lambda b: F.transform(b["statistics"], lambda s: F.struct(strict_int(b["team"]["id"]).alias("team_id"), s["type"].alias("type"), clean_number(s["value"]).alias("value")))))
    return rows.select(
        i("fixture.id").alias("fixture_id"), parse_utc(F.col("fixture.date")).alias("kickoff_at"), F.col("fixture.status.short").alias("status_short"), i("league.id").alias("league_id"), i("league.season").cast("int").alias("season"),
        i("teams.home.id").alias("home_id"), F.col("teams.home.name").alias("home_team"), i("teams.away.id").alias("away_id"), F.col("teams.away.name").alias("away_team"), i("goals.home").alias("home_goals"), i("goals.away").alias("away_goals"),
        i("score.fulltime.home").alias("full_home"), i("score.fulltime.away").alias("full_away"), F.coalesce(i("score.penalty.home"), i("score.penalty_shootout.home")).alias("pen_home"), F.coalesce(i("score.penalty.away"), i("score.penalty_shootout.away")).alias("pen_away"), stats.alias("statistics"),
    )


def last_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """JSON lines of which a later one replaces an earlier one of the same key; files count by name, a file's lines in order. Big files are read by many tasks."""
    lines = ordered_lines(spark, path).filter("trim(raw) != ''")
    keyed = lines.withColumn("key", F.get_json_object("raw", f"$.{key}")).filter("key is not null")
    return keyed.groupBy("key").agg(F.max_by("raw", F.struct("file", "block", "at")).alias("raw"))


def box_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Basketball summaries: team totals and points by period; a fifth period is overtime."""
    schema = "game_id long, teams array<struct<id:long,statistics:array<struct<name:string,displayValue:string>>,linescores:array<struct<displayValue:string>>>>"
    rows = spark.read.schema(schema).json(path).select("game_id", F.explode("teams").alias("t"))
    stats = rows.select("game_id", F.col("t.id").alias("team_id"), F.explode("t.statistics").alias("s")).select("game_id", "team_id", F.col("s.name").alias("name"), F.col("s.displayValue").alias("value"))
    periods = rows.select("game_id", F.col("t.id").alias("team_id"), F.posexplode("t.linescores").alias("at", "p")).select("game_id", "team_id", (F.col("at") + 1).alias("period"), (F.col("at") >= 4).alias("overtime"), F.col("p.displayValue").try_cast("int").alias("points"))
    return stats, periods
