"""Readers of the landed JSON of match feeds: scoreboards, day listings, match details, fixture lists of further providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.functions.policy import strict_int
from strictbefore.functions.text import clean_number, stable_id, uid_parts
from strictbefore.functions.time import parse_utc
from strictbefore.operators.reconcile import keep_first
from strictbefore.sources.sinks import stored

# Phases by number, marks of all-star games, the league's id, statistics by key, status names.
PHASES = {1: "preseason", 2: "regular_season", 3: "postseason", 4: "all_star", 5: "play_in"}
ALL_STAR_TYPES, ALL_STAR_NAMES, SPORT_ID, LEAGUE_ID = ("4",), ("ALLSTAR",), "40", "46"
DETAIL = {"possession": ("ballpossesion", "ballpossession"), "xg": ("expected_goals",), "shots": ("total_shots",), "shots_on_target": ("shotsontarget",), "corners": ("corners",), "yellow_cards": ("yellow_cards",), "red_cards": ("red_cards",)}
STATUS = {"FINISHED": "FT", "SCHEDULED": "NS", "TIMED": "NS", "IN_PLAY": "1H", "PAUSED": "HT", "POSTPONED": "PST", "CANCELLED": "CANC", "SUSPENDED": "SUSP"}

TEAM = "struct<id:string,uid:string,displayName:string>"
COMPETITION = f"struct<type:struct<id:string,abbreviation:string>,competitors:array<struct<homeAway:string,score:string,team:{TEAM}>>>"
EVENTS = f"events array<struct<id:string,uid:string,date:string,season:struct<year:string,type:string>,seasonType:struct<type:string,id:string>,status:struct<type:struct<completed:boolean>>,competitions:array<{COMPETITION}>>>"


def scoreboard_events(spark: SparkSession, path: str) -> DataFrame:
    """One row per event: id, kickoff, both sides' names and strict scores."""
    rows = spark.read.schema(EVENTS).option("multiLine", True).json(path).select(F.explode("events").alias("e")).select("e.*", F.get("e.competitions", F.lit(0)).alias("competition"))
    side = lambda name: F.get(F.filter("competition.competitors", lambda c: c["homeAway"] == name), F.lit(0))
    home, away = side("home"), side("away")
    both = strict_int(home["score"]).isNotNull() & strict_int(away["score"]).isNotNull()
    return rows.filter("competition is not null").select(
        F.col("id").alias("event_id"), "uid", parse_utc(F.col("date")).alias("kickoff_at"), F.col("status.type.completed").alias("completed"), home["team"]["displayName"].alias("home_name"), away["team"]["displayName"].alias("away_name"),
        F.when(both, strict_int(home["score"])).alias("home_score"), F.when(both, strict_int(away["score"])).alias("away_score"), "season", "seasonType", "competition",
    )


def own_league(uid: Column) -> Column:
    parts = uid_parts(uid)
    return (F.try_element_at(parts, F.lit("s")) == SPORT_ID) & (F.try_element_at(parts, F.lit("l")) == LEAGUE_ID)


def classified_events(spark: SparkSession, path: str, season: int) -> DataFrame:
    """Basketball events once each, with their phase, or why they are set aside; the first reason that holds."""
    rows = scoreboard_events(spark, path)
    event = F.try_element_at(uid_parts(F.col("uid")), F.lit("e"))
    year = F.col("season.year").try_cast("int")
    foreign = F.exists("competition.competitors", lambda c: F.coalesce(~own_league(c["team"]["uid"]), c["team"]["uid"].isNotNull()))
    reason = (
        F.when(F.coalesce(F.col("uid"), F.lit("")) == "", "uid_missing").when(~F.coalesce(own_league(F.col("uid")), F.lit(False)), "other_competition").when(event.isNotNull() & (event != F.col("event_id")), "uid_id_mismatch")
        .when(F.coalesce(foreign, F.lit(False)), "team_of_other_competition").when(year.isNull(), "season_unknown").when(~year.isin(season, season + 1), "outside_season")
    )
    kind = F.coalesce("season.type", "seasonType.type", "seasonType.id").try_cast("int")
    star = F.coalesce(F.trim("competition.type.id").isin(*ALL_STAR_TYPES), F.lit(False)) | F.coalesce(F.upper(F.trim("competition.type.abbreviation")).isin(*ALL_STAR_NAMES), F.lit(False))
    phases = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    phase = F.when(star, "all_star").otherwise(F.try_element_at(phases, kind))
    got = rows.withColumn("quarantine", reason).withColumn("phase", F.when(reason.isNull(), phase)).drop("season", "seasonType", "competition")
    return keep_first(got, ["event_id"], *[F.asc(c) for c in got.columns])  # of two versions the same one every time


def day_listing(spark: SparkSession, path: str) -> DataFrame:
    """A day's matches over all leagues, each id once."""
    side = "struct<name:string,score:int>"
    schema = f"leagues array<struct<name:string,matches:array<struct<id:string,statusId:int,status:struct<finished:boolean,utcTime:string>,home:{side},away:{side}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("leagues").alias("l")).select(F.lower("l.name").alias("league"), F.explode("l.matches").alias("m"))
    got = rows.select(F.col("m.id").alias("id"), "league", parse_utc(F.col("m.status.utcTime")).alias("kickoff_at"), F.col("m.home.name").alias("home"), F.col("m.away.name").alias("away"), F.col("m.home.score").alias("home_score"), F.col("m.away.score").alias("away_score"), (F.coalesce("m.status.finished", F.lit(False)) | F.coalesce(F.col("m.statusId") == 6, F.lit(False))).alias("finished"))
    return keep_first(got, ["id"], F.desc("finished"), *[F.asc(c) for c in got.columns])


def match_details(spark: SparkSession, path: str) -> DataFrame:
    """A match's statistics, one column per side and figure; null where the feed has none."""
    schema = "matchId string, content struct<stats:struct<Periods:struct<All:struct<stats:array<struct<stats:array<struct<key:string,stats:array<string>>>>>>>>>"
    rows = spark.read.schema(schema).json(path).select("matchId", F.flatten(F.transform("content.stats.Periods.All.stats", lambda g: g["stats"])).alias("s"))
    under = lambda keys: F.get(F.filter("s", lambda x: F.lower(x["key"]).isin(*keys) & (F.size(x["stats"]) == 2)), F.lit(0))["stats"]
    cols = []
    for name, keys in DETAIL.items():
        found = under(keys)
        cols += [clean_number(F.get(found, F.lit(i))).alias(f"{side}_{name}") for i, side in enumerate(("home", "away"))]
    return rows.filter(F.size("s") > 0).select("matchId", *cols)


def status_code(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), name), F.lit("NS"))


def listed_matches(spark: SparkSession, path: str, league_id: int, season: int) -> DataFrame:
    """Matches of a fixture-list API: status by name, the full-time score, short names first."""
    team = "struct<id:long,name:string,shortName:string>"
    schema = f"matches array<struct<id:long,utcDate:string,status:string,homeTeam:{team},awayTeam:{team},score:struct<fullTime:struct<home:int,away:int>>>>"
    m = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("matches").alias("m")).select("m.*")
    return m.select(F.col("id").alias("fixture_id"), parse_utc(F.col("utcDate")).alias("kickoff_at"), status_code(F.col("status")).alias("status_short"), F.lit(league_id).alias("league_id"), F.lit(season).alias("season"), F.col("homeTeam.id").alias("home_id"), F.coalesce("homeTeam.shortName", "homeTeam.name").alias("home_team"), F.col("awayTeam.id").alias("away_id"), F.coalesce("awayTeam.shortName", "awayTeam.name").alias("away_team"), F.col("score.fullTime.home").alias("home_goals"), F.col("score.fullTime.away").alias("away_goals"))


def union_matches(spark: SparkSession, path: str, league_id: int, season: int) -> DataFrame:
    """Matches of a federation's API; reject says why a row isn't a finished match."""
    team = "struct<id:string,internationalName:string>"
    schema = f"id string, homeTeam {team}, awayTeam {team}, kickOffTime struct<dateTime:string>, status string, score struct<total:struct<home:int,away:int>>"
    m = spark.read.schema(schema).json(path)
    kickoff = parse_utc(F.col("kickOffTime.dateTime"))
    incomplete = F.col("homeTeam.internationalName").isNull() | F.col("awayTeam.internationalName").isNull() | kickoff.isNull() | F.col("score.total.home").isNull() | F.col("score.total.away").isNull()
    done = F.upper(F.coalesce("status", F.lit("FT"))).isin("FT", "AET", "PEN", "PLAYED", "FINISHED")
    reject = F.when(incomplete, "incomplete_match").when(F.col("id").isNull(), "missing_match_id").when(~done, "not_finished")
    return m.select(stable_id("union_match", F.col("id")).alias("fixture_id"), kickoff.alias("kickoff_at"), F.lit(league_id).alias("league_id"), F.lit(season).alias("season"), F.col("homeTeam.internationalName").alias("home_team"), F.col("awayTeam.internationalName").alias("away_team"), F.col("score.total.home").alias("home_goals"), F.col("score.total.away").alias("away_goals"), reject.alias("reject"))


def score_rows(rows: DataFrame, names: dict[str, str], provider: str, league_id: int, season: int) -> DataFrame:
    """Rows of a scraped table under its own column names: ``names`` maps home_team, away_team, date, score to them; a score is ``2–1``."""
    part = lambda i: strict_int(F.regexp_extract(F.col(f"`{names['score']}`"), r"(\d+)\s*[–:-]\s*(\d+)", i))
    day = F.coalesce(F.to_date(parse_utc(F.col(f"`{names['date']}`").cast("string"))), F.try_to_date(F.substring(F.col(f"`{names['date']}`").cast("string"), 1, 10), "yyyy-MM-dd"))
    home, away = F.trim(F.col(f"`{names['home_team']}`")), F.trim(F.col(f"`{names['away_team']}`"))
    key = F.concat_ws("|", F.lit(league_id), F.lit(season), home, away, day.cast("string"))
    return rows.select(stable_id(provider, key).alias("fixture_id"), F.lit(provider).alias("provider"), F.lit(league_id).alias("league_id"), F.lit(season).alias("season"), day.alias("day"), home.alias("home_team"), away.alias("away_team"), part(1).alias("home_goals"), part(2).alias("away_goals"))


def pages(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The landed pages of a paged listing as one table."""
    return spark.read.schema(f"response array<struct<{schema}>>").option("multiLine", True).json(pattern).select(F.explode("response").alias("r")).select("r.*")


def paged(spark: SparkSession, path: str, item: str, keys: tuple[str, ...] = ("league", "season"), number: str = "id", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """A paged listing's landed pages, one JSON document each with ``parameters``, ``paging`` and ``response``: (items, faults).

    A file has one page, laid out in any way, or with ``lines`` any number of them, one a line, so that a long listing isn't as many files.

    Items come once by ``number``, of the lowest page, with ``complete``: whether their listing has all its pages and no fault. Faults have a row a
    fault: missing_paging; page_out_of_range; repeated_page; totals_differ; and missing_pages with the first and last page of a gap. The number of pages is the greatest total that a page states.
    """
    fields = ", ".join(f"{k}:string" for k in keys)
    raw = spark.read.schema(f"parameters struct<{fields}>, paging struct<current:int,total:int>, response array<struct<{item}>>").option("multiLine", not lines).json(path)
    got = raw.select(*[F.col(f"parameters.{k}").alias(k) for k in keys], F.col("paging.current").alias("page"), F.col("paging.total").alias("total"), "response")
    bad = F.col("page").isNull() | F.col("total").isNull()
    w = Window.partitionBy(*keys)
    # a row a page, kept: all faults are told from it, and the documents are parsed for it once
    slim = stored(got.select(*keys, "page", "total", bad.alias("bad")), "page-numbers")
    known = slim.filter("not bad").withColumn("pages", F.max("total").over(w))
    inside = known.filter("page between 1 and pages")
    once = inside.groupBy(*keys, "page").agg(F.max("pages").alias("pages"), F.count("*").alias("n"))
    after = once.withColumn("next", F.coalesce(F.lead("page").over(w.orderBy("page")), F.col("pages") + 1)).withColumn("first", F.row_number().over(w.orderBy("page")) == 1)
    gap = lambda rows, since, until: rows.select(*keys, F.lit("missing_pages").alias("fault"), since.alias("page"), until.alias("upto"))
    said = lambda rows, fault, page="page": rows.select(*keys, F.lit(fault).alias("fault"), F.col(page).alias("page"), F.col(page).alias("upto"))
    none_inside = known.groupBy(*keys).agg(F.max("pages").alias("pages"), F.count(F.when(F.expr("page between 1 and pages"), 1)).alias("n")).filter("n = 0 and pages >= 1")
    faults = [
        said(slim.filter("bad"), "missing_paging"), said(known.filter("not page between 1 and pages"), "page_out_of_range"), said(once.filter("n > 1"), "repeated_page"),
        said(known.groupBy(*keys).agg(F.min("total").alias("low"), F.max("total").alias("page")).filter("low < page"), "totals_differ"),
        gap(after.filter("next > page + 1"), F.col("page") + 1, F.col("next") - 1), gap(after.filter("first and page > 1"), F.lit(1), F.col("page") - 1), gap(none_inside, F.lit(1), F.col("pages")),
    ]
    found = faults[0]
    for more in faults[1:]:
        found = found.unionByName(more)
    broken = found.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    items = got.select(*keys, F.coalesce("page", F.lit(2**31 - 1)).alias("page"), F.explode("response").alias("r"))
    own = Window.partitionBy(*keys, F.col(f"r.{number}")).orderBy("page")
    items = items.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    return items.join(broken.withColumn("_broken", F.lit(True)), same, "left").select(*keys, "page", "r.*", F.col("_broken").isNull().alias("complete")), found


def odds_events(spark: SparkSession, path: str) -> DataFrame:
    """One row per event, bookmaker and outcome of the head-to-head market, prices above 1."""
    schema = "home_team string, away_team string, bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("home_team", "away_team", F.explode("bookmakers").alias("b")).select("home_team", "away_team", F.col("b.key").alias("bookmaker"), F.explode("b.markets").alias("m"))
    got = rows.filter("m.key = 'h2h'").select("home_team", "away_team", "bookmaker", F.explode("m.outcomes").alias("o"))
    outcome = F.when(F.col("o.name") == F.col("home_team"), "home_win").when(F.col("o.name") == F.col("away_team"), "away_win").when(F.lower("o.name") == "draw", "draw")
    return got.select("home_team", "away_team", "bookmaker", outcome.alias("outcome"), F.col("o.price").alias("price")).filter("outcome is not null and price > 1")
