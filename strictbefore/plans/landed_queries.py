"""Readers of landed payloads: the match view is written in each provider's shape, read by its reader and compared with the view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches
from strictbefore.plans.scalar_queries import pick, pick_sql
from strictbefore.sources import feeds, readers, sinks, summaries


def key() -> Column:
    return F.col("fixture_id")


def iso() -> Column:
    return F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def named(side: str) -> Column:
    return F.concat(F.lit("Team "), F.col(f"{side}_id"))


def lines(rows: DataFrame, doc: Column, label: str) -> str:
    """A folder of JSON lines, one object each."""
    path = sinks.scratch(rows.sparkSession, label)
    rows.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


#: Keys whose entries one landed document may hold.
ENTRIES = 20_000


def documents(rows: DataFrame, by: str, entry: Column, wrap: Column, label: str) -> str:
    """A folder of JSON documents, one file per value of ``by`` and stretch of ENTRIES keys, so that a document is bounded however large the table is."""
    path = sinks.scratch(rows.sparkSession, label)
    entries = rows.groupBy(F.col(by).alias("_by"), F.floor(key() / ENTRIES).alias("_part")).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    entries.select(F.to_json(wrap, {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def pair(home, away, names: tuple[str, str] = ("home", "away")) -> Column:
    return F.struct(home.alias(names[0]), away.alias(names[1]))


STATS = [["Corner Kicks", 3], ["Yellow Cards", 5]]


@query(
    "read_fixture_payloads",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, kickoff_at, status_short, league_id, season, home_id, 'Team ' || home_id AS home_team, away_id, home_goals, away_goals, reg_home AS full_home, CASE WHEN fixture_id % 6 = 0 THEN 4 END AS pen_home,
      CASE WHEN fixture_id % 2 = 0 THEN 2 ELSE 0 END AS statistics, CASE WHEN fixture_id % 2 = 0 THEN fixture_id % 3 END::DOUBLE AS corners FROM matches""",
)
def read_fixture_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture documents with both shapes of a shoot-out and statistics by team."""
    text = lambda c: F.col(c).cast("string")
    team = lambda side: F.struct(text(f"{side}_id").alias("id"), named(side).alias("name"))
    stat = lambda name, value: F.struct(F.lit(name).alias("type"), value.cast("string").alias("value"))
    block = F.struct(F.struct(text("home_id").alias("id")).alias("team"), F.array(stat("Corner Kicks", key() % 3), stat("Ball Possession", F.concat(key() % 60, F.lit("%")))).alias("statistics"))
    shootout = pair(F.when(key() % 6 == 0, "4"), F.when(key() % 6 == 0, "3"))
    none = pair(F.lit(None).cast("string"), F.lit(None).cast("string"))
    doc = F.struct(
        F.struct(text("fixture_id").alias("id"), iso().alias("date"), F.struct(F.col("status_short").alias("short")).alias("status")).alias("fixture"), F.struct(text("league_id").alias("id"), text("season").alias("season")).alias("league"),
        pair(team("home"), team("away")).alias("teams"), pair(text("home_goals"), text("away_goals")).alias("goals"),
        F.struct(pair(text("reg_home"), text("reg_away")).alias("fulltime"), F.when(key() % 12 == 0, shootout).otherwise(none).alias("penalty"), F.when(key() % 12 == 6, shootout).otherwise(none).alias("penalty_shootout")).alias("score"),
        F.when(key() % 2 == 0, F.array(block)).alias("statistics"),
    )
    got = readers.fixture_payloads(spark, lines(matches(spark, sf_dir), doc, "payloads"))
    corners = F.get(F.filter("statistics", lambda s: s["type"] == "Corner Kicks"), F.lit(0))["value"]
    return got.select("fixture_id", "kickoff_at", "status_short", "league_id", "season", "home_id", "home_team", "away_id", "home_goals", "away_goals", "full_home", "pen_home", F.coalesce(F.size("statistics"), F.lit(0)).alias("statistics"), corners.alias("corners")).withColumn("statistics", F.greatest("statistics", F.lit(0)))


LISTED = ["FINISHED", "SCHEDULED", "TIMED", "IN_PLAY", "PAUSED", "POSTPONED", "CANCELLED", "SUSPENDED", "AWARDED"]
LISTED_CODES = ["FT", "NS", "NS", "1H", "HT", "PST", "CANC", "SUSP", "NS"]


@query("read_listed_matches", f"WITH {MATCHES_SQL} SELECT fixture_id, kickoff_at, {pick_sql(LISTED_CODES, 'fixture_id')} AS status_short, CASE WHEN fixture_id % 2 = 0 THEN 'T' || home_id ELSE 'Team ' || home_id END AS home_team, home_goals, away_goals FROM matches")
def read_listed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture-list API's pages: statuses by name, short names first."""
    short = lambda side: F.when(key() % 2 == 0, F.concat(F.lit("T"), F.col(f"{side}_id")))
    team = lambda side: F.struct(F.col(f"{side}_id").alias("id"), named(side).alias("name"), short(side).alias("shortName"))
    entry = F.struct(key().alias("id"), iso().alias("utcDate"), pick(LISTED, key()).alias("status"), team("home").alias("homeTeam"), team("away").alias("awayTeam"), F.struct(pair(F.col("home_goals"), F.col("away_goals")).alias("fullTime")).alias("score"))
    path = documents(matches(spark, sf_dir), "season", entry, F.struct(F.col("_entries").alias("matches")), "listed")
    return feeds.listed_matches(spark, path, 1, 2000).select("fixture_id", "kickoff_at", "status_short", "home_team", F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"))


@query(
    "read_union_matches",
    f"""WITH {MATCHES_SQL} SELECT ('0x' || substr(sha256('union_match:' || fixture_id), 1, 8))::BIGINT AS fixture_id, kickoff_at, home_goals, CASE WHEN fixture_id % 9 = 0 OR home_goals IS NULL THEN 'incomplete_match' WHEN status_short = 'NS' THEN 'not_finished' END AS reject FROM matches""",
)
def read_union_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A federation's matches; what isn't a finished match says why."""
    team = lambda side: F.struct(F.col(f"{side}_id").cast("string").alias("id"), F.when(key() % 9 > 0, named(side)).alias("internationalName"))
    doc = F.struct(key().cast("string").alias("id"), team("home").alias("homeTeam"), team("away").alias("awayTeam"), F.struct(iso().alias("dateTime")).alias("kickOffTime"), F.col("status_short").alias("status"), F.struct(pair(F.col("home_goals"), F.col("away_goals")).alias("total")).alias("score"))
    got = feeds.union_matches(spark, lines(matches(spark, sf_dir), doc, "union"), 2, 2000)
    return got.select("fixture_id", "kickoff_at", F.col("home_goals").cast("long").alias("home_goals"), "reject")


@query(
    "read_scoreboards",
    f"""WITH {MATCHES_SQL} SELECT fixture_id::VARCHAR AS event_id, kickoff_at, 'Team ' || home_id AS home_name, CASE WHEN home_goals IS NOT NULL THEN home_goals END AS home_score, status_short <> 'NS' AS completed,
      CASE WHEN fixture_id % 10 = 0 THEN 'uid_missing' WHEN fixture_id % 10 = 1 THEN 'other_competition' WHEN fixture_id % 10 = 2 THEN 'uid_id_mismatch' WHEN season NOT IN (1995, 1996) THEN 'outside_season' END AS quarantine,
      CASE WHEN fixture_id % 10 > 2 AND season IN (1995, 1996) THEN CASE WHEN fixture_id % 7 = 0 THEN 'all_star' ELSE ['preseason', 'regular_season', 'postseason', 'all_star', 'play_in'][(fixture_id % 5 + 1)::INT] END END AS phase FROM matches""",
)
def read_scoreboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly scoreboards: one row per event, in its phase or set aside with a reason. Every event is landed twice."""
    uid = F.when(key() % 10 == 0, "").when(key() % 10 == 1, F.concat(F.lit("s:600~l:1~e:"), key())).when(key() % 10 == 2, F.concat(F.lit("s:40~l:46~e:9"), key())).otherwise(F.concat(F.lit("s:40~l:46~e:"), key()))
    side = lambda name: F.struct(F.lit(name).alias("homeAway"), F.col(f"{name}_goals").cast("string").alias("score"), F.struct(F.col(f"{name}_id").cast("string").alias("id"), F.concat(F.lit("s:40~l:46~t:"), F.col(f"{name}_id")).alias("uid"), named(name).alias("displayName")).alias("team"))
    kind = F.struct(F.when(key() % 7 == 0, "4").otherwise("1").alias("id"), F.lit("STD").alias("abbreviation"))
    entry = F.struct(
        key().cast("string").alias("id"), uid.alias("uid"), iso().alias("date"), F.struct(F.col("season").cast("string").alias("year"), (key() % 5 + 1).cast("string").alias("type")).alias("season"), F.struct(F.struct((F.col("status_short") != "NS").alias("completed")).alias("type")).alias("status"),
        F.array(F.struct(kind.alias("type"), F.array(side("home"), side("away")).alias("competitors"))).alias("competitions"),
    )
    found = matches(spark, sf_dir)
    got = feeds.classified_events(spark, documents(found.unionByName(found), "season", entry, F.struct(F.col("_entries").alias("events")), "scoreboards"), 1995)
    return got.select("event_id", "kickoff_at", "home_name", "home_score", "completed", "quarantine", "phase")


@query("read_day_listings", f"WITH {MATCHES_SQL} SELECT fixture_id::VARCHAR AS id, 'league ' || league_id AS league, kickoff_at, home_goals AS home_score, status_short <> 'NS' OR fixture_id % 4 = 0 AS finished FROM matches")
def read_day_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day listings over all leagues; a match that two of them hold counts once."""
    side = lambda name: F.struct(named(name).alias("name"), F.col(f"{name}_goals").alias("score"))
    entry = F.struct(key().cast("string").alias("id"), F.when(key() % 4 == 0, 6).otherwise(1).alias("statusId"), F.struct((F.col("status_short") != "NS").alias("finished"), iso().alias("utcTime")).alias("status"), side("home").alias("home"), side("away").alias("away"))
    found = matches(spark, sf_dir)
    wrap = F.struct(F.array(F.struct(F.concat(F.lit("League "), "_by").alias("name"), F.col("_entries").alias("matches"))).alias("leagues"))
    got = feeds.day_listing(spark, documents(found.unionByName(found), "league_id", entry, wrap, "days"))
    return got.select("id", "league", "kickoff_at", F.col("home_score").cast("long").alias("home_score"), "finished")


@query("read_match_details", f"WITH {MATCHES_SQL} SELECT fixture_id::VARCHAR AS match_id, (fixture_id % 100)::DOUBLE AS home_possession, (100 - fixture_id % 100)::DOUBLE AS away_possession, CASE WHEN fixture_id % 3 > 0 THEN (fixture_id % 40) / 10e0 END AS home_xg, NULL::DOUBLE AS home_corners FROM matches")
def read_match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match's statistics by their keys: shares, decimals, and null where the feed has none."""
    figure = lambda key, home, away: F.struct(F.lit(key).alias("key"), F.array(home.cast("string"), away.cast("string")).alias("stats"))
    share = lambda n: F.concat(n.cast("string"), F.lit("%"))
    groups = F.array(F.struct(F.array(figure("BallPossesion", share(key() % 100), share(100 - key() % 100))).alias("stats")), F.struct(F.array(figure("expected_goals", F.when(key() % 3 > 0, (key() % 40) / 10), F.lit(None))).alias("stats")))
    doc = F.struct(key().cast("string").alias("matchId"), F.struct(F.struct(F.struct(F.struct(groups.alias("stats")).alias("All")).alias("Periods")).alias("stats")).alias("content"))
    got = feeds.match_details(spark, lines(matches(spark, sf_dir), doc, "details"))
    return got.select(F.col("matchId").alias("match_id"), "home_possession", "away_possession", "home_xg", "home_corners")


@query(
    "read_result_rows",
    f"""WITH {MATCHES_SQL} SELECT fixture_id, kickoff_at, 'Team ' || home_id AS home_team, CASE WHEN status_short = 'NS' THEN 'NS' ELSE 'FT' END AS status_short, CASE fixture_id % 3 WHEN 0 THEN home_goals WHEN 1 THEN home_goals + 1 ELSE home_goals + 2 END AS home_goals FROM matches""",
)
def read_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with several results: the full-time one by its name, by number two, else the last in order."""
    team = lambda side: F.struct(F.col(f"{side}_id").alias("teamId"), named(side).alias("teamName"))
    result = lambda kind, name, order, plus: F.struct(F.lit(kind).alias("resultTypeID"), F.lit(name).alias("resultName"), F.lit(order).alias("resultOrderID"), (F.col("home_goals") + plus).alias("pointsTeam1"), (F.col("away_goals") + plus).alias("pointsTeam2"))
    half = result(1, "Halbzeit", 1, 9)
    results = F.when(key() % 3 == 0, F.array(half, result(3, "Endergebnis", 2, 0), result(2, "other", 3, 5))).when(key() % 3 == 1, F.array(half, result(2, "other", 2, 1), result(5, "later", 9, 7))).otherwise(F.array(half, result(7, "x", 4, 2), result(8, "y", 3, 3)))
    entry = F.struct(key().alias("matchID"), iso().alias("matchDateTimeUTC"), team("home").alias("team1"), team("away").alias("team2"), (F.col("status_short") != "NS").alias("matchIsFinished"), results.alias("matchResults"))
    got = readers.result_rows(spark, documents(matches(spark, sf_dir), "season", entry, F.col("_entries"), "results"))
    return got.select("fixture_id", "kickoff_at", "home_team", "status_short", F.col("home_goals").cast("long").alias("home_goals"))


@query(
    "read_odds_events",
    f"""WITH {MATCHES_SQL} SELECT home_id || '-' || away_id AS pair, outcome, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT home_id, away_id, unnest(['home_win', 'draw', 'away_win']) AS outcome, unnest([odds, odds + 0.9, CASE WHEN fixture_id % 5 > 0 THEN odds + 1.7 ELSE 1 END]) AS price FROM matches) WHERE price > 1 GROUP BY ALL""",
)
def read_odds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-to-head prices by bookmaker; other markets and prices of 1 play no part."""
    outcome = lambda name, price: F.struct(name.alias("name"), price.alias("price"))
    h2h = F.struct(F.lit("h2h").alias("key"), F.array(outcome(named("home"), F.col("odds")), outcome(F.lit("Draw"), F.col("odds") + 0.9), outcome(named("away"), F.when(key() % 5 > 0, F.col("odds") + 1.7).otherwise(1.0))).alias("outcomes"))
    totals = F.struct(F.lit("totals").alias("key"), F.array(outcome(named("home"), F.lit(9.0))).alias("outcomes"))
    entry = F.struct(key().alias("id"), named("home").alias("home_team"), named("away").alias("away_team"), F.array(F.struct(F.lit("book").alias("key"), F.array(h2h, totals).alias("markets"))).alias("bookmakers"))
    got = feeds.odds_events(spark, documents(matches(spark, sf_dir), "season", entry, F.col("_entries"), "odds"))
    teams = F.concat_ws("-", F.regexp_extract("home_team", r"(\d+)", 1), F.regexp_extract("away_team", r"(\d+)", 1))
    return got.groupBy(teams.alias("pair"), "outcome").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


CSV_GOALS = "CASE WHEN fixture_id % 8 = 3 THEN -1 ELSE home_goals END"


@query(
    "read_csv_season",
    f"""WITH {MATCHES_SQL}, c AS (SELECT fixture_id, kickoff_at::DATE AS day, CASE WHEN fixture_id % 8 = 1 THEN NULL ELSE 'Team ' || home_id END AS h, CASE WHEN fixture_id % 8 = 2 THEN 'Team ' || home_id ELSE 'Team ' || away_id END AS a, {CSV_GOALS} AS hg, away_goals AS ag, fixture_id % 20 AS shots FROM matches)
    SELECT shots AS home_shots, CASE WHEN h IS NULL THEN 'missing_home' WHEN h = a THEN 'identical_teams' WHEN hg < 0 OR ag < 0 THEN 'negative_score' WHEN hg IS NULL OR ag IS NULL THEN 'missing_score' END AS reject, count(*) AS n, min(day) AS first_day, sum(hg)::BIGINT AS goals FROM c GROUP BY ALL""",
)
def read_csv_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's CSV with padded headers in odd case behind a byte order mark; rows that can't be used say why."""
    found = matches(spark, sf_dir).select(
        F.date_format("kickoff_at", "dd/MM/yyyy").alias("﻿date "), F.when(key() % 8 != 1, named("home")).alias("HOMETEAM"), F.when(key() % 8 == 2, named("home")).otherwise(named("away")).alias(" AwayTeam"),
        F.when(key() % 8 == 3, -1).otherwise(F.col("home_goals")).alias("fthg"), F.col("away_goals").alias("FTAG"), (key() % 20).alias("HS"),
    )
    path = sinks.scratch(spark, "csv")
    found.write.option("header", True).csv(path)
    got = readers.csv_season(spark, path, 1, 2000)
    return got.groupBy("home_shots", "reject").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.sum("home_goals").alias("goals"))


@query(
    "read_football_txt",
    f"""WITH {MATCHES_SQL} SELECT 'Matchday ' || (season % 7) AS stage, kickoff_at::DATE AS day, 'Team ' || home_id AS home_team, 'Team ' || away_id AS away_team, home_goals AS home, CASE WHEN fixture_id % 2 = 0 THEN 'AET' ELSE 'FT' END AS status, CASE WHEN fixture_id % 2 = 0 THEN 0 ELSE home_goals END AS full_home
    FROM played""",
)
def read_football_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Football.TXT files, one a match here: a stage, a day and a score line, the first two carried forward to it."""
    found = matches(spark, sf_dir).filter("status_short in ('FT', 'AET', 'PEN') and home_goals is not null and away_goals is not null")
    score = F.concat_ws("-", "home_goals", "away_goals")
    tail = F.when(key() % 2 == 0, F.lit(" a.e.t. (0-0, 0-0)")).otherwise(F.lit(""))
    text = F.concat_ws("\n", F.lit("# a comment"), F.concat(F.lit("▪ Matchday "), F.col("season") % 7), F.date_format("kickoff_at", "EEE MMM/d yyyy"), F.concat(F.lit("  15:00  "), named("home"), F.lit(" v "), named("away"), F.lit("  "), score, tail), F.concat(F.lit("# "), key()), F.lit(""))
    path = sinks.scratch(spark, "txt")
    # a file per season and stretch of keys keeps every block's lines together
    blocks = found.groupBy("season", F.floor(key() / ENTRIES).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("value"))
    blocks.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    got = readers.football_txt(spark, path, 2000)
    return got.select("stage", "day", "home_team", "away_team", F.col("home").cast("long").alias("home"), "status", F.col("full_home").cast("long").alias("full_home"))


PAGES_SQL = f"""WITH {MATCHES_SQL}, n AS (SELECT fixture_id, league_id, season, (row_number() OVER (PARTITION BY league_id, season ORDER BY fixture_id) - 1) // 40 + 1 AS page FROM matches),
  placed AS (SELECT *, season % 3 = 0 AND page > 1 AND page % 4 = 2 AS lost, season % 3 = 1 AND page = 1 AS twice FROM n),
  b AS (SELECT DISTINCT league_id, season FROM placed WHERE lost OR twice)"""


def landed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings of 40 fixtures a page, a document a line: in one season of three some pages are lost, in another the first came twice."""
    found = matches(spark, sf_dir).select("league_id", "season", "fixture_id", "home_id", "away_id")
    w = Window.partitionBy("league_id", "season")
    placed = found.withColumn("page", (F.floor((F.row_number().over(w.orderBy("fixture_id")) - 1) / 40) + 1).cast("int"))
    pages = placed.groupBy("league_id", "season", "page").agg(F.collect_list(F.struct(F.col("fixture_id").alias("id"), "home_id", "away_id")).alias("response")).withColumn("total", F.max("page").over(w))
    pages = pages.filter(~((F.col("season") % 3 == 0) & (F.col("page") > 1) & (F.col("page") % 4 == 2)))
    path = sinks.scratch(spark, "pages")
    doc = F.struct(F.struct(F.col("league_id").cast("string").alias("league"), F.col("season").cast("string").alias("season")).alias("parameters"), F.struct(F.col("page").alias("current"), "total").alias("paging"), "response")
    times = F.when((F.col("season") % 3 == 1) & (F.col("page") == 1), 2).otherwise(1)
    pages.select(F.explode(F.array_repeat(F.to_json(doc), times)).alias("value")).write.text(path)
    return feeds.paged(spark, path, "id:long,home_id:long,away_id:long", lines=True)


@query("paged_items", f"""{PAGES_SQL} SELECT placed.league_id, placed.season, page, fixture_id, b.season IS NULL AS complete FROM placed LEFT JOIN b USING (league_id, season) WHERE NOT lost""")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all landed pages, once each, and whether their listing is complete."""
    items, _ = landed_pages(spark, sf_dir)
    return items.select(F.col("league").cast("long").alias("league_id"), F.col("season").cast("int").alias("season"), F.col("page").cast("long").alias("page"), F.col("id").alias("fixture_id"), "complete")


@query("paged_faults", f"""{PAGES_SQL} SELECT DISTINCT league_id, season, 'missing_pages' AS fault, page, page AS upto FROM placed WHERE lost UNION ALL SELECT DISTINCT league_id, season, 'repeated_page' AS fault, 1 AS page, 1 AS upto FROM placed WHERE twice""")
def paged_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, faults = landed_pages(spark, sf_dir)
    return faults.select(F.col("league").cast("long").alias("league_id"), F.col("season").cast("int").alias("season"), "fault", F.col("page").cast("long").alias("page"), F.col("upto").cast("long").alias("upto"))


#: Three players a side by number; the third's figures end early, and every ninth game has no usable block.
SUMMARY_SQL = f"WITH {MATCHES_SQL}, s AS (SELECT fixture_id, kickoff_at, home_id, away_id, home_goals, away_goals FROM played WHERE fixture_id % 9 > 0), b AS (SELECT *, unnest([true, false]) AS home FROM s)"


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir).filter("status_short in ('FT', 'AET', 'PEN') and home_goals is not null and away_goals is not null")
    names = ["minutes", "fieldGoalsMade-fieldGoalsAttempted", "points", "plusMinus"]

    def side(which: str, sign: int) -> tuple[Column, Column, Column]:
        goals = F.col(f"{which}_goals")
        shot = F.concat_ws("-", goals, goals + key() % 5)
        block = F.struct(F.lit(which).alias("homeAway"), F.struct(F.col(f"{which}_id").cast("string").alias("id")).alias("team"), F.array(F.struct(F.lit("fieldGoalsMade-fieldGoalsAttempted").alias("name"), shot.alias("displayValue")), F.struct(F.lit("assists").alias("name"), F.when(key() % 4 > 0, goals.cast("string")).otherwise("--").alias("displayValue"))).alias("statistics"))
        figures = lambda n: F.slice(F.array((key() % 40).cast("string"), shot, (goals + n).cast("string"), F.format_string("%+d", F.lit(sign) * (F.col("home_goals") - F.col("away_goals")))), 1, 4 if n < 2 else 2)
        player = lambda n: F.struct(F.struct((F.col(f"{which}_id") * 10 + n).cast("string").alias("id"), F.concat(F.lit(f"P{n} of "), F.col(f"{which}_id")).alias("displayName")).alias("athlete"), F.lit(n < 2).alias("starter"), figures(n).alias("stats"))
        group = F.struct(block["team"].alias("team"), F.array(F.struct(F.array(*map(F.lit, names)).alias("keys"), F.array(*map(player, range(3))).alias("athletes"))).alias("statistics"))
        return block, group, F.struct(F.lit(which).alias("homeAway"), (goals + 80).cast("string").alias("score"))

    (a, pa_, ca), (b, pb, cb) = side("home", 1), side("away", -1)
    teams = F.when(key() % 9 > 0, F.array(a, b))
    doc = F.struct(F.struct(key().cast("string").alias("id"), F.array(F.struct(F.array(ca, cb).alias("competitors"))).alias("competitions")).alias("header"), F.struct(teams.alias("teams"), F.array(pa_, pb).alias("players")).alias("boxscore"))
    return summaries.usable(spark, lines(found, doc, "summaries"))


@query(
    "summary_teams",
    f"{SUMMARY_SQL} SELECT fixture_id AS game_id, CASE WHEN home THEN 'home' ELSE 'away' END AS home_away, CASE WHEN home THEN home_id ELSE away_id END AS team_id, (CASE WHEN home THEN home_goals ELSE away_goals END + 80)::DOUBLE AS points, (CASE WHEN home THEN home_goals ELSE away_goals END + fixture_id % 5)::DOUBLE AS field_goals_attempted, CASE WHEN fixture_id % 4 > 0 THEN 'assists,' ELSE '' END || 'field_goals_attempted,field_goals_made,points' AS field_mask FROM b",
)
def summary_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.team_rows(summary_rows(spark, sf_dir)).select("game_id", "home_away", "team_id", "points", "field_goals_attempted", "field_mask")


@query(
    "summary_players",
    f"""{SUMMARY_SQL}, p AS (SELECT *, CASE WHEN home THEN home_id ELSE away_id END AS team_id, CASE WHEN home THEN home_goals ELSE away_goals END AS goals, unnest([0, 1, 2]) AS n FROM b)
    SELECT fixture_id AS game_id, team_id, team_id * 10 + n AS player_id, 'P' || n || ' of ' || team_id AS player_name, n < 2 AS starter, (fixture_id % 40)::DOUBLE AS minutes, goals::DOUBLE AS field_goals_made, (goals + fixture_id % 5)::DOUBLE AS field_goals_attempted,
      CASE WHEN n < 2 THEN (goals + n)::DOUBLE END AS points, CASE WHEN n < 2 THEN ((home_goals - away_goals) * CASE WHEN home THEN 1 ELSE -1 END)::DOUBLE END AS plus_minus FROM p""",
)
def summary_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = summaries.player_rows(summary_rows(spark, sf_dir))
    return got.select("game_id", "team_id", "player_id", "player_name", "starter", "minutes", "field_goals_made", "field_goals_attempted", "points", "plus_minus")
