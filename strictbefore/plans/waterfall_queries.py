"""Provider waterfalls over the match view, whose providers hold parts of it by rule, and verdicts on payloads made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.operators import waterfall
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, played

#: What the providers hold: the own store, the first and the second provider.
HOLDS = {"store": "fixture_id % 4 = 0", "first": "fixture_id % 5 < 3", "second": "fixture_id % 7 > 0"}

MEETINGS_SQL = f"""WITH {MATCHES_SQL},
  q AS (SELECT fixture_id AS ask, ts, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b FROM matches WHERE home_id <> away_id),
  m AS (SELECT q.ask, p.fixture_id, p.ts, p.fixture_id % 4 = 0 AS s0, p.fixture_id % 5 < 3 AS s1, p.fixture_id % 7 > 0 AS s2 FROM q JOIN played p ON least(home_id, away_id) = a AND greatest(home_id, away_id) = b AND p.ts < q.ts),
  n AS (SELECT ask, count(*) FILTER (s0) AS n0, count(*) FILTER (s0 OR s1) AS n1 FROM m GROUP BY ask),
  k AS (SELECT m.*, CASE WHEN n0 >= 6 THEN 0 WHEN n1 >= 6 THEN 1 ELSE 2 END AS deep FROM m JOIN n USING (ask)),
  r AS (SELECT ask, fixture_id, ts, CASE WHEN s0 THEN 'store' WHEN s1 THEN 'first' ELSE 'second' END AS provider, deep,
        row_number() OVER (PARTITION BY ask ORDER BY ts DESC, fixture_id DESC) AS place FROM k WHERE s0 OR (s1 AND deep > 0) OR (s2 AND deep > 1))"""


def held(found: DataFrame) -> list[tuple[str, DataFrame]]:
    return [(name, found.filter(rule)) for name, rule in HOLDS.items()]


def asked_meetings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = matches(spark, sf_dir)
    done = played(found).select("fixture_id", "ts", "home_id", "away_id", "home_goals", "away_goals")
    return waterfall.meetings(found.select(F.col("fixture_id").alias("ask"), "ts", "home_id", "away_id"), held(done))


@query("meetings_by_waterfall", f"{MEETINGS_SQL} SELECT ask, place, fixture_id, provider FROM r WHERE place <= 6")
def meetings_by_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six meetings before every match, each with the provider it came from."""
    rows, _ = asked_meetings(spark, sf_dir)
    return rows.select("ask", F.col("place").cast("long").alias("place"), "fixture_id", "provider")


@query(
    "meeting_waterfalls",
    f"""{MEETINGS_SQL}, d AS (SELECT ask, max(deep) AS deep, count(*) FILTER (s0) AS n0, count(*) FILTER (s0 OR s1) AS n1, count(*) FILTER (s0 OR s1 OR s2) AS n2 FROM k GROUP BY ask)
    SELECT q.ask, coalesce(deep, 2) + 1 AS tiers_read, CASE WHEN coalesce(deep, 2) = 0 THEN 'store' WHEN deep = 1 THEN 'first' ELSE 'second' END AS last_provider,
      CASE WHEN n0 >= 6 THEN 'PRIMARY_SUCCESS' WHEN CASE deep WHEN 1 THEN n1 ELSE n2 END >= 6 THEN 'FALLBACK_SUCCESS' WHEN n2 > 0 THEN 'PARTIAL' ELSE 'NO_DATA' END AS resolver_status
    FROM q LEFT JOIN d USING (ask)""",
)
def meeting_waterfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each match's waterfall ended."""
    _, log = asked_meetings(spark, sf_dir)
    return waterfall.verdict(log, "ask").select("ask", "tiers_read", "last_provider", "resolver_status")


DAYS_SQL = f"""WITH {MATCHES_SQL}, f AS (SELECT fixture_id, league_id, kickoff_at::DATE AS day, status_short, home_goals, away_goals, fixture_id % 10 AS xg FROM matches),
  x AS (
    SELECT 0 AS tier, 'store' AS provider, fixture_id, league_id, day, status_short, home_goals, CASE WHEN fixture_id % 3 > 0 THEN away_goals END AS away_goals, xg FROM f WHERE league_id < 4 OR day < DATE '1995-01-01'
    UNION ALL SELECT 1, 'first', fixture_id, league_id, day, status_short, home_goals + CASE WHEN fixture_id % 8 = 0 THEN 1 ELSE 0 END, away_goals, CASE WHEN fixture_id % 6 > 0 THEN xg END FROM f WHERE fixture_id % 5 > 0
    UNION ALL SELECT 2, 'second', fixture_id, league_id, day, status_short, home_goals, away_goals, xg FROM f WHERE fixture_id % 9 > 0),
  u AS (SELECT league_id, day, tier, fixture_id, upto FROM x, (SELECT unnest([0, 1, 2]) AS upto) WHERE tier <= upto),
  gx AS (SELECT league_id, day, upto, fixture_id, status_short, h, a, xg FROM (
      SELECT u.league_id, u.day, upto, u.fixture_id, any_value(status_short) AS status_short, arg_min(home_goals, x.tier) FILTER (home_goals IS NOT NULL) AS h, arg_min(away_goals, x.tier) FILTER (away_goals IS NOT NULL) AS a, arg_min(xg, x.tier) FILTER (xg IS NOT NULL) AS xg
      FROM u JOIN x ON x.tier = u.tier AND x.fixture_id = u.fixture_id GROUP BY ALL)),
  c AS (SELECT league_id, day, upto, bool_and(xg IS NOT NULL AND (status_short = 'NS' OR (h IS NOT NULL AND a IS NOT NULL))) AS full_ FROM gx GROUP BY ALL),
  e AS (SELECT league_id, day, coalesce(min(upto) FILTER (full_), 2) AS deep FROM c GROUP BY ALL)"""


def asked_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("fixture_id")
    found = matches(spark, sf_dir).select("fixture_id", "league_id", F.to_date("kickoff_at").alias("day"), "status_short", "home_goals", "away_goals", (k % 10).alias("xg"))
    store = found.filter("league_id < 4 or day < date'1995-01-01'").withColumn("away_goals", F.when(k % 3 > 0, F.col("away_goals")))
    first = found.filter("fixture_id % 5 > 0").withColumns({"home_goals": F.col("home_goals") + F.when(k % 8 == 0, 1).otherwise(0), "xg": F.when(k % 6 > 0, F.col("xg"))})
    return waterfall.days(found, [("store", store), ("first", first), ("second", found.filter("fixture_id % 9 > 0"))], ["xg"], ["home_goals", "away_goals"], ["fixture_id"])


@query(
    "day_by_waterfall",
    f"""{DAYS_SQL}, w AS (SELECT x.* FROM x JOIN e ON e.league_id = x.league_id AND e.day = x.day AND x.tier <= deep)
    SELECT league_id, day, fixture_id, count(DISTINCT provider) AS providers, arg_min(home_goals, tier) FILTER (home_goals IS NOT NULL) AS home_goals, arg_min(provider, tier) FILTER (home_goals IS NOT NULL) AS home_goals_provider,
      arg_min(away_goals, tier) FILTER (away_goals IS NOT NULL) AS away_goals, arg_min(provider, tier) FILTER (away_goals IS NOT NULL) AS away_goals_provider, arg_min(xg, tier) FILTER (xg IS NOT NULL) AS xg, arg_min(provider, tier) FILTER (xg IS NOT NULL) AS xg_provider,
      coalesce(min(home_goals) <> max(home_goals), false) AS disputed FROM w GROUP BY league_id, day, fixture_id""",
)
def day_by_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixtures of every league and day from as few providers as make them whole, field by field."""
    rows, _ = asked_days(spark, sf_dir)
    fields = ["home_goals", "away_goals", "xg"]
    return rows.select("league_id", "day", "fixture_id", "providers", *fields, *[f"{f}_provider" for f in fields], F.array_contains("disputed", "home_goals").alias("disputed"))


@query(
    "day_waterfalls",
    f"""{DAYS_SQL}, asked AS (SELECT DISTINCT league_id, day FROM f), n AS (SELECT league_id, day, tier, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT unnest([0, 1, 2]) AS tier)
    SELECT asked.league_id, asked.day, t.tier, coalesce(n.n, 0) AS rows_read, coalesce(full_, false) AS enough FROM asked CROSS JOIN t LEFT JOIN e USING (league_id, day) LEFT JOIN n ON n.league_id = asked.league_id AND n.day = asked.day AND n.tier = t.tier
    LEFT JOIN c ON c.league_id = asked.league_id AND c.day = asked.day AND c.upto = t.tier WHERE t.tier <= coalesce(deep, 2)""",
)
def day_waterfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers each day was asked of, the rows each gave, and whether that was enough."""
    _, log = asked_days(spark, sf_dir)
    return log.select("league_id", "day", "tier", "rows_read", "enough")


@query(
    "sufficiency_verdicts",
    f"""WITH {MATCHES_SQL}
    SELECT fixture_id, CASE fixture_id % 6 WHEN 0 THEN 'PROVIDER_ERROR' WHEN 1 THEN 'VALID_EMPTY' WHEN 2 THEN 'INSUFFICIENT_MALFORMED' WHEN 3 THEN 'PROVIDER_ERROR' ELSE 'VALID_DATA' END AS fixtures, CASE WHEN fixture_id % 6 >= 4 THEN fixture_id % 6 - 3 ELSE 0 END AS usable,
      CASE WHEN fixture_id % 5 = 0 THEN 'VALID_EMPTY' WHEN fixture_id % 5 = 1 THEN 'INSUFFICIENT_MALFORMED' ELSE 'VALID_DATA' END AS standings, coalesce(home_goals, 0) >= 2 AND fixture_id % 4 > 0 AS statistics,
      fixture_id % 3 > 0 AND fixture_id % 7 > 0 AND fixture_id % 2 > 0 AS acquisition
    FROM matches""",
)
def sufficiency_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on payloads that are missing, no lists, empty, malformed or fit."""
    k = F.col("fixture_id")
    good = '{"fixture":{"id":1},"teams":{}}'
    lists = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, "[]").when(k % 6 == 2, '[{"fixture":7,"teams":{}},{"teams":{}},3]').when(k % 6 == 3, good).when(k % 6 == 4, f"[{good}]").otherwise(f'[{good},{{"fixture":null}},{good}]')
    table = F.when(k % 5 == 0, "[]").when(k % 5 == 1, '[{"team":{"name":""}},{"team":"x"}]').otherwise('[{"team":{"id":1,"name":"A"}}]')
    played_ = (F.coalesce("home_goals", F.lit(0)) + 3).cast("string")
    against = F.when(k % 4 == 0, "{}").when(k % 4 == 1, '{"average":{"total":"0.9"}}').otherwise('{"total":{"total":4}}')
    stats = F.concat(F.lit('{"fixtures":{"played":{"total":'), played_, F.lit('}},"goals":{"for":{"average":{"total":"1.5"}},"against":'), against, F.lit("}}"))
    said, rows = waterfall.fixtures_verdict(lists), matches(spark, sf_dir)
    return rows.select(
        "fixture_id", said["status"].alias("fixtures"), F.size(said["items"]).cast("long").alias("usable"), waterfall.standings_verdict(table)["status"].alias("standings"), waterfall.statistics_suffice(stats).alias("statistics"),
        waterfall.acquisition_suffices(k % 3, F.when(k % 7 == 0, True), F.when(k % 11 == 0, True), k % 2 > 0).alias("acquisition"),
    )
