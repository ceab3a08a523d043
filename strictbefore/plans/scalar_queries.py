"""Every function on one value, over whole tables: statuses, scores, times, dates, names, labels and numbers.

The tables have few odd values of their own, so a row's text is one of a list, picked by its key; SQL parses the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.functions import grading, policy, text
from strictbefore.functions import time as clock
from strictbefore.operators import basketball, documents
from strictbefore.plans.catalog import query
from strictbefore.plans.matches import MATCHES_SQL, matches, table
from strictbefore.sources import readers


def pick(texts: list, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


def pick_sql(texts: list, key: str) -> str:
    said = ", ".join("NULL" if t is None else str(t) if isinstance(t, (int, float)) else "'" + t.replace("'", "''") + "'" for t in texts)
    return f"[{said}][({key} % {len(texts)} + 1)::INT]"


STATUSES = ["FT", "AET", "PEN", "AOT", "1H", "2H", "HT", "ET", "BT", "P", "SUSP", "INT", "Q1", "Q4", "OT", "PST", "CANC", "ABD", "AWD", "WO", "NS", "ft", "", None]
SCORES = ["2", " 3 ", "+1", "-1", "0", "1.0", "true", "", None, "12", "07"]


@query(
    "status_flags",
    f"""WITH s AS (SELECT o_orderkey, {pick_sql(STATUSES, "o_orderkey")} AS s FROM orders)
    SELECT o_orderkey, coalesce(s IN ('FT', 'AET', 'PEN'), false) AS finished, coalesce(s IN ('FT', 'AOT'), false) AS finished_game, coalesce(s IN ('1H', '2H', 'HT', 'ET', 'BT', 'P', 'SUSP', 'INT'), false) AS live,
      coalesce(s IN ('Q1', 'Q2', 'Q3', 'Q4', 'OT', 'HT', 'BT'), false) AS live_game, coalesce(s IN ('PST', 'CANC', 'ABD', 'AWD', 'WO'), false) AS called_off, coalesce(s IN ('PST', 'CANC', 'ABD'), false) AS called_off_game FROM s""",
)
def status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a status code says of a match, in both sports."""
    s = pick(STATUSES, F.col("o_orderkey"))
    flags = {"finished": policy.is_finished, "live": policy.is_live, "called_off": policy.is_called_off}
    both = [f(s, sport).alias(name + end) for name, f in flags.items() for sport, end in (("football", ""), ("basketball", "_game"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", *both)


@query(
    "score_values",
    f"""WITH t AS (SELECT o_orderkey, {pick_sql(STATUSES, "o_orderkey")} AS s, {pick_sql(SCORES, "o_orderkey")} AS h, {pick_sql(SCORES, "(o_orderkey // 4)")} AS a, {pick_sql(SCORES, "(o_orderkey // 8)")} AS fh, {pick_sql(SCORES, "(o_orderkey // 16)")} AS fa FROM orders),
    i AS (SELECT o_orderkey, s, * EXCLUDE (o_orderkey, s) FROM (SELECT o_orderkey, s, {", ".join(f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN replace(trim({c}), '+', '')::BIGINT END AS {c}" for c in ("h", "a", "fh", "fa"))} FROM t)),
    r AS (SELECT *, h >= 0 AND a >= 0 AS ok, fh >= 0 AND fa >= 0 AS fok FROM i),
    g AS (SELECT *, CASE WHEN fok THEN fh WHEN ok AND coalesce(s NOT IN ('AET', 'PEN'), true) THEN h END AS rh, CASE WHEN fok THEN fa WHEN ok AND coalesce(s NOT IN ('AET', 'PEN'), true) THEN a END AS ra FROM r)
    SELECT o_orderkey, h AS home, CASE WHEN ok THEN h END AS home_goals, CASE WHEN ok THEN a END AS away_goals, rh AS regulation_home, ra AS regulation_away, sign(rh - ra)::INT AS regulation_sign, CASE WHEN ok THEN sign(h - a)::INT END AS match_sign,
      CASE WHEN ok AND rh IS NOT NULL THEN h - rh END AS later_home, CASE WHEN ok AND ra IS NOT NULL THEN a - ra END AS later_away,
      CASE WHEN ok THEN CASE WHEN h > a THEN 'home_win' WHEN h < a THEN 'away_win' END END AS game_winner FROM g""",
)
def score_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict integers, valid pairs, the 90-minute score and what came after it, outcomes on both, and a game's winner."""
    k = F.col("o_orderkey")
    h, a, fh, fa = (policy.strict_int(pick(SCORES, F.floor(k / d).cast("long"))) for d in (1, 4, 8, 16))
    parts = policy.score_breakdown(pick(STATUSES, k), h, a, fh, fa)
    sign = lambda o: F.when(o == "home_win", 1).when(o == "away_win", -1).when(o == "draw", 0)
    got = table(spark, sf_dir, "orders").select(k, h.alias("home"), parts.alias("p"), basketball.points(h, a).alias("points"))
    p = F.col("p")
    return got.select(
        k, "home", p["match"]["home"].alias("home_goals"), p["match"]["away"].alias("away_goals"), p["regulation"]["home"].alias("regulation_home"), p["regulation"]["away"].alias("regulation_away"),
        sign(policy.outcome(p["regulation"]["home"], p["regulation"]["away"])).alias("regulation_sign"), sign(policy.outcome(p["match"]["home"], p["match"]["away"])).alias("match_sign"),
        p["later"]["home"].alias("later_home"), p["later"]["away"].alias("later_away"), F.nullif(policy.outcome(F.col("points.home"), F.col("points.away")), F.lit("draw")).alias("game_winner"),
    )


TIMES = ["2024-03-01T12:30:00Z", "2024-03-01T07:30:00-05:00", "2024-03-01T00:00:00Z", "2024-03-01", "2024-03-01T12:30:00", "", None, "nonsense", "2024-02-29T23:30:00-02:00", "2024-03-01T00:00:00+00:00"]
TIME_VALUES = ["2024-03-01 12:30:00", "2024-03-01 12:30:00", "2024-03-01 00:00:00", None, None, None, None, None, "2024-03-01 01:30:00", "2024-03-01 00:00:00"]
LOOSE_VALUES = [*TIME_VALUES[:3], "2024-03-01 00:00:00", "2024-03-01 12:30:00", *TIME_VALUES[5:]]
DATES = ["01/03/2024", "1/3/24", "2024-03-01", "03-01-2024", "31/02/2024", "", None, "1/12/1999"]
DATE_VALUES = ["2024-03-01", "2024-03-01", "2024-03-01", None, None, None, None, "1999-12-01"]


@query(
    "time_values",
    f"""WITH t AS (SELECT o_orderkey, {pick_sql(TIME_VALUES, "o_orderkey")}::TIMESTAMP AS utc, {pick_sql(TIMES, "o_orderkey")} AS said, {pick_sql(LOOSE_VALUES, "o_orderkey")}::TIMESTAMP AS loose, o_orderdate::TIMESTAMP AS cutoff, {pick_sql(DATE_VALUES, "o_orderkey")}::DATE AS day FROM orders)
    SELECT o_orderkey, coalesce(utc < TIMESTAMP '2024-03-01 12:00:00', false) AS before, coalesce(utc < cutoff, false) AS before_order, strftime(utc, '%Y-%m-%dT%H:%M:%S+00:00') AS formatted, coalesce(utc::DATE, try_cast(left(trim(said), 10) AS DATE)) AS kickoff_day, day,
      strftime(utc, '%H:%M') = '00:00' AS midnight, loose, CASE WHEN regexp_full_match(trim(said), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'day' WHEN loose IS NOT NULL THEN 'minute' END AS precision FROM t""",
)
def time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly-before, formatting, days, midnights, and the parser that takes a text without a zone for UTC, with its precision."""
    k = F.col("o_orderkey")
    said = pick(TIMES, k)
    at = clock.parse_utc(said)
    loose = clock.parse_loose(said)
    return table(spark, sf_dir, "orders").select(
        k, clock.strictly_before(at, F.lit("2024-03-01 12:00:00").cast("timestamp")).alias("before"), clock.strictly_before(at, F.col("o_orderdate").cast("timestamp")).alias("before_order"), clock.format_utc(at).alias("formatted"), clock.kickoff_date(said).alias("kickoff_day"),
        clock.parse_date(pick(DATES, k)).alias("day"), clock.is_midnight(at).alias("midnight"), loose["at"].alias("loose"), loose["precision"].alias("precision"),
    )


LABELS = ["2024", "2024/25", "2024-25", "2024-2025", "2024/26", "1999/00", "1999-2000", "x", "", None, " 2023 "]
LABEL_YEARS = [2024, 2024, 2024, 2024, None, 1999, 1999, None, None, None, 2023]


@query(
    "season_labels",
    f"""WITH s AS (SELECT p_partkey, {pick_sql(LABEL_YEARS, "p_partkey")} AS start, (1990 + p_partkey % 40)::INT AS season, DATE '2020-01-15' + (p_partkey % 600)::INT AS day FROM part)
    SELECT p_partkey, start, lpad((season % 100)::VARCHAR, 2, '0') || lpad(((season + 1) % 100)::VARCHAR, 2, '0') AS code, CASE WHEN p_partkey % 3 = 0 THEN day < DATE '2020-09-01' ELSE season < 2020 END AS before_xg FROM s""",
)
def season_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    season = (F.lit(1990) + k % 40).cast("int")
    day = F.date_add(F.lit("2020-01-15").cast("date"), (k % 600).cast("int"))
    era = policy.predates_xg(F.when(k % 3 != 0, season), day)
    return table(spark, sf_dir, "part").select(k, clock.season_start(pick(LABELS, k)).alias("start"), clock.season_code(season).alias("code"), era.alias("before_xg"))


ACCENTS = ["Ére FC", "É́toile", "Nguyễn Ạ", "ＡＢＣ Club", "Málaga CF", "Łódź", "ﬁnale & Co", "Ñuñoa_S.C.", "İstanbul", "Brøndby", "Beşiktaş", "Crvena Zvezda", None, " "]
PLAIN = ["ere", "etoile", "nguyen a", "abc", "malaga", "łodz", "finale and co", "nunoa s c", "istanbul", "brøndby", "besiktas", "crvena zvezda", "", ""]
FOLDED = ["ere fc", "etoile", "nguyen a", "abc club", "malaga cf", "łodz", "finale & co", "nunoa_s.c.", "istanbul", "brøndby", "besiktas", "crvena zvezda", None, " "]
NATIONS = ["Nigeria National Team", "Wales National", "Japan Football Team", "Team", "Peru Team FC", "Chile"]
NATION_NAMES = ["nigeria", "wales", "japan", "team", "peru", "chile"]
SIDES = ["Ajax U19", "Arsenal Women", "Real Madrid Academy U19", "Porto", "U23 Youth", "Reserves"]
SIDE_KINDS = ["u19", "women", "academy,u19", "", "u23,youth", "reserve"]


@query(
    "folded_names",
    f"""SELECT c_custkey, {pick_sql(FOLDED, "c_custkey")} AS folded, {pick_sql(PLAIN, "c_custkey")} AS name, coalesce(nullif(replace({pick_sql(PLAIN, "c_custkey")}, ' ', '_'), ''), 'unknown') AS slug,
      strip_accents(lower(c_name || 'Äéîõü')) AS own, {pick_sql(NATION_NAMES, "c_custkey")} AS nation, {pick_sql(SIDE_KINDS, "c_custkey")} AS side FROM customer""",
)
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with accents, combining marks, full width and ligatures, as the inventory's normaliser has them."""
    k = F.col("c_custkey")
    said = pick(ACCENTS, k)
    return table(spark, sf_dir, "customer").select(
        k, text.fold(said).alias("folded"), text.team_name(said).alias("name"), text.slug(said).alias("slug"), text.fold(F.concat("c_name", F.lit("Äéîõü"))).alias("own"),
        text.national_name(pick(NATIONS, k)).alias("nation"), text.side_kind(pick(SIDES, k)).alias("side"),
    )


PICKS = ["home_win", "Home Win", " H ", "draw", "Tie", "x", "away", "A", "Over 2.5", "Over-2 5"]
PICK_NAMES = ["home_win", "home_win", "home_win", "draw", "draw", "draw", "away_win", "away_win", "over_2.5", "over_2_5"]
MADE = ["7-15", " 10-20 ", "x", "7-", None, "0-0"]
MADE_VALUES, TRIED_VALUES = [7, 10, None, None, None, 0], [15, 20, None, None, None, 0]
NUMBERS = ["55%", " 1.5 ", "-3", "x", "", None, "0"]
NUMBER_VALUES = [55.0, 1.5, None, None, None, None, 0.0]
ASKED = ["show 5 matches", "top 12", "the last 25", "all", "in 2024", "0 games", "games 700 and 3", "Twenty picks", None, "on 2024-05-06 three"]
ASKED_VALUES = [5, 12, 25, 1, 1, 1, 500, 20, 1, 3]
SAYS = ["", "unknown", " NONE ", "Null", "unclassified", "yes", None, "0"]


@query(
    "label_values",
    f"""SELECT s_suppkey, {pick_sql(PICK_NAMES, "s_suppkey")} AS pick, {pick_sql(MADE_VALUES, "s_suppkey")} AS made, {pick_sql(TRIED_VALUES, "s_suppkey")} AS attempted, {pick_sql(NUMBER_VALUES, "s_suppkey")}::DOUBLE AS number, {pick_sql(ASKED_VALUES, "s_suppkey")} AS asked,
      coalesce(lower(trim({pick_sql(SAYS, "s_suppkey")})) IN ('', 'unknown', 'unclassified', 'null', 'none'), true) AS unknown, s_suppkey::VARCHAR AS event, regexp_replace(lower(trim('  ' || s_name || '  X ')), '\\s+', ' ', 'g') AS plain,
      'p:' || (s_suppkey % 7) || ':' || (2000 + s_suppkey % 20) || ':' || replace(lower(s_name), ' ', '_') || ':away_side:2024-01-01' AS fixture_key, ('0x' || substr(sha256('csv:' || s_name), 1, 8))::BIGINT AS fixture_id,
      CASE WHEN s_suppkey % 3 >= s_suppkey % 2 THEN 'home_or_draw' ELSE 'away_or_draw' END AS double_chance, CASE WHEN s_suppkey % 5 + 0.5 > s_suppkey % 4 THEN 'over' WHEN s_suppkey % 5 + 0.5 < s_suppkey % 4 THEN 'under' ELSE 'push' END AS against_half,
      CASE WHEN s_suppkey % 5 > s_suppkey % 4 THEN 'over' WHEN s_suppkey % 5 < s_suppkey % 4 THEN 'under' ELSE 'push' END AS against_whole FROM supplier""",
)
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks, made-of-attempted, numbers, quantities, unknowns, uids, plain texts, synthetic keys, double chances and lines."""
    k = F.col("s_suppkey")
    made = text.made_attempted(pick(MADE, k))
    key = text.synthetic_fixture_key(F.lit("P"), F.col("s_name"), F.lit("Away side"), F.lit("2024-01-01"), k % 7, F.lit(2000) + k % 20)
    return table(spark, sf_dir, "supplier").select(
        k, grading.pick_alias(pick(PICKS, k)).alias("pick"), made["made"].alias("made"), made["attempted"].alias("attempted"), text.clean_number(pick(NUMBERS, k)).alias("number"), text.quantity(pick(ASKED, k)).alias("asked"),
        policy.unknown(pick(SAYS, k)).alias("unknown"), F.try_element_at(text.uid_parts(F.concat(F.lit("s:40~l:46~e:"), k.cast("string"))), F.lit("e")).alias("event"), text.normal_text(F.concat(F.lit("  "), "s_name", F.lit("  X "))).alias("plain"),
        key.alias("fixture_key"), text.stable_id("csv", F.col("s_name")).alias("fixture_id"), grading.actual_double_chance(k % 3, k % 2).alias("double_chance"),
        grading.total_against_line(k % 5 + 0.5, k % 4).alias("against_half"), grading.total_against_line(k % 5, k % 4).alias("against_whole"),
    )


RESULTS = ["2-1 (1-0)", "3-2 a.e.t. (2-2, 1-0)", "4-3 pen. 1-1 a.e.t. (1-1, 0-0)", "0-0", "2-1 (1-0", "w/o", None]
RESULT_VALUES = {
    "home": [2, 3, 1, 0, None, None, None], "away": [1, 2, 1, 0, None, None, None], "status": ["FT", "AET", "PEN", "FT", None, None, None], "half_home": [1, 1, 0, None, None, None, None],
    "full_home": [2, 2, 1, 0, None, None, None], "full_away": [1, 2, 1, 0, None, None, None], "pen_home": [None, None, 4, None, None, None, None], "pen_away": [None, None, 3, None, None, None, None],
}


@query("score_texts", f"SELECT o_orderkey, {', '.join(f'{pick_sql(v, chr(111) + "_orderkey")} AS {c}' for c, v in RESULT_VALUES.items())} FROM orders")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score grammar of the text format: shoot-outs, extra time and halves in parentheses."""
    got = table(spark, sf_dir, "orders").select("o_orderkey", readers.score_parts(pick(RESULTS, F.col("o_orderkey"))).alias("s"))
    return got.select("o_orderkey", *[F.col(f"s.{c}").alias(c) for c in RESULT_VALUES])


@query(
    "graded_statistics",
    f"""WITH {MATCHES_SQL}, s AS (SELECT fixture_id, fixture_id % 9 AS hc, fixture_id % 7 AS ac, fixture_id % 4 AS hy, CASE WHEN fixture_id % 5 > 0 THEN fixture_id % 3 END AS ay, fixture_id % 2 AS hr, 0 AS ar FROM matches)
    SELECT fixture_id, {", ".join(f"hc + ac > {x} AS corners_over_{str(x).replace('.', '_')}" for x in grading.CORNER_LINES)}, {", ".join(f"hy + ay + hr + ar > {x} AS cards_over_{str(x).replace('.', '_')}" for x in grading.CARD_LINES)} FROM s""",
)
def graded_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and cards settled from a match's statistics, under two names of a figure; null where a side's is missing."""
    k = F.col("fixture_id")
    stat = lambda team, kind, value: F.struct(F.col(team).alias("team_id"), F.lit(kind).alias("type"), value.cast("double").alias("value"))
    stats = F.array(
        stat("home_id", "Corner Kicks", k % 9), stat("away_id", " corners ", k % 7), stat("home_id", "Yellow Cards", k % 4), stat("away_id", "yellow cards", F.when(k % 5 > 0, k % 3).otherwise(-1)),
        stat("home_id", "Red Cards", k % 2), stat("away_id", "RED CARDS", F.lit(0)),
    )
    settled = grading.statistical_markets(F.col("stats"), F.col("home_id"), F.col("away_id"))
    return matches(spark, sf_dir).withColumn("stats", stats).select(k, *[c.alias(name) for name, c in settled.items()])


@query(
    "provider_evidence",
    """SELECT o_orderkey, list_sort(list_distinct(['alpha', CASE WHEN o_orderkey % 3 = 0 THEN 'beta' ELSE 'gamma' END, 'alpha'])) AS providers,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '7' END AS alpha_id, 'b' || o_orderkey AS other_id FROM orders""",
)
def provider_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The providers of a record with one more, and its native ids with the new one in place of an old."""
    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, "beta").otherwise("gamma")
    ids = F.map_from_arrays(F.array(F.lit("alpha"), other), F.array(F.lit("7"), F.concat(F.lit("b"), k)))
    names, more = documents.provider_evidence(F.array(F.lit("alpha"), other), F.when(k % 2 == 0, ids).otherwise(F.map_filter(ids, lambda name, _: name != "alpha")), F.lit("alpha"), F.when(k % 2 == 0, k).otherwise(F.lit(7)))
    got = table(spark, sf_dir, "orders").select(k, names.alias("providers"), more.alias("ids"), other.alias("other"))
    return got.select(k, "providers", F.try_element_at("ids", F.lit("alpha")).alias("alpha_id"), F.try_element_at("ids", F.col("other")).alias("other_id"))
