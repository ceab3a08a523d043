import json

from pyspark.sql import functions as F

from strictbefore.operators import knowledge


def test_catalogue_and_gaps(spark, tmp_path):
    raw = {"sport": "basketball", "sources": {"a": {"name": "A", "url": "u", "confidence": "high"}}, "competitions": [
        {"league_id": 12, "name": "One", "format": "league", "edition_rule": {"type": "annual", "from": 2019, "to": 2020, "future_to": 2021}, "evidence": [{"fact": "f", "source": "a"}, {"fact": "g", "source": "none"}]},
        {"league_id": 13, "name": "Two", "format": "cup", "edition_rule": {"editions": [2018, 2018, 2014]}},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    competitions, evidence = knowledge.catalogue(spark, str(tmp_path / "c.json"))
    assert {(r["fact"], r["source_url"]) for r in evidence.collect()} == {("f", "u"), ("g", None)}
    years = {r["league_id"]: r["y"] for r in competitions.select("league_id", knowledge.edition_years(F.col("edition_rule")).alias("y")).collect()}
    assert years == {12: [2019, 2020], 13: [2014, 2018]}
    required = spark.createDataFrame([("basketball", 12, "One"), ("basketball", 99, "Lost")], "sport string, league_id long, name string")
    known = spark.createDataFrame([(12, 2019, 30, 1230), (12, 2020, 30, None)], "league_id long, season int, participants int, fixture_total int")
    report = knowledge.gap_report(competitions, required, known, 2019, 2020)
    gaps = {(r["league_id"], r["season"]): r["evidence_gaps"] for r in report.collect()}
    assert gaps[(12, 2019)] == [] and gaps[(12, 2020)] == ["fixture_total_unknown"] and gaps[(12, 2021)] == ["participants_unknown", "fixture_total_unknown"]
    assert gaps[(13, 2019)] == ["edition_not_documented"] and gaps[(13, 2014)][0] == "participants_unknown" and gaps[(99, 2020)] == ["competition_not_catalogued"]
    plan = {(r["league_id"], r["action"]): r["seasons"] for r in knowledge.recovery_plan(report).collect()}
    assert plan[(99, "catalogue")] == 2 and plan[(12, "find_fixture_total")] == 1 and plan[(13, "document_edition")] == 2
    row = spark.range(1).select(knowledge.expected_fixtures(F.lit("league"), F.lit(20), F.lit(None).cast("int")).alias("a"), knowledge.expected_fixtures(F.lit("cup"), F.lit(20), F.lit(None).cast("int")).alias("b")).first()
    assert row["a"] == 380 and row["b"] is None
