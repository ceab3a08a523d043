"""Files read by many tasks, and paged listings with pages that are wrong or not there."""

import json

import pytest

from strictbefore.sources import feeds, readers


@pytest.fixture
def blocks(spark):
    """Files in blocks of so many bytes."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None) is not None}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
        if k in was:
            spark.conf.set(k, was[k])


def text(seed):
    out, want, stage, day, time = ["= League"], [], None, None, None
    for i in range(400):
        kind = (i * 7 + seed * i * i) % 11
        if kind == 0:
            stage, time = f"Round {i}", None
            out.append(f"▪ {stage}")
        elif kind == 1:
            day, time = f"2025-01-{1 + i % 28:02d}", None
            out.append(f"Sat Jan/{1 + i % 28} 2025")
        elif kind == 2:
            out.append("# a comment" if i % 2 else "")
        else:
            head = ""
            if kind in (3, 4):
                time = f"{10 + i % 10}:30"
                head = f"{time}  "
            out.append(f"  {head}Team {i} v Other {i}  {i % 5}-{i % 3}")
            if day:
                want.append((stage, day, time, f"Team {i}"))
    return "\n".join(out) + "\n", want


@pytest.mark.parametrize("size", [10_000_000, 900, 70])
def test_headers_are_carried_over_blocks(spark, tmp_path, blocks, size):
    blocks(size)
    wants = {}
    for seed in (1, 2, 3):
        body, wants[f"s{seed}.txt"] = text(seed)
        (tmp_path / f"s{seed}.txt").write_text(body)
    got = readers.football_txt(spark, str(tmp_path), 2024).orderBy("file", "line").collect()
    for name, want in wants.items():
        assert [(r["stage"], str(r["day"]), r["time"], r["home_team"]) for r in got if r["file"].endswith(name)] == want
    if size == 70:
        assert readers.ordered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 50


@pytest.mark.parametrize("size", [10_000_000, 300])
def test_the_last_line_counts_over_blocks(spark, tmp_path, blocks, size):
    blocks(size)
    rows = [{"id": (i * i) % 37, "v": i} for i in range(500)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\r\n\n{broken\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": 4, "v": -1}))
    got = {r["key"]: json.loads(r["raw"])["v"] for r in readers.last_lines(spark, str(tmp_path), "id").collect()}
    assert got == {str(r["id"]): r["v"] for r in rows} | {"4": -1}


def test_pages_that_are_wrong_or_missing(spark, tmp_path):
    page = lambda league, current, total, *ids: {"parameters": {"league": league, "season": "2024"}, "paging": {"current": current, "total": total}, "response": [{"id": i, "name": f"{league}{i}"} for i in ids]}
    docs = [
        page("whole", 1, 2, 1, 2), page("whole", 2, 2, 3), page("gaps", 3, 9, 30), page("gaps", 4, 9, 40), page("gaps", 7, 9), page("twice", 1, 1, 1), page("twice", 1, 1, 1), page("differ", 1, 2, 1), page("differ", 2, 3, 1, 2),
        page("beyond", 1, 1, 1), page("beyond", 0, 1, 2), page("blank", None, None, 5), {"parameters": {"league": "none", "season": "2024"}, "response": [{"id": 6, "name": "n"}]}, page("outside", 5, 2, 1), {"parameters": None, "paging": {"current": 1, "total": 1}, "response": [{"id": 8}]},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    items, faults = feeds.paged(spark, str(tmp_path), "id:long,name:string")
    assert {tuple(r) for r in faults.select("league", "fault", "page", "upto").collect()} == {
        ("gaps", "missing_pages", 1, 2), ("gaps", "missing_pages", 5, 6), ("gaps", "missing_pages", 8, 9), ("twice", "repeated_page", 1, 1), ("differ", "totals_differ", 3, 3), ("differ", "missing_pages", 3, 3),
        ("beyond", "page_out_of_range", 0, 0), ("blank", "missing_paging", None, None), ("none", "missing_paging", None, None), ("outside", "page_out_of_range", 5, 5), ("outside", "missing_pages", 1, 2),
    }
    got = {(r["league"], r["id"]): (r["complete"], r["page"]) for r in items.collect()}
    assert {k for k, v in got.items() if v[0]} == {("whole", 1), ("whole", 2), ("whole", 3), (None, 8)}
    assert items.count() == len(got) and got["differ", 1][1] == 1 and got["gaps", 40] == (False, 4)


def test_pages_as_lines_of_few_files(spark, tmp_path):
    """Many pages in one file, a line each, give what a file a page gives, faults and all; a broken line is a page without paging."""
    page = lambda league, current, total, *ids: {"parameters": {"league": league, "season": "2024"}, "paging": {"current": current, "total": total}, "response": [{"id": i, "name": f"{league}{i}"} for i in ids]}
    docs = [page("long", p, 60, 2 * p, 2 * p + 1) for p in range(1, 61) if p % 9] + [page("twice", 1, 1, 1)] * 2 + [page("whole", 1, 1, 5, 6), page("blank", None, None, 5)]
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir(), many.mkdir()
    (one / "pages.json").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    for i, d in enumerate(docs):
        (many / f"{i}.json").write_text(json.dumps(d, indent=1))
    got, want = ([sorted(map(str, rows.collect())) for rows in feeds.paged(spark, str(folder), "id:long,name:string", lines=folder == one)] for folder in (one, many))
    assert got == want and len(got[0]) == 2 * 54 + 1 + 2 + 1 and len(got[1]) == 6 + 1 + 1
    with (one / "pages.json").open("a") as out:
        out.write("{broken\n")
    faults = feeds.paged(spark, str(one), "id:long,name:string", lines=True)[1]
    assert (None, "missing_paging") in {(r["league"], r["fault"]) for r in faults.collect()}


def test_landed_pages_are_few_files_and_parsed_once_for_their_faults(spark):
    """They were a file a page, and each kind of fault read them all again."""
    from strictbefore.plans import landed_queries

    items, faults = landed_queries.landed_pages(spark, "/root/testdata/sf0.01")
    files = [f for f in items.inputFiles() if "/pages-" in f]
    assert len(files) <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8) < items.select("league", "season", "page").distinct().count()
    assert not [f for f in faults.inputFiles() if "/pages-" in f]
