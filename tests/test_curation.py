"""The paged source and the curation run: failing, empty and endless pages, limits, sinks, statistics, a repeated run."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from winnow.operators.curation import curate, curated_rows
from winnow.operators.ingest import first_wins
from winnow.sources import files
from winnow.sources.paged import LandedPages, Page, pages_of, read_pages

SERVICE = {"two": [["a", "b"], ["c"]], "none": [[]], "gap": [["d"], [], ["e"]], "long": [[f"{p}{k}" for k in range(4)] for p in range(9)]}


def fetch(query, token):
    page = int(token or 0)
    if query == "down" or query == "half" and page == 1:
        raise OSError(f"no page {page}")
    if query == "round":
        return Page(["x"], "1")
    pages = SERVICE.get(query, [["f"], ["g"]])
    return Page(pages[page], str(page + 1) if page + 1 < len(pages) else None)


def test_pages_of_many_queries(spark):
    df = read_pages(spark, ["two", "none", "gap", "long", "half", "down", "round", "two"], fetch, limit=10, tries=2, wait=0, pace=0)
    assert df.rdd.getNumPartitions() == 7
    got = {}
    for r in df.orderBy("query", "page", "place").collect():
        got.setdefault(r.query, []).append((r.page, r.place, r.entry, r.complete, r.error))
    assert [x[:4] for x in got["two"]] == [(0, 0, "a", True), (0, 1, "b", True), (1, 0, "c", True)] and "none" not in got
    assert [x[:3] for x in got["gap"]] == [(0, 0, "d"), (2, 0, "e")] and len(got["long"]) == 10 and all(x[3] for x in got["long"])
    assert got["half"] == [(0, 0, "f", False, "OSError: no page 1")] and got["down"] == [(0, 0, None, False, "OSError: no page 0")]
    assert [x[3:] for x in got["round"]] == [(False, "page 1 comes again")] * 2
    assert read_pages(spark, [], fetch).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        read_pages(spark, ["two"], fetch, limit=0)


def test_tries_wait_longer_and_longer():
    calls, waits = [], []

    def flaky(query, token):
        calls.append(token)
        if len(calls) in (1, 2, 5):
            raise TimeoutError("slow")
        return Page(["e"], "1" if token is None else None)

    rows = list(pages_of("q", flaky, 10, 3, 1.0, 0.5, waits.append))
    assert [r[2:] for r in rows] == [(0, "e", True, None)] * 2 and calls == [None, None, None, "1"] and waits == [1.0, 2.0, 0.5]
    waits.clear()
    assert [r[4] for r in pages_of("down", fetch, 10, 4, 1.0, 0.5, waits.append)] == [False] and waits == [1.0, 2.0, 4.0]


def test_landed_pages(spark, tmp_path):
    rows = [(q, p, e) for q, pages in SERVICE.items() for p, e in enumerate(pages)]
    spark.createDataFrame(rows, "query string, page int, entries array<string>").repartitionByRange(3, "query", "page").write.parquet(f"{tmp_path}/landed")
    for path in (f"{tmp_path}/landed", f"file://{tmp_path}/landed"):
        got = read_pages(spark, [*SERVICE, "unknown"], LandedPages(path), wait=0, pace=0).collect()
        assert Counter((r.query, r.page, r.place, r.entry) for r in got) == Counter((q, p, k, x) for q, p, e in rows for k, x in enumerate(e)) and all(r.complete for r in got)


def raw(spark):
    rows = []
    for i in range(120):
        text = f"{i % 37} words of entry {i} " * (1 if i == 3 else 8)
        rows.append((i % 2, i, int(i % 3 == 0), "hard" if i % 5 == 1 else "easy", json.dumps({"id": f"e{i}", "body": {"value": text}})))
    rows += [(2, i, 0, "again", json.dumps({"id": f"e{i}", "body": {"value": "z" * 60}})) for i in (0, 3)]
    rows += [(0, 500, 1, "easy", "{broken"), (0, 501, 1, "easy", None), (0, 502, 1, None, json.dumps({"id": "n", "body": {"value": "x" * 70}}))]
    return spark.createDataFrame(rows, "query_ord int, row_ord long, y int, subcategory string, value string")


def test_first_accepted_row_wins(spark):
    got = {r.id: r for r in curated_rows(raw(spark), ["hard"]).collect()}
    assert len(got) == 121 and got["e0"].y == 1 and got["e0"].subcategory == "easy"
    assert got["e3"].subcategory == "again" and got["e3"].length == 60 and got["n"].is_hard_negative is False and got["e1"].is_hard_negative
    df = spark.createDataFrame([(1, None, 2), (2, None, 1), (3, "a", None), (4, "a", 0)], "n int, key string, o int")
    assert {r.n for r in first_wins(df, "key", ["o"]).collect()} == {2, 3}


def test_a_run_writes_everything_and_a_second_one_changes_nothing(spark, tmp_path):
    def everything():
        read = {n: Counter(map(str, spark.read.parquet(f"{tmp_path}/{n}").collect())) for n in ("curated", "splits")}
        return read | {n: Counter(r.value for r in spark.read.text(f"{tmp_path}/{n}").collect()) for n in ("metadata", "sequences", "subcategories", "stats", "split_stats")}

    done = curate(raw(spark), str(tmp_path), ["hard"], strata=None, small="reuse")
    before = everything()
    rows = done.rows(spark).collect()
    lengths = sorted(r.length for r in rows)
    assert done.stats["total"] == len(rows) == 121 and done.stats["positive"] == sum(r.y for r in rows) and done.stats["hard_negative"] == sum(r.is_hard_negative for r in rows)
    assert (done.stats["min_length"], done.stats["median_length"], done.stats["max_length"]) == (lengths[0], lengths[60], lengths[-1]) and abs(done.stats["mean_length"] - sum(lengths) / 121) < 1e-9
    split = Counter((r.split, r.y) for r in done.split_rows(spark).collect())
    assert {(s, v): n[k] for s, n in done.splits.items() for v, k in ((0, "negative"), (1, "positive")) if n[k]} == dict(split) and len({s for s, _ in split}) >= 4
    assert {(r.header.split("|")[0], len(r.text)) for r in files.read_fasta(spark, f"{tmp_path}/sequences").collect()} >= {("n", 70), ("e3", 60)}
    assert "text" not in spark.read.option("header", True).csv(f"{tmp_path}/metadata").columns
    again = curate(raw(spark).repartition(5), str(tmp_path), ["hard"], strata=None, small="reuse")
    assert everything() == before and (again.stats, again.splits) == (done.stats, done.splits)
