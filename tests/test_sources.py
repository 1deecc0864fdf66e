"""Pluggable sources, and CSV appends that never leave the user's file broken."""

import csv
import glob
import json
import os

import pytest

from canvass.sources import files, leads_io
from canvass.sources.leads_io import append_dataset
from canvass.sources.pluggable import PageSource, read_pages, search_with

PAGES = "query string, page bigint, status int, body string"


class Numbers(PageSource):
    """A user's source: two pages for each number below ``upto``."""

    @classmethod
    def name(cls):
        return "numbers"

    def splits(self):
        return list(range(int(self.options["upto"])))

    def pages(self, split):
        for page in range(2):
            yield f"q{split}", page, 200 + page, json.dumps({"n": split})


def test_a_users_page_source(spark):
    df = read_pages(spark, Numbers, upto=5)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == [(f"q{i}", p, 200 + p, json.dumps({"n": i})) for i in range(5) for p in range(2)]
    assert read_pages(spark, Numbers, upto=0).collect() == []


def test_captured_pages_of_both_formats(spark, tmp_path):
    rows = [(f"q{i}", i, 200, "{\"x\": \"é\\n\"}" * 50) for i in range(700)] + [(None, None, None, None)]
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame(rows, PAGES).repartition(2).write.json(str(tmp_path / "j"))
    for folder in ("p", "j"):
        got = read_pages(spark, path=str(tmp_path / folder))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


class Current:
    def search_businesses(self, query, max_results):
        if query == "boom":
            raise RuntimeError("no quota")
        return [{"name": f"{query} {i}", "address": None, "rating": 4.5, "userRatingCount": i} for i in range(max_results + 3)]


class Legacy:
    def search_places(self, query, max_results):
        return [{"Company Name": query, "Phone Number": "1", "Google Review Rating": "n/a"}]


def test_searchers_of_both_interfaces(spark):
    queries = spark.createDataFrame([("a",), ("boom",), ("a",), (None,), (" ",)], "query string")
    got = search_with(queries, Current(), max_results=2, partitions=2).orderBy("query", "rank").collect()
    assert [(r.query, r.rank, r.company_name, r.company_address, r.rating, r.review_count, r.error) for r in got] == [
        ("a", 1, "a 0", "", 4.5, 0, None), ("a", 2, "a 1", "", 4.5, 1, None),
        ("boom", 1, "", "", None, None, "Exception during search: no quota")]
    old = search_with(queries, Legacy()).collect()
    assert {(r.query, r.company_name, r.company_phone, r.rating) for r in old} == {("a", "a", "1", None), ("boom", "boom", "1", None)}
    with pytest.raises(AttributeError, match="search_businesses or search_places"):
        search_with(queries, object())


def read(path):
    out = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            out.extend(csv.DictReader(f))
    return out


NEW = "company_name string, company_address string, maps_url string"


def test_csv_append_keeps_the_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "leads")
    first = [(f"old {i}", "x", f"u{i}") for i in range(50)]
    assert append_dataset(spark, path, spark.createDataFrame(first, NEW).coalesce(1), fmt="csv") == 50
    new = [(f"new {i}", "y", f"v{i}") for i in range(4000)] + [("again", "x", "u7")]
    real = leads_io.in_order
    monkeypatch.setattr(leads_io, "in_order", lambda df, **kw: real(df, rows_a_part=20, **kw))
    assert append_dataset(spark, path, spark.createDataFrame(new, NEW).repartition(4), fmt="csv") == 4000
    rows = read(path)
    assert [r["Company Name"] for r in rows[:50]] == [n for n, _, _ in first]
    assert sorted(r["Company Name"] for r in rows[50:]) == sorted(n for n, _, _ in new[:-1])
    assert len(glob.glob(f"{path}/part-*.csv")) > 3 and os.listdir(tmp_path) == ["leads"]


def test_rows_go_straight_to_their_part(spark):
    rows = [(i if i % 3 else None, f"n{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, name string, nth bigint").repartition(7)
    for then in (None, "nth"):
        out = leads_io.in_order(df, then=then, rows_a_part=100)
        got = [r.row_id for r in out.collect()]
        assert got == [i for i in range(3000) if i % 3] + [None] * 1000
        sizes = [len(p) for p in out.rdd.glom().collect()]
        assert len(sizes) == 40 and max(sizes) <= 150  # those without a number are spread as well
    assert [r.nth for r in out.collect()][2000:] == list(range(0, 3000, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "rangepartitioning" not in plan  # one of them is the test's own
    assert leads_io.in_order(df.where("false")).collect() == []


@pytest.mark.parametrize("fails", ["write", "swap"])
def test_a_failed_csv_append_leaves_the_file_whole(spark, tmp_path, monkeypatch, fails):
    path = str(tmp_path / "leads")
    append_dataset(spark, path, spark.createDataFrame([("a", "x", "u")], NEW), fmt="csv")
    before, real = read(path), files.move

    def broken(session, old, new):
        if ".new-" in old:
            raise OSError("no space")
        real(session, old, new)

    if fails == "write":
        monkeypatch.setattr(leads_io, "CSV_WRITE", {**leads_io.CSV_WRITE, "compression": "no such codec"})
    else:
        monkeypatch.setattr(leads_io.files, "move", broken)
    with pytest.raises(Exception):
        append_dataset(spark, path, spark.createDataFrame([("b", "x", "v")], NEW), fmt="csv")
    assert read(path) == before and os.listdir(tmp_path) == ["leads"]
