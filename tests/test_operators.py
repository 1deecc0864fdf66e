"""Operators on literal rows: generation, search, CSV, skew, streaming."""

import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from canvass.operators.fuzzy import fuzzy_lookup
from canvass.operators.generate import generate
from canvass.operators.lookup import catalogue_by_key, lookup
from canvass.operators.merge import merge_back, result_metrics
from canvass.operators.search import (EARTH_RADIUS_M, search_many, search_places,
                                      within_radius, within_radius_many)
from canvass.plans.enrich import enrich_leads
from canvass.sources.leads_io import read_leads_csv, write_leads
from canvass.sources.responses import collect_pages
from canvass.streaming.append import stream_append

from conftest import rows


def _flaky(prompts: pd.Series):
    if prompts.str.contains("boom").any():
        raise RuntimeError("model overloaded " + "x" * 200)
    return ["  ok:" + p[:6] + "  " for p in prompts]


def test_generate_isolates_row_failures_and_resumes(spark):
    leads = spark.createDataFrame([
        (0, "Alpha", None), (1, "boom inc", None), (2, "Gamma", "  "), (3, "Delta", "kept"),
        (4, "Eps", "Error: LLM error: old")],
        "row_id bigint, company_name string, generated_email string")
    tpl = "{company_name}"
    out = {r["row_id"]: r["generated_email"]
           for r in generate(leads, _flaky, tpl).collect()}
    assert out[0] == "ok:Alpha" and out[2] == "ok:Gamma"
    assert out[1] == "Error: LLM error: model overloaded " + "x" * (100 - len("model overloaded "))
    assert out[3] == "kept" and out[4] == "Error: LLM error: old"
    retry = {r["row_id"]: r["generated_email"]
             for r in generate(leads, _flaky, tpl, retry_errors=True).collect()}
    assert retry[4] == "ok:Eps"


def test_generate_unknown_variable_fails_before_running(spark):
    leads = spark.createDataFrame([(0, "a")], "row_id bigint, company_name string")
    with pytest.raises(KeyError):
        generate(leads, _flaky, "{nope}")


def _hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = (math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2)
         * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2)
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(x)))


def test_radius_many_matches_brute_force_incl_poles_and_antimeridian(spark):
    rnd = random.Random(7)
    pts = [(f"p{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(1500)]
    pts += [("edge_e", 10.0, 179.9), ("edge_w", 10.0, -179.9), ("pole", 89.95, 42.0),
            ("pole2", 89.9, -140.0)]
    centres = [(0, 10.0, 179.95), (1, 89.99, 0.0), (2, -45.0, 12.0), (3, 60.0, -179.0)]
    places = spark.createDataFrame(pts, "place_id string, lat double, lng double")
    cdf = spark.createDataFrame(centres, "centre_id int, lat double, lng double")
    r = 900_000.0
    got = {(x["centre_id"], x["place_id"]) for x in
           within_radius_many(places, cdf, r, cell_deg=2.0).collect()}
    want = {(c, p) for c, cl, cg in centres for p, pl, pg in pts if _hav(cl, cg, pl, pg) <= r}
    assert got == want and ("edge_w" in {p for c, p in got if c == 0})
    auto = {(x["centre_id"], x["place_id"]) for x in
            within_radius_many(places, cdf, r).collect()}      # cells sized to the radius
    assert auto == want
    one = {x["place_id"] for x in within_radius(places, 10.0, 179.95, r).collect()}
    assert one == {p for c, p in want if c == 0}


def test_search_single_and_many_rank_ties(spark):
    places = spark.createDataFrame([
        ("p1", "Alpha Dental", "Austin TX", "dentist", 10),
        ("p2", "Beta Dental", "Austin TX", "dentist", None),
        ("p3", "Gamma Dental Care", "Dallas TX", "dentist", 10),
        ("p4", "Delta Bakery", "Austin TX", "bakery", 99)],
        "place_id string, name string, address string, category string, review_count bigint")
    top = [r["place_id"] for r in search_places(places, "Dental Austin", 3).collect()]
    assert top == ["p1", "p2", "p4"]  # p4: score 1 with 99 reviews beats p3 (10)
    qs = spark.createDataFrame([("q1", "dental austin"), ("q2", "bakery")], "query_id string, query string")
    many = rows(search_many(places, qs, 2), "query_id", "rank", "place_id")
    assert many == [("q1", 1, "p1"), ("q1", 2, "p2"), ("q2", 1, "p4")]


def test_paging_rules(spark):
    import json
    def body(ids, token=True, places=True):
        d = {"nextPageToken": "t"} if token else {}
        if places:
            d["places"] = [{"id": i, "displayName": {"text": i}} for i in ids]
        return json.dumps(d)
    resp = spark.createDataFrame([
        ("a", 0, 200, body(["a1", "a2"])), ("a", 1, 500, "{}"), ("a", 2, 200, body(["a3"])),
        ("b", 0, 200, body(["b1"], token=False)), ("b", 1, 200, body(["b2"])),
        ("c", 0, 200, body([])), ("c", 1, 200, body(["c1", "c2", "c3"])),
        ("d", 0, 200, body(["d1"])), ("d", 1, 200, body([], places=False)),
        ("d", 2, 200, body(["d2"]))], "query string, page int, status int, body string")
    got = rows(collect_pages(resp, max_results=2), "query", "company_name")
    assert got == [("a", "a1"), ("a", "a2"), ("b", "b1"), ("c", "c1"), ("c", "c2"), ("d", "d1")]


def test_csv_round_trip_quotes_newlines_and_tokens(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Company Name,Company Address,Contact Email,google_review_count\n'
                '"Acme, Inc.","1 Main St\nSuite 2",a@x.com,127.0\n'
                '"Say ""hi""",  ,N/A,Not Found\n')
    df = read_leads_csv(spark, path)
    got = rows(df.withColumn("row_id", F.lit(0)), "company_name", "company_address",
               "Contact Email", "review_count")
    assert got == sorted([("Acme, Inc.", "1 Main St\nSuite 2", "a@x.com", 127),
                          ('Say "hi"', "  ", None, None)], key=repr)
    out = str(tmp_path / "out")
    write_leads(df.withColumn("row_id", F.monotonically_increasing_id()), out, fmt="csv")
    back = read_leads_csv(spark, out)
    assert rows(back, "company_name", "company_address") == rows(df, "company_name", "company_address")


def test_calls_see_each_prompt_once(spark, tmp_path):
    import glob

    leads = spark.range(40).selectExpr("id as row_id", "concat('Shop ', id) as company_name")
    seen = str(tmp_path)

    def counting(prompts):
        import uuid
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        if len(prompts) > 1 and any(p.endswith("7") for p in prompts):
            raise RuntimeError("down")
        return [ValueError("odd") if p.endswith("3") else p for p in prompts]

    out = {r["row_id"]: r["generated_email"]
           for r in generate(leads, counting, "{company_name}", batch_rows=4).collect()}
    prompts = [line for f in glob.glob(seen + "/*") for line in open(f).read().split("\n")]
    assert len(prompts) == 40 == len(set(prompts))
    assert out[0] == "Shop 0" and out[3] == "Error: LLM error: odd" and out[7] == "Error: LLM error: down"


def test_a_hot_key_is_split_at_run_time(spark):
    """A key of a third of all leads: adaptive execution marks the join as skewed; rows are as in a plain join."""
    n = 60000
    leads = spark.range(n).selectExpr(
        "id as row_id", "if(id % 3 = 0, 'Hot Shop', concat('Shop ', id)) as company_name", "'Main St' as company_address",
        "cast(null as double) as rating", "cast(null as bigint) as review_count", "cast(null as string) as maps_url",
        "sha2(cast(id as string), 512) as extra").repartition(6)
    places = spark.range(0, n, 2).selectExpr(
        "concat('p', id) as place_id", "if(id = 0, 'Hot Shop', concat('Shop ', id)) as name", "'Main St' as address",
        "4.0D as rating", "id as review_count", "concat('u', id) as maps_url")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = enrich_leads(leads, places)
        assert got.count() == n
        out = got.groupBy("maps_url", "error").count()
        hot = out.where("maps_url = 'u0'").first()["count"]
        assert hot == n // 3
        joined = enrich_leads(leads, places).select("row_id", "extra", "maps_url")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_skew_safe_anti_join(spark):
    from canvass.operators.skew import skew_safe_join
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)],
                                 "row_id bigint, k string")
    right = spark.createDataFrame([("hot",), ("k3",)], "k string")
    plain = rows(left.join(right, ["k"], "left_anti"), "row_id")
    split = rows(skew_safe_join(left, right, ["k"], "left_anti"), "row_id")
    assert plain == split and len(split) == 299


def test_fuzzy_lookup_edit_distance(spark):
    leads = spark.createDataFrame(
        [(1, "Alpah Dental", "Main St"), (2, "Alpha Dentl", "Main St"), (3, "Alhpa Dnetal", "Main St"),
         (4, "Alpha Dental", "Other St")],
        "row_id bigint, company_name string, company_address string")
    places = spark.createDataFrame([("p1", "Alpha Dental", "Main St", 1.0, 5, "u1")],
                                   "place_id string, name string, address string, rating double, "
                                   "review_count bigint, maps_url string")
    out = {r["row_id"]: (r["place_id"], r["distance"])
           for r in fuzzy_lookup(leads, catalogue_by_key(places)).collect()}
    # transposition = 2 edits: no match; deletion = 1 edit: match
    assert out == {1: (None, None), 2: ("p1", 1), 3: (None, None), 4: (None, None)}


def test_merge_back_and_metrics(spark):
    full = spark.createDataFrame([(0, "a", None), (1, "b", None), (2, "c", "")],
                                 "row_id bigint, company_name string, generated_email string")
    part = spark.createDataFrame([(1, "B", "mail")], "row_id bigint, company_name string, generated_email string")
    assert rows(merge_back(full, part), "row_id", "company_name") == [(0, "a"), (1, "B"), (2, "c")]
    m = result_metrics(merge_back(full, part)).collect()[0].asDict()
    assert m == {"total_rows": 3, "total_columns": 3, "texts_generated": 2, "texts_blank": 1}


def test_stream_append_dedups_each_batch_against_target(spark, tmp_path):
    target, incoming = str(tmp_path / "target"), str(tmp_path / "incoming")
    spark.createDataFrame([(0, "A", "x", "u0")], "row_id bigint, company_name string, "
                          "company_address string, maps_url string").write.parquet(target)
    schema = "row_id bigint, company_name string, company_address string, maps_url string"
    spark.createDataFrame([(1, "A2", "x", "u0"), (2, "B", "y", "u2")], schema) \
        .write.parquet(incoming + "/b1")
    stream = spark.readStream.schema(schema).parquet(incoming + "/*")
    q = stream_append(stream, target, checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert rows(spark.read.parquet(target), "row_id") == [(0,), (2,)]
    assert os.path.exists(tmp_path / "ck")


def test_prepare_for_enrich_prefers_business_headers_and_requires_key(spark):
    from canvass.plans.enrich import prepare_for_enrich
    raw = spark.createDataFrame([("c", "b", "addr", "4.5", "12.0")],
                                "`Company Name` string, `business_name` string, "
                                "`Business-Address` string, `Google Review Rating` string, "
                                "` google review count ` string")
    df = prepare_for_enrich(raw)
    r = df.collect()[0]
    assert r["company_name"] == "b" and r["company_address"] == "addr"
    assert r["rating"] == 4.5 and r["review_count"] == 12
    assert "Company Name" in df.columns  # the non-preferred header passes through
    with pytest.raises(ValueError, match="available columns"):
        prepare_for_enrich(spark.createDataFrame([("x",)], "Name string"))


def test_append_dataset_appends_only_new_rows(spark, tmp_path):
    from canvass.sources.leads_io import append_dataset
    path = str(tmp_path / "leads")
    schema = "company_name string, company_address string, maps_url string"
    first = spark.createDataFrame([("A", "x", "u1"), ("B", "y", "u2")], schema)
    assert append_dataset(spark, path, first) == 2
    second = spark.createDataFrame([("A", "x", "u1"), ("C", "z", "u3")], schema)
    assert append_dataset(spark, path, second) == 1
    assert append_dataset(spark, path, second) == 0
    assert rows(spark.read.parquet(path), "maps_url") == [("u1",), ("u2",), ("u3",)]


def test_row_ids_follow_file_and_line_order(spark, tmp_path):
    from canvass.sources.leads_io import read_leads_csv, with_row_id
    d = tmp_path / "csvs"
    d.mkdir()
    (d / "a.csv").write_text('Company Name,Company Address\n"A, one","x\ny"\nB,z\n')
    (d / "b.csv").write_text('Company Name,Company Address\nC,w\nD,v\nE,u\n')
    df = read_leads_csv(spark, str(d), row_id=True)
    assert rows(df, "row_id", "company_name") == [
        (0, "A, one"), (1, "B"), (2, "C"), (3, "D"), (4, "E")]
    p = str(tmp_path / "pq")
    spark.range(0, 1000, numPartitions=7).write.parquet(p)
    got = with_row_id(spark.read.parquet(p)).collect()
    assert sorted(r["row_id"] for r in got) == list(range(1000))


def test_blank_url_rows_depend_on_blank_existing_key(spark):
    from canvass.operators.append import new_rows
    schema = "company_name string, company_address string, maps_url string"
    new = spark.createDataFrame([("A", "x", None), ("B", "y", " "), ("C", "z", "u3")], schema)
    plain = spark.createDataFrame([("E", "e", "u1"), ("F", "f", None)], schema)
    assert rows(new_rows(plain, new), "company_name") == [("A",), ("B",), ("C",)]
    with_blank = spark.createDataFrame([("E", "e", "u1"), ("G", "g", "   ")], schema)
    assert rows(new_rows(with_blank, new), "company_name") == [("C",)]


def test_csv_headers_differing_by_case_stay_distinct(spark, tmp_path):
    from canvass.sources.leads_io import read_leads_csv, unique_headers
    assert unique_headers(["a", "A", "a", "b"]) == ["a", "A.1", "a.2", "b"]
    path = tmp_path / "h.csv"
    path.write_text("Company Name,Notes,notes\nA,x,y\n")
    df = read_leads_csv(spark, str(path))
    assert df.columns == ["company_name", "Notes", "notes.1"]
    r = df.collect()[0]
    assert (r["Notes"], r["notes.1"]) == ("x", "y")


def test_web_snapshot_status_and_duplicate_urls(spark):
    from canvass.plans.web import enrich_web
    leads = spark.createDataFrame(
        [(0, "Ok Co", "a.example", None), (1, "Gone Co", "https://b.example", None),
         (2, "Twice", "https://c.example", None), (3, "Kept", "https://a.example", "done before")],
        "row_id bigint, company_name string, website string, research_brief string")
    pages = spark.createDataFrame(
        [("https://a.example", "<title>A</title><p>About A</p>", 200),
         ("https://b.example", "<title>B</title>", 404),
         ("https://c.example", "<title>C</title>", 200),
         ("https://c.example", "<title>C</title><meta name=description content='Cc'>", 200)],
        "url string, html string, status int")
    out = {r["row_id"]: r["research_brief"] for r in enrich_web(leads, pages).collect()}
    assert out == {0: "Ok Co: About A", 1: "Could not fetch: Request failed: HTTP 404",
                   2: "Twice: Cc", 3: "done before"}
