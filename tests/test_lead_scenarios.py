"""Lead-table behaviour on small tables of our own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from canvass.operators.append import append_new
from canvass.operators.columns import found_headers, to_external, to_internal
from canvass.plans.enrich import enrich, enrich_reviews
from canvass.schema import MSG_NOT_FOUND
from canvass.sources.leads_io import write_enriched
from canvass.sources.responses import harmonise_places, lookup_outcome

from conftest import rows

PLACE = ("place_id string, name string, address string, rating double, review_count bigint, "
         "maps_url string")
LEAD = ("row_id bigint, company_name string, company_address string, rating double, "
        "review_count bigint, maps_url string")


@pytest.mark.parametrize("status, body, place_id, error", [
    (200, {"places": []}, None, MSG_NOT_FOUND),
    (200, {"took_ms": 3}, None, MSG_NOT_FOUND),
    (200, {"places": [{"id": "harbour-cafe"}, {"id": "harbour-bar"}]}, "harbour-cafe", None),
    (429, {"error": {"message": "slow down"}}, None, "API error: slow down"),
    (503, {}, None, "API error: HTTP 503"),
])
def test_outcome_of_a_captured_response(spark, status, body, place_id, error):
    df = spark.createDataFrame([("q", 0, status, json.dumps(body))],
                               "query string, page int, status int, body string")
    r = lookup_outcome(df).first()
    assert (r["place_id"], r["error"]) == (place_id, error)


def test_no_leads_give_an_output_and_no_error_table(spark, tmp_path):
    res = enrich(spark.createDataFrame([], LEAD), spark.createDataFrame([], PLACE))
    out, err = tmp_path / "leads", tmp_path / "problems"
    assert write_enriched(res, str(out), str(err)) == 0
    assert os.path.isdir(out) and not os.path.exists(err)
    assert res.summary.first()["total"] == 0


def test_states_updates_errors_and_summary(spark):
    leads = spark.createDataFrame([
        (10, "  ", "Quay 1", None, None, None),
        (11, "Lighthouse Books", "Quay 2", 3.9, 41, "map://books"),
        (12, "Net Menders", "Quay 3", 4.4, 7, "Not Found"),
        (13, "Rope & Sail", "Quay 4", None, 0, "map://old"),
        (14, "Ghost Ship", "Quay 5", None, None, None),
        (15, "Zero Stars", "Quay 6", 0.0, 0, " "),
    ], LEAD)
    places = spark.createDataFrame([
        ("n", "NET  menders", "quay 3", 1.5, 900, "map://net"),
        ("r", "Rope & Sail ", "Quay 4", None, None, "map://rope"),
        ("z", "zero stars", "Quay 6", 5.0, 5, None)], PLACE)
    res = enrich(leads, places)
    got = {r["row_id"]: (r["plan_state"], r["rating"], r["review_count"], r["maps_url"], r["error"])
           for r in res.leads.collect()}
    assert got == {
        10: ("invalid", None, None, None, "Missing business name or address"),
        11: ("complete", 3.9, 41, "map://books", None),
        12: ("url_only", 4.4, 7, "map://net", None),
        13: ("full", None, None, "map://rope", None),   # a hit overwrites, with nulls too
        14: ("full", None, None, None, MSG_NOT_FOUND),
        15: ("url_only", 0.0, 0, None, None)}             # zero is a value
    assert [r["row"] for r in res.errors.orderBy("row").collect()] == [12, 16]
    assert res.summary.first().asDict() == {
        "total": 6, "skipped_complete": 1, "url_only_fetched": 2, "full_fetched": 2,
        "successful": 4, "failed": 2}


def test_summary_is_counted_while_writing(spark, tmp_path):
    leads = spark.createDataFrame([(4, "Crab Shack", "Pier", None, None, None),
                                   (5, None, "Pier", None, None, None)], LEAD)
    places = spark.createDataFrame([("c", "Crab Shack", "Pier", 4.1, 6, "map://crab")], PLACE)
    seen = {}
    assert write_enriched(enrich(leads, places), str(tmp_path / "a"), str(tmp_path / "b"),
                          summary=seen) == 1
    assert seen == {"total": 2, "skipped_complete": 0, "url_only_fetched": 0, "full_fetched": 1,
                    "failed": 1, "successful": 1}
    assert spark.read.parquet(str(tmp_path / "b")).first()["row"] == 7


def _batch(spark, *names):
    return spark.createDataFrame([(n, f"{n} road", f"map://{n}") for n in names],
                                 "company_name string, company_address string, maps_url string")


def test_append_by_link(spark):
    out = append_new(_batch(spark, "fern", "moss"), _batch(spark, "moss", "reed", "reed"))
    assert [r[0] for r in rows(out, "company_name")] == ["fern", "moss", "reed", "reed"]


def test_append_by_name_and_address(spark):
    known = _batch(spark, "fern", "moss").drop("maps_url")
    new = _batch(spark, "reed").unionByName(spark.createDataFrame(
        [("  MOSS ", "moss   ROAD", "map://elsewhere")],
        "company_name string, company_address string, maps_url string"))
    out = append_new(known, new)
    assert [r[0] for r in rows(out, "company_name")] == ["fern", "moss", "reed"]


def test_append_to_a_table_with_its_own_headers(spark):
    known = _batch(spark, "fern").select(
        F.col("company_name").alias("Business Name"), F.col("maps_url").alias("google_maps_url"),
        F.lit("kept").alias("Owner"))
    out = append_new(known, _batch(spark, "fern", "reed"))
    assert out.columns == ["Business Name", "google_maps_url", "Owner", "Company Address"]
    assert rows(out) == [("fern", "map://fern", "kept", None), ("reed", "map://reed", None, "reed road")]


def test_headers_come_back_as_they_were(spark):
    df = spark.createDataFrame([("a", "b", "1,234")], "`Business Name` string, extra string, google_review_count string")
    headers = found_headers(df.columns)
    inner = to_internal(df, typed=False)
    assert inner.columns == ["company_name", "extra", "review_count"]
    assert inner.first()["review_count"] == "1,234"
    assert to_external(inner, headers).columns == df.columns


def test_records_of_both_generations(spark):
    new = spark.createDataFrame([("Tide Clock", "Pier 9", "tide.example", 4.0, 8)],
                                "`Company Name` string, `Company Address` string, `Website` string, "
                                "`Google Review Rating` double, `Google Review Count` bigint")
    old = spark.createDataFrame([("Old Mill", "Weir 2", "mill.example", 3.5, 2)],
                                "name string, address string, website string, rating double, review_count bigint")
    for df, want in ((new, ("Tide Clock", 4.0, 8, "")), (old, ("Old Mill", 3.5, 2, ""))):
        r = harmonise_places(df).first()
        assert (r["company_name"], r["rating"], r["review_count"], r["company_phone"]) == want


def test_reviews_fill_only_what_is_missing(spark):
    leads = spark.createDataFrame([(0, "Gull Inn", "Bay", None, None, None), (1, "Gull Inn", "Bay", 2.0, 3, None),
                                   (2, "Nowhere Inn", "Bay", None, 4, None)], LEAD)
    places = spark.createDataFrame([("g", "gull inn", "bay", 4.6, 77, "map://gull")], PLACE)
    assert rows(enrich_reviews(leads, places), "row_id", "rating", "review_count") == [
        (0, 4.6, 77), (1, 2.0, 3), (2, None, 4)]
