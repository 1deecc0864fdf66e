"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the shared fixture SQL) and
runs the library operator over all of their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from ..functions.html import brief, page_features
from ..functions.text import miles_to_metres, parse_location_col
from ..operators.append import append_new, append_summary
from ..operators.columns import to_internal
from ..operators.search import search_many, search_places, within_radius_many
from .enrich import enrich_leads, enrich_reviews, enrich_summary, errors_of, with_plan_state
from .jobs import enrich_file
from .web import enrich_web
from .run import run as run_stages
from .run import run_preview, run_rest
from .search import search
from ..functions.template import DEFAULT_TEMPLATE
from ..operators.generate import generate, upper_generator, with_prompts
from ..operators.merge import merge_back, preview, result_metrics, resume, resume_start
from ..operators.fuzzy import fuzzy_lookup
from ..operators.lookup import catalogue_by_key
from ..session import scratch_path
from ..streaming.append import stream_append
from ..sources.leads_io import CSV_WRITE, append_dataset, read_leads_csv, write_leads
from ..sources.pluggable import read_pages
from ..sources.responses import (collect_pages, flatten_responses, harmonise_places,
                                 lookup_outcome)

LEAD_OUT = ["row_id", "company_name", "company_address", "company_phone", "website",
            "rating", "review_count", "maps_url"]


def _leads(spark, sf):
    return fx.fixture(spark, sf, fx.F_LEADS)


def _places(spark, sf):
    return fx.fixture(spark, sf, fx.F_PLACES)


def enrich_classify(spark: SparkSession, sf: str) -> DataFrame:
    return with_plan_state(_leads(spark, sf)).select("row_id", "plan_state")


def enrich_lookup(spark: SparkSession, sf: str) -> DataFrame:
    res = enrich_leads(_leads(spark, sf), _places(spark, sf))
    return res.select(*LEAD_OUT, "plan_state", "error")


def enrich_errors(spark: SparkSession, sf: str) -> DataFrame:
    res = enrich_leads(_leads(spark, sf), _places(spark, sf))
    return errors_of(res, with_time=False)


def enrich_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_summary(enrich_leads(_leads(spark, sf), _places(spark, sf)))


def review_lookup(spark: SparkSession, sf: str) -> DataFrame:
    leads = _leads(spark, sf).drop("maps_url")
    return enrich_reviews(leads, _places(spark, sf)).select(
        "row_id", "company_name", "rating", "review_count")


# --- search ---------------------------------------------------------------

SEARCH_QUERIES_SQL = """
SELECT DISTINCT lower(c.c_mktsegment) || ' ' || r.r_name AS query_id,
                lower(c.c_mktsegment) || ' ' || r.r_name AS query
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
CENTRES_SQL = """
SELECT n_nationkey AS centre_id, CAST(-55 + 4.5 * n_nationkey AS DOUBLE) AS lat,
       CAST(-160 + 13 * n_nationkey AS DOUBLE) AS lng FROM nation
"""
SINGLE_QUERY = "building machinery america"
SINGLE_CENTRE = (30.2672, -97.7431)
SINGLE_RADIUS_MILES = 1000
RADIUS_M = 800000.0


def search_text_topn(spark, sf):
    places = _places(spark, sf)
    qs = fx.fixture(spark, sf, SEARCH_QUERIES_SQL)
    res = search_many(places, qs, max_results=20, payload=("name",))
    return res.select("query_id", "rank", "place_id", "score", "review_count", "name")


def search_single(spark, sf):
    res = search_places(_places(spark, sf), SINGLE_QUERY, max_results=20,
                        location=SINGLE_CENTRE, radius_m=miles_to_metres(SINGLE_RADIUS_MILES))
    return res.select("place_id", "name", "score", "review_count",
                      F.round("distance_m").cast("bigint").alias("distance_m"))


def search_radius(spark, sf):
    res = within_radius_many(_places(spark, sf), fx.fixture(spark, sf, CENTRES_SQL), RADIUS_M)
    return res.select("centre_id", "place_id",
                      F.round("distance_m").cast("bigint").alias("distance_m"))


# --- append ---------------------------------------------------------------

APPEND_OUT = ["row_id", "company_name", "company_address", "maps_url", "company_phone",
              "website", "rating", "review_count"]


def append_by_url(spark, sf):
    ex, new = fx.fixture(spark, sf, fx.F_APPEND_EXISTING), fx.fixture(spark, sf, fx.F_APPEND_NEW)
    return append_new(ex, new).select(*APPEND_OUT)


def append_by_name_addr(spark, sf):
    ex = fx.fixture(spark, sf, fx.F_APPEND_EXISTING_NO_URL)
    new = fx.fixture(spark, sf, fx.F_APPEND_NEW)
    return append_new(ex, new).select(*APPEND_OUT)


def append_summary_q(spark, sf):
    ex, new = fx.fixture(spark, sf, fx.F_APPEND_EXISTING), fx.fixture(spark, sf, fx.F_APPEND_NEW)
    return append_summary(ex, new)


# --- web pages ------------------------------------------------------------

def page_social_links(spark, sf):
    pages = fx.fixture(spark, sf, fx.F_HTML)
    return page_features(pages, keep=("page_id",)).select(
        "page_id", "linkedin_url", "facebook_url", "instagram_url", "twitter_url")


def page_brief(spark, sf):
    pages = fx.fixture(spark, sf, fx.F_HTML)
    f = page_features(pages, keep=("page_id",))
    name = F.concat(F.lit("Shop "), F.col("page_id").cast("string"))
    return f.select("page_id", "title", "description",
                    brief(name, F.col("title"), F.col("description")).alias("research_brief"))


def web_enrich(spark, sf):
    leads = fx.fixture(spark, sf, fx.F_WEB_LEADS)
    pages = fx.fixture(spark, sf, fx.F_HTML)
    return enrich_web(leads, pages, mode="batch").select(
        "row_id", "website", "linkedin_url", "facebook_url", "instagram_url", "twitter_url",
        "research_brief")


def web_enrich_interactive(spark, sf):
    leads = fx.fixture(spark, sf, fx.F_WEB_LEADS)
    pages = fx.fixture(spark, sf, fx.F_HTML)
    return enrich_web(leads, pages, mode="interactive").select(
        "row_id", "website", "linkedin_url", "facebook_url", "instagram_url", "twitter_url",
        "research_brief")


# --- prompts and generation -------------------------------------------------

PRODUCT = "Acme booking: fills {website} calendars for {company_name}"


def _email_leads(spark, sf):
    return fx.fixture(spark, sf, fx.F_EMAIL_LEADS)


def render_prompts(spark, sf):
    return with_prompts(_email_leads(spark, sf), DEFAULT_TEMPLATE, PRODUCT).select("row_id", "prompt")


def generate_resume(spark, sf):
    out = generate(_email_leads(spark, sf), upper_generator, DEFAULT_TEMPLATE, PRODUCT,
                   retry_errors=False)
    return out.select("row_id", "generated_email")


def generate_retry(spark, sf):
    out = generate(_email_leads(spark, sf), upper_generator, DEFAULT_TEMPLATE, PRODUCT,
                   retry_errors=True)
    return out.select("row_id", "generated_email")


def generate_journal(spark, sf):
    """Texts through a journal that an earlier run over a part of the rows has filled."""
    journal = _scratch(spark, "journal")
    leads = _email_leads(spark, sf)
    generate(leads.where("row_id % 4 = 0"), upper_generator, DEFAULT_TEMPLATE, PRODUCT, journal=journal)
    out = generate(leads, upper_generator, DEFAULT_TEMPLATE, PRODUCT, journal=journal)
    return out.select("row_id", "generated_email")


# --- captured responses -------------------------------------------------------

def flatten_responses_q(spark, sf):
    return flatten_responses(fx.responses(spark, sf))


def source_pages(spark, sf):
    """Captured pages on disk, read through the pluggable source."""
    path = _scratch(spark, "captured")
    fx.responses(spark, sf).write.parquet(path)
    return flatten_responses(read_pages(spark, path=path))


def paged_collect(spark, sf):
    return collect_pages(fx.responses(spark, sf), max_results=20)


def response_outcome(spark, sf):
    return lookup_outcome(fx.responses(spark, sf))


def field_coalesce(spark, sf):
    new = fx.fixture(spark, sf, fx.F_RECORDS_NEW)
    old = fx.fixture(spark, sf, fx.F_RECORDS_LEGACY)
    both = new.unionByName(old, allowMissingColumns=True)
    return harmonise_places(both, keep=("rec_id",))


# --- preview / resume / metrics ---------------------------------------------

def _review_stage(spark, sf):
    places = _places(spark, sf)
    return lambda df: enrich_reviews(df, places)


def preview_merge(spark, sf):
    leads = _leads(spark, sf).drop("maps_url")
    return preview(leads, _review_stage(spark, sf), n=10).select(
        "row_id", "company_name", "rating", "review_count")


def resume_tail(spark, sf):
    leads = _leads(spark, sf).drop("maps_url")
    start = resume_start(leads, 10)
    return resume(leads, _review_stage(spark, sf), start).select(
        "row_id", "company_name", "rating", "review_count")


def result_metrics_q(spark, sf):
    return result_metrics(_email_leads(spark, sf))


# --- CSV round trip -----------------------------------------------------------

def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


SHEET_HEADERS = {"business_name": "Business Name", "business_address": "Business Address", "notes": "My notes",
                 "rating": "google_review_rating", "review_count": "Google Review Count",
                 "maps_url": "Google Maps URL"}


def _sheet(spark, sf):
    """A user's spreadsheet as a CSV file set with the user's own headers, in row order."""
    path = _scratch(spark, "sheet")
    df = fx.fixture(spark, sf, fx.F_SHEET).repartitionByRange(24, "row_id").sortWithinPartitions("row_id")
    df.select(*[F.col(k).alias(v) for k, v in SHEET_HEADERS.items()]).write.options(**CSV_WRITE).csv(path)
    return path


def csv_roundtrip(spark, sf):
    """Typed leads out to CSV and back: every cell of every row."""
    path = _scratch(spark, "csv-roundtrip")
    write_leads(_leads(spark, sf), path, fmt="csv")
    return read_leads_csv(spark, path).select(*LEAD_OUT[1:])


def csv_row_ids(spark, sf):
    """Row positions over two dozen CSV parts, with cells as the file has them."""
    back = read_leads_csv(spark, _sheet(spark, sf), internal=False, row_id=True)
    return back.select("row_id", *[F.col(f"`{v}`").alias(k) for k, v in SHEET_HEADERS.items()])


def enrich_csv(spark, sf):
    """The file-to-file enrichment of a user's spreadsheet, read back as text."""
    out = _scratch(spark, "sheet-enriched")
    enrich_file(spark, _sheet(spark, sf), out, _places(spark, sf))
    back = read_leads_csv(spark, out, internal=False, row_id=True)
    return back.select("row_id", *[F.col(f"`{v}`").alias(k) for k, v in SHEET_HEADERS.items()])


def enrich_errors_written(spark, sf):
    """The written error table of the same job (all but its time stamps)."""
    out, errors = _scratch(spark, "sheet-enriched"), _scratch(spark, "sheet-errors")
    enrich_file(spark, _sheet(spark, sf), out, _places(spark, sf), errors_path=errors)
    back = read_leads_csv(spark, errors, internal=False)
    return back.select(F.col("row").cast("bigint").alias("row"), "business_name", "business_address", "error")


def resolve_headers(spark, sf):
    """Loose header resolution: a user's headers to internal names and types."""
    raw = fx.fixture(spark, sf, fx.F_SHEET).select(
        "row_id", F.col("business_name").alias(" business-NAME "), F.col("business_address").alias("Company_Address"),
        F.col("rating").alias("GOOGLE review rating"), F.col("review_count").alias("google-review-count"))
    return to_internal(raw).select("row_id", "company_name", "company_address", "rating", "review_count")


LOCATION_SQL = """
SELECT c_custkey AS place, CASE WHEN c_custkey % 5 = 4 THEN c_name WHEN c_custkey % 31 = 0 THEN '1,2,' || c_mktsegment
  ELSE CAST(c_custkey % 60 - 30 AS STRING) || ', ' || CAST(c_acctbal / 100 AS STRING) END AS location FROM customer
"""


def parse_locations(spark, sf):
    p = parse_location_col("location")
    return fx.fixture(spark, sf, LOCATION_SQL).select("place", p["lat"].alias("lat"), p["lng"].alias("lng"))


def merge_back_q(spark, sf):
    """Write-back of an enriched subset (the rows that lack a rating) by row id."""
    leads = _leads(spark, sf).drop("maps_url")
    part = enrich_reviews(leads.where(F.col("rating").isNull()), _places(spark, sf))
    return merge_back(leads, part).select("row_id", "company_name", "rating", "review_count")


def append_external_headers(spark, sf):
    """Append to a table whose headers are a spreadsheet's."""
    ex = fx.fixture(spark, sf, fx.F_APPEND_EXISTING).select(
        "row_id", F.col("company_name").alias("Business Name"), F.col("company_address").alias("company-address"),
        F.col("maps_url").alias("google_maps_url"))
    out = append_new(ex, fx.fixture(spark, sf, fx.F_APPEND_NEW))
    return out.select("row_id", F.col("Business Name").alias("company_name"), F.col("`company-address`").alias("company_address"),
                      F.col("google_maps_url").alias("maps_url"), F.col("Company Phone").alias("company_phone"),
                      F.col("Google Review Rating").alias("rating"))


def append_dataset_q(spark, sf):
    path = _scratch(spark, "dataset")
    fx.fixture(spark, sf, fx.F_APPEND_EXISTING).write.parquet(path)
    new = fx.fixture(spark, sf, fx.F_APPEND_NEW)
    append_dataset(spark, path, new)
    append_dataset(spark, path, new.where("maps_url != ''"))   # nothing new the second time
    return spark.read.option("mergeSchema", "true").parquet(path).select(*APPEND_OUT)


def append_indexed(spark, sf):
    """Three appends by the persisted key index: a third of the table is written behind its back."""
    path = _scratch(spark, "append-indexed")
    ex, new = fx.fixture(spark, sf, fx.F_APPEND_EXISTING), fx.fixture(spark, sf, fx.F_APPEND_NEW)
    late = F.pmod(F.xxhash64("row_id"), F.lit(3)) == 0
    ex.where(~late).write.parquet(path)
    append_dataset(spark, path, new.limit(0), indexed=True)     # builds the index
    ex.where(late).write.mode("append").parquet(path)           # another writer
    append_dataset(spark, path, new, indexed=True)
    append_dataset(spark, path, new.where("maps_url != ''"), indexed=True)   # nothing new
    return spark.read.option("mergeSchema", "true").parquet(path).select(*APPEND_OUT)


def append_csv(spark, sf):
    """Append to a CSV file under its own headers."""
    path = _scratch(spark, "append-csv")
    ex = fx.fixture(spark, sf, fx.F_APPEND_EXISTING)
    ex.select(F.col("company_name").alias("Business Name"), F.col("company_address").alias("Company Address"),
              F.col("maps_url").alias("google_maps_url")).write.options(**CSV_WRITE).csv(path)
    append_dataset(spark, path, fx.fixture(spark, sf, fx.F_APPEND_NEW).drop("row_id"), fmt="csv")
    back = read_leads_csv(spark, path)
    return back.select("company_name", "company_address", "maps_url", "company_phone", "rating", "review_count")


# --- fuzzy fallback and streaming append -----------------------------------

def fuzzy_lookup_q(spark, sf, k=1):
    leads = fx.fixture(spark, sf, fx.F_FUZZY_LEADS)
    cat = catalogue_by_key(_places(spark, sf))
    return fuzzy_lookup(leads, cat, k).select(
        "row_id", "company_name", "company_address", "distance", "matched_name", "place_id",
        "rating", "review_count", "maps_url")


def fuzzy_lookup_2(spark, sf):
    return fuzzy_lookup_q(spark, sf, 2)


def fuzzy_lookup_3(spark, sf):
    return fuzzy_lookup_q(spark, sf, 3)


def enrich_fuzzy(spark, sf):
    """Enrichment of misspelled leads: up to two edits away where no place has the name itself."""
    res = enrich_leads(fx.fixture(spark, sf, fx.F_MISSPELT), _places(spark, sf), fuzzy=2)
    return res.select(*LEAD_OUT, "plan_state", "error")


def review_lookup_fuzzy(spark, sf):
    leads = fx.fixture(spark, sf, fx.F_MISSPELT).drop("maps_url")
    return enrich_reviews(leads, _places(spark, sf), fuzzy=1).select("row_id", "company_name", "rating", "review_count")


def stream_append_q(spark, sf):
    base = scratch_path(spark, f"stream-append-{uuid.uuid4().hex}")
    fx.fixture(spark, sf, fx.F_APPEND_EXISTING).write.parquet(base + "/target")
    new = fx.fixture(spark, sf, fx.F_APPEND_NEW)
    new.write.parquet(base + "/incoming")
    stream = spark.readStream.schema(new.schema).parquet(base + "/incoming")
    q = stream_append(stream, base + "/target", checkpoint=base + "/checkpoint",
                      available_now=True)
    q.awaitTermination()
    return (spark.read.option("mergeSchema", "true").parquet(base + "/target")
            .select(*APPEND_OUT))


# --- composite jobs ---------------------------------------------------------

def search_append(spark, sf):
    existing = fx.fixture(spark, sf, fx.F_APPEND_EXISTING)
    out = search(_places(spark, sf), SINGLE_QUERY, 20, SINGLE_CENTRE,
                 miles_to_metres(SINGLE_RADIUS_MILES), existing=existing)
    return out.select(*APPEND_OUT)


def staged_run(spark, sf):
    leads = fx.fixture(spark, sf, fx.F_WEB_LEADS)
    out = run_stages(leads, places=_places(spark, sf), pages=fx.fixture(spark, sf, fx.F_HTML),
                     mode="interactive", checkpoint=True)
    return out.select("row_id", "rating", "review_count", "linkedin_url", "facebook_url",
                      "instagram_url", "twitter_url", "research_brief")


RUN_TEMPLATE = "Business name: {company_name}, {rating} from {review_count}"


def staged_run_generate(spark, sf):
    """All three stages: reviews, website, generated text."""
    out = run_stages(fx.fixture(spark, sf, fx.F_WEB_LEADS), places=_places(spark, sf), pages=fx.fixture(spark, sf, fx.F_HTML),
                     mode="interactive", generator=upper_generator, template=RUN_TEMPLATE, product_description="-",
                     checkpoint=True)
    return out.select("row_id", "rating", "review_count", "linkedin_url", "research_brief", "generated_email")


def _staged(spark, sf):
    return dict(places=_places(spark, sf), pages=fx.fixture(spark, sf, fx.F_HTML), mode="interactive", checkpoint=True)


RUN_OUT = ["row_id", "rating", "review_count", "linkedin_url", "facebook_url", "instagram_url", "twitter_url",
           "research_brief"]


def run_preview_q(spark, sf):
    return run_preview(fx.fixture(spark, sf, fx.F_WEB_LEADS), n=10, **_staged(spark, sf)).select(*RUN_OUT)


def run_rest_q(spark, sf):
    return run_rest(fx.fixture(spark, sf, fx.F_WEB_LEADS), start=10, **_staged(spark, sf)).select(*RUN_OUT)


def run_continued(spark, sf):
    """A preview, then a run that finds by itself where the preview stopped; its stages are read, not run again."""
    leads, ledger = fx.fixture(spark, sf, fx.F_WEB_LEADS), _scratch(spark, "ledger")
    settings = dict(places=_places(spark, sf), pages=fx.fixture(spark, sf, fx.F_HTML), mode="interactive", ledger=ledger)
    run_preview(leads, n=10, **settings)
    return run_rest(leads, **settings).select(*RUN_OUT)


QUERIES = {
    "enrich_classify": enrich_classify,
    "enrich_lookup": enrich_lookup,
    "enrich_errors": enrich_errors,
    "enrich_summary": enrich_summary_q,
    "review_lookup": review_lookup,
    "search_text_topn": search_text_topn,
    "search_single": search_single,
    "search_radius": search_radius,
    "append_by_url": append_by_url,
    "append_by_name_addr": append_by_name_addr,
    "append_summary": append_summary_q,
    "page_social_links": page_social_links,
    "page_brief": page_brief,
    "web_enrich": web_enrich,
    "web_enrich_interactive": web_enrich_interactive,
    "render_prompts": render_prompts,
    "generate_resume": generate_resume,
    "generate_retry": generate_retry,
    "generate_journal": generate_journal,
    "flatten_responses": flatten_responses_q,
    "source_pages": source_pages,
    "paged_collect": paged_collect,
    "response_outcome": response_outcome,
    "field_coalesce": field_coalesce,
    "preview_merge": preview_merge,
    "resume_tail": resume_tail,
    "result_metrics": result_metrics_q,
    "csv_roundtrip": csv_roundtrip,
    "csv_row_ids": csv_row_ids,
    "enrich_csv": enrich_csv,
    "enrich_errors_written": enrich_errors_written,
    "resolve_headers": resolve_headers,
    "parse_locations": parse_locations,
    "merge_back": merge_back_q,
    "append_external_headers": append_external_headers,
    "append_dataset": append_dataset_q,
    "append_indexed": append_indexed,
    "append_csv": append_csv,
    "fuzzy_lookup": fuzzy_lookup_q,
    "fuzzy_lookup_2": fuzzy_lookup_2,
    "fuzzy_lookup_3": fuzzy_lookup_3,
    "enrich_fuzzy": enrich_fuzzy,
    "review_lookup_fuzzy": review_lookup_fuzzy,
    "stream_append": stream_append_q,
    "search_append": search_append,
    "staged_run": staged_run,
    "staged_run_generate": staged_run_generate,
    "run_preview": run_preview_q,
    "run_rest": run_rest_q,
    "run_continued": run_continued,
}
