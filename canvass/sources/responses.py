"""Captured search-API responses as a table: ``(query, page, status, body)``.

* ``flatten_responses``: JSON body -> one row per place (``from_json`` with an
  explicit schema + ``posexplode``); absent text fields become ''.
* ``collect_pages``: the paging rules of a search loop, per query: pages in
  order, stop at the first failed page (status <> 200) or page without
  ``places`` (keeping what came before), stop after a page without
  ``nextPageToken``, at most ``max_results`` places.
* ``response_status``: the outcome text of a lookup response.
* ``harmonise_places``: records in either field-naming style -> lead columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import first_present
from ..operators.skew import skew_safe_join
from ..operators.topn import top_n
from ..schema import MSG_NOT_FOUND

PLACE_STRUCT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("displayName", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("formattedAddress", T.StringType()),
    T.StructField("nationalPhoneNumber", T.StringType()),
    T.StructField("websiteUri", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("userRatingCount", T.LongType()),
    T.StructField("googleMapsUri", T.StringType()),
])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("places", T.ArrayType(PLACE_STRUCT)),
    T.StructField("nextPageToken", T.StringType()),
    T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
])


def parse(responses: DataFrame, body_col: str = "body") -> DataFrame:
    return responses.withColumn("_j", F.from_json(F.col(body_col), RESPONSE_SCHEMA))


def response_status(status: Column, j: Column) -> Column:
    """Null for a hit; the not-found text for 200 without places; else
    'API error: <error.message or HTTP code>'."""
    places = j.getField("places")
    return (F.when((status == 200) & (F.coalesce(F.size(places), F.lit(-1)) > 0), F.lit(None))
            .when(status == 200, F.lit(MSG_NOT_FOUND))
            .otherwise(F.concat(F.lit("API error: "),
                                F.coalesce(j.getField("error").getField("message"),
                                           F.concat(F.lit("HTTP "), status.cast("string"))))))


def lookup_outcome(responses: DataFrame) -> DataFrame:
    """Per response: the first place id (if any) and the error text."""
    p = parse(responses)
    j = F.col("_j")
    err = response_status(F.col("status"), j)
    return p.select(*[c for c in responses.columns if c != "body"],
                    F.when(err.isNull(), j.getField("places")[0].getField("id")).alias("place_id"),
                    err.alias("error"))


def _place_columns(p: Column) -> list[Column]:
    return [
        F.coalesce(p.getField("displayName").getField("text"), F.lit("")).alias("company_name"),
        F.coalesce(p.getField("formattedAddress"), F.lit("")).alias("company_address"),
        F.coalesce(p.getField("nationalPhoneNumber"), F.lit("")).alias("company_phone"),
        F.coalesce(p.getField("websiteUri"), F.lit("")).alias("website"),
        p.getField("rating").alias("rating"),
        p.getField("userRatingCount").alias("review_count"),
        F.coalesce(p.getField("googleMapsUri"), F.lit("")).alias("maps_url"),
    ]


def flatten_responses(responses: DataFrame, keys=("query", "page")) -> DataFrame:
    """One row per place of every successful page (status 200)."""
    p = parse(responses).where(F.col("status") == 200)
    ex = p.select(*keys, F.posexplode(F.col("_j").getField("places")).alias("pos", "_p"))
    return ex.select(*keys, "pos", *_place_columns(F.col("_p")))


def collect_pages(responses: DataFrame, max_results: int = 20) -> DataFrame:
    """Places a paging loop would have gathered, per query, with ``rank``.

    The stop page of each query comes from one partial-aggregating
    ``groupBy(query)`` over page rows (not place rows); pages are then kept
    by a join on query (a query with very many pages is salted), exploded,
    and cut with a window limit.
    """
    p = parse(responses)
    j = F.col("_j")
    bad = (F.col("status") != 200) | j.isNull() | j.getField("places").isNull()
    last = j.getField("nextPageToken").isNull()
    stops = p.groupBy("query").agg(
        F.min(F.when(bad, F.col("page"))).alias("_first_bad"),
        F.min(F.when(~bad & last, F.col("page"))).alias("_first_last"))
    kept = (skew_safe_join(p, stops, ["query"], "inner")
            .where((F.col("_first_bad").isNull() | (F.col("page") < F.col("_first_bad")))
                   & (F.col("_first_last").isNull() | (F.col("page") <= F.col("_first_last")))))
    ex = kept.select("query", "page", F.posexplode(j.getField("places")).alias("pos", "_p"))
    flat = ex.select("query", "page", "pos", *_place_columns(F.col("_p")))
    return top_n(flat, ["query"], [("page", "asc"), ("pos", "asc")], max_results)


# --- record harmonisation ----------------------------------------------------

# Candidate field names per output column, first present wins.
FIELD_CANDIDATES = {
    "company_name": ["Company Name", "name"],
    "company_address": ["Company Address", "address"],
    "company_phone": ["Company Phone", "Phone Number", "phone", "nationalPhoneNumber"],
    "website": ["Website", "website", "websiteUri"],
    "rating": ["Google Review Rating", "rating"],
    "review_count": ["Google Review Count", "review_count", "userRatingCount"],
}


def harmonise_places(df: DataFrame, keep=()) -> DataFrame:
    """Six lead columns from records in any supported naming style; text
    fields default to '', numbers to null."""
    out = [F.col(k) for k in keep]
    for name, cands in FIELD_CANDIDATES.items():
        default = None if name in ("rating", "review_count") else ""
        out.append(first_present(df.columns, *cands, default=default).alias(name))
    return df.select(*out)
