"""Incremental review enrichment (leads + places -> leads, errors, summary).

Plan shape::

    leads --project plan_state--+--(invalid|complete)------------------+
                                +--(url_only|full) --⟕ places/key--+--union--> result
                                                                    ^ one join

Rows that need nothing are never shuffled; the two branches are selected by
complementary non-null predicates, so the union has exactly the input rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_value, is_blank, is_valid
from ..operators.columns import ensure_columns, to_internal
from ..schema import ENRICH_ALIASES
from ..operators.fuzzy import nearest
from ..operators.lookup import PLACE_PAYLOAD, catalogue_by_key, lookup, with_key
from ..schema import MSG_MISSING_KEY, MSG_NOT_FOUND, NOT_FOUND_TOKEN

STATE_INVALID, STATE_COMPLETE, STATE_URL_ONLY, STATE_FULL = \
    "invalid", "complete", "url_only", "full"

ENRICH_DEFAULTS = {"rating": ("double", None), "review_count": ("bigint", None),
                   "maps_url": ("string", None)}


def plan_state(placeholders=(NOT_FOUND_TOKEN,)) -> Column:
    """Ordered classification: invalid -> complete -> url_only -> full."""
    r = is_valid("rating", placeholders)
    c = is_valid("review_count", placeholders)
    u = is_valid("maps_url", placeholders)
    return (F.when(is_blank("company_name") | is_blank("company_address"), STATE_INVALID)
            .when(r & c & u, STATE_COMPLETE)
            .when(r & c, STATE_URL_ONLY)
            .otherwise(STATE_FULL))


def with_plan_state(leads: DataFrame, placeholders=(NOT_FOUND_TOKEN,)) -> DataFrame:
    leads = ensure_columns(leads, ENRICH_DEFAULTS)
    return leads.withColumn("plan_state", plan_state(placeholders))


def prepare_for_enrich(raw: DataFrame, typed: bool = True) -> DataFrame:
    """External headers -> internal names for the enrichment job: 'Business
    Name/Address' are preferred over 'Company ...'; a table without a name or
    address column is rejected (ValueError listing the available columns)."""
    return to_internal(raw, ENRICH_ALIASES, required=("company_name", "company_address"), typed=typed)


@dataclass
class EnrichResult:
    leads: DataFrame
    errors: DataFrame
    summary: DataFrame


def _catalogue(todo: DataFrame, places: DataFrame, payload, fuzzy: int) -> DataFrame:
    """One place per key; with ``fuzzy`` one per key of ``todo``, up to that many edits away in the name."""
    cat = catalogue_by_key(places, payload=payload)
    if not fuzzy:
        return cat
    return nearest(with_key(todo, "company_name", "company_address"), cat, fuzzy, payload).drop("matched_name", "distance")


def enrich_leads(leads: DataFrame, places: DataFrame, placeholders=(NOT_FOUND_TOKEN,), fuzzy: int = 0) -> DataFrame:
    """Leads with rating/review_count/maps_url filled where missing, plus
    ``plan_state`` and ``error`` columns (null error = row is fine).

    ``fuzzy``: a lead whose name the catalogue does not hold at its address
    takes the place of the nearest name there, up to so many edits away."""
    staged = with_plan_state(leads, placeholders)
    cols = staged.columns
    st = F.col("plan_state")
    done = staged.where(st.isin(STATE_INVALID, STATE_COMPLETE)).withColumn(
        "error", F.when(st == STATE_INVALID, F.lit(MSG_MISSING_KEY)).cast("string"))
    todo = staged.where(st.isin(STATE_URL_ONLY, STATE_FULL))
    j = lookup(todo, _catalogue(todo, places, PLACE_PAYLOAD, fuzzy))
    hit, full = F.col("p_hit"), st == STATE_FULL
    updated = j.select(
        *[_update(staged, c, hit & full) if c in ("rating", "review_count") else
          _update(staged, c, hit) if c == "maps_url" else F.col(c)
          for c in cols],
        F.when(~hit, F.lit(MSG_NOT_FOUND)).alias("error"))
    return done.unionByName(updated)


def _update(df: DataFrame, c: str, cond: Column) -> Column:
    """The place's value where ``cond`` holds, in the column's own type (a
    file's text column stays text), else the lead's own value untouched."""
    return F.when(cond, F.col("p_" + c).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)


def event_time() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def errors_of(result: DataFrame, with_time: bool = True) -> DataFrame:
    """Error table: 1-based file row (+1 for the header), key, message."""
    cols = [(F.col("row_id") + 2).alias("row"),
            F.col("company_name").alias("business_name"),
            F.col("company_address").alias("business_address"),
            F.col("error")]
    if with_time:
        cols.append(event_time().alias("timestamp"))
    return result.where(F.col("error").isNotNull()).select(*cols)


def summary_columns() -> list[Column]:
    st = F.col("plan_state")
    return [F.count(F.lit(1)).alias("total"),
            F.count_if(st == STATE_COMPLETE).alias("skipped_complete"),
            F.count_if(st == STATE_URL_ONLY).alias("url_only_fetched"),
            F.count_if(st == STATE_FULL).alias("full_fetched"),
            F.count_if(F.col("error").isNotNull()).alias("failed")]


def enrich_summary(result: DataFrame) -> DataFrame:
    """One row: total, skipped_complete, url_only_fetched, full_fetched,
    successful (= total - failed, skipped rows included), failed."""
    agg = result.agg(*summary_columns())
    return agg.select("total", "skipped_complete", "url_only_fetched", "full_fetched",
                      (F.col("total") - F.col("failed")).alias("successful"), "failed")


def enrich(leads: DataFrame, places: DataFrame, **kw) -> EnrichResult:
    """Lazy triple.  To produce both files, write ``leads`` first and derive
    the errors from what was written (see ``sources.leads_io.write_enriched``)."""
    result = enrich_leads(leads, places, **kw)
    return EnrichResult(result, errors_of(result), enrich_summary(result))


# --- review lookup of the interactive path -----------------------------------

def needs_reviews() -> Column:
    """Rating or count without a value, and a name to search for."""
    return ~(has_value("rating") & has_value("review_count")) & ~is_blank("company_name")


def enrich_reviews(leads: DataFrame, places: DataFrame, fuzzy: int = 0) -> DataFrame:
    """Fill rating and review_count (never the URL) for rows that lack them;
    a miss leaves the row unchanged and is not an error.  ``fuzzy``: see ``enrich_leads``."""
    leads = ensure_columns(leads, {"rating": ("double", None),
                                   "review_count": ("bigint", None)})
    cols = leads.columns
    need = needs_reviews()
    done = leads.where(~need)
    todo = leads.where(need)
    j = lookup(todo, _catalogue(todo, places, ["place_id", "rating", "review_count"], fuzzy))
    hit = F.col("p_hit")
    updated = j.select(*[
        _update(leads, c, hit) if c in ("rating", "review_count") else F.col(c) for c in cols])
    return done.unionByName(updated)
