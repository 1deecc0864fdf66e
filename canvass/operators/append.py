"""Append new leads to an existing table without re-adding known ones.

Dedup is a ``left_anti`` join of the new batch against the *distinct* keys
of the existing table (partial aggregation first, so a hot key is collapsed
map-side).  Rows of the new batch are not deduplicated against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key, strip
from .columns import found_headers, resolve_columns, to_external, to_internal
from .skew import skew_safe_join

# Headers that name a lead, in the order they are tried.
NAME_ALIASES = {"company_name": ["company_name", "Company Name", "Business Name"],
                "company_address": ["company_address", "Company Address", "Business Address"]}


def dedup_rule(existing: DataFrame) -> str:
    """'url' when the existing table has a map-URL column, 'name_address'
    when name and address resolve, else 'none'."""
    if "maps_url" in existing.columns:
        return "url"
    found = resolve_columns(existing.columns, NAME_ALIASES)
    return "name_address" if len(found) == 2 else "none"


#: Key columns of a dedup rule.
KEYS = {"url": ["_k"], "name_address": ["_kn", "_ka"]}


def existing_keys(existing: DataFrame, rule: str) -> DataFrame:
    """The key columns of an existing table's rows (by URL: of rows that have one)."""
    if rule == "url":
        return (existing.where(F.col("maps_url").isNotNull())
                .select(strip(F.col("maps_url").cast("string")).alias("_k")))
    found = resolve_columns(existing.columns, NAME_ALIASES)
    return existing.select(match_key(found["company_name"]).alias("_kn"),
                           match_key(found["company_address"]).alias("_ka"))


def keyed(new: DataFrame, rule: str) -> DataFrame:
    """``new`` with the key columns of the rule."""
    if rule == "url":
        return new.withColumn("_k", strip(F.coalesce(F.col("maps_url").cast("string"), F.lit(""))))
    return new.withColumns({"_kn": match_key("company_name"), "_ka": match_key("company_address")})


def new_rows(existing: DataFrame, new: DataFrame, by: str = "auto") -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    rule = dedup_rule(existing) if by == "auto" else by
    if rule not in KEYS:
        return new
    return unseen(keyed(new, rule), existing_keys(existing, rule), rule)


def unseen(staged: DataFrame, keys: DataFrame, rule: str) -> DataFrame:
    """Rows of ``staged`` (see ``keyed``) whose key is not among ``keys``."""
    return _anti(staged, keys, KEYS[rule])


def _anti(staged: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``staged`` rows whose key is not among ``keys`` (key columns dropped).

    The all-blank key ('' -- a missing URL, or a missing name and address)
    is the one value many rows share, so those rows stay out of the shuffle:
    they are checked against a marker of at most one row ("does the
    existing table hold a blank key?"), which is safe to broadcast.  All
    other keys take a shuffled anti join against the distinct existing keys
    (partial aggregation first); a key repeated very often in the new batch
    is split at run time (``operators.skew``).
    """
    blank = F.lit(True)
    for c in on:
        blank = blank & (F.col(c) == "")
    blank_rows = staged.where(blank)
    marker = F.broadcast(keys.where(blank).select(*on).limit(1))
    kept_blank = blank_rows.join(marker, on, "left_anti")
    kept = skew_safe_join(staged.where(~blank), keys.where(~blank).distinct(), on, "left_anti")
    return kept.unionByName(kept_blank).drop(*on)


def append_new(existing: DataFrame, new: DataFrame, by: str = "auto") -> DataFrame:
    """Existing rows, then the kept new rows (union by name; columns only one
    side has are null on the other; existing column order first).

    Either side may have external headers; the existing table's headers are
    kept, and new columns get the external ones if it has any.
    """
    headers = found_headers(existing.columns)
    inner, new = to_internal(existing, typed=False), to_internal(new, typed=False)
    kept = new_rows(inner, new, by)
    if headers:
        # Text cells of a spreadsheet file stay text.
        kinds = {c: t for c, t in inner.dtypes}
        kept = kept.select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in kept.dtypes])
    out = inner.unionByName(kept, allowMissingColumns=True)
    return to_external(out, headers) if headers else out


def append_summary(existing: DataFrame, new: DataFrame, by: str = "auto") -> DataFrame:
    """One row: new_rows (appended), existing_rows, total_rows."""
    kept = new_rows(existing, new, by)
    flags = existing.select(F.lit(0).alias("_new")).unionAll(kept.select(F.lit(1).alias("_new")))
    return flags.agg(F.count_if(F.col("_new") == 1).alias("new_rows"),
                     F.count_if(F.col("_new") == 0).alias("existing_rows"),
                     F.count(F.lit(1)).alias("total_rows"))
