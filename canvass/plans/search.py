"""Search job: places matching a query (optionally within a radius), as
lead rows, optionally appended to an existing table and passed through the
website stage -- the whole union, old rows included, like a re-run would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.append import append_new
from ..operators.search import search_places
from .web import enrich_web


def as_leads(places: DataFrame) -> DataFrame:
    """Search hits -> lead columns; absent text fields become ''."""
    def txt(c):
        return F.coalesce(F.col(c), F.lit("")) if c in places.columns else F.lit("")
    return places.select(
        txt("name").alias("company_name"), txt("address").alias("company_address"),
        txt("phone").alias("company_phone"), txt("website").alias("website"),
        F.col("rating").cast("double").alias("rating"),
        F.col("review_count").cast("bigint").alias("review_count"),
        txt("maps_url").alias("maps_url"))


def search(places: DataFrame, query: str, max_results: int = 20,
           location: tuple[float, float] | None = None, radius_m: float | None = None,
           existing: DataFrame | None = None, by: str = "auto",
           pages: DataFrame | None = None, mode: str = "batch") -> DataFrame:
    found = as_leads(search_places(places, query, max_results, location, radius_m))
    out = found if existing is None else append_new(existing, found, by)
    return enrich_web(out, pages, mode=mode) if pages is not None else out
