"""File-to-file jobs: the four batch jobs of a lead tool, as Spark jobs.

Each reads a lead table, runs the lazy plan and writes the result; formats
are 'csv' (spreadsheet dialect, external headers) or 'parquet'.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.template import DEFAULT_TEMPLATE
from ..functions.text import miles_to_metres, parse_location
from ..operators.columns import found_headers, to_internal
from ..operators.generate import generate
from ..schema import ENRICH_ALIASES
from ..session import scratch_path
from ..sources.leads_io import (CSV_WRITE, append_dataset, read_leads_csv, with_row_id,
                                write_leads)
from .enrich import enrich_leads, errors_of, prepare_for_enrich, summary_columns
from .search import search
from .web import enrich_web

HELPER_COLUMNS = ("plan_state", "error")


def read_table(spark: SparkSession, path: str, fmt: str = "csv", enrich_aliases: bool = False):
    """(lead table with internal column names and a 0-based ``row_id``, the
    file's own headers by internal name).  Cells keep their text: what a job
    does not update is written back as it was."""
    if fmt == "csv":
        raw = read_leads_csv(spark, path, internal=False, row_id=True)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
        if "row_id" not in raw.columns:
            raw = with_row_id(raw, kind="parquet")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    headers = found_headers(raw.columns, ENRICH_ALIASES if enrich_aliases else None)
    return (prepare_for_enrich(raw, typed=False) if enrich_aliases
            else to_internal(raw, typed=False)), headers


def _staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: the
    sort of the output samples its input, which must not run the plan again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str, fmt: str, headers: dict[str, str] | None = None) -> None:
    write_leads(df, path, fmt=fmt, order_by="row_id" if "row_id" in df.columns else None,
                headers=headers)


def enrich_file(spark: SparkSession, input_path: str, output_path: str, places: DataFrame,
                errors_path: str | None = None, fmt: str = "csv", fuzzy: int = 0) -> dict:
    """Review enrichment (``fuzzy``: edits tolerated in a name).  The result is staged once (parquet, in the shared
    checkpoint folder); output and error table are both derived from it, so
    the lookup join runs once.  Returns the run summary."""
    from pyspark.sql import Observation

    leads, headers = read_table(spark, input_path, fmt, enrich_aliases=True)
    staging = scratch_path(spark, f"enrich-{uuid.uuid4().hex}")
    obs = Observation("summary")
    enrich_leads(leads, places, fuzzy=fuzzy).observe(obs, *summary_columns()).write.parquet(staging)
    summary = dict(obs.get)
    summary["successful"] = summary["total"] - summary["failed"]
    staged = spark.read.parquet(staging)
    _write(staged.drop(*HELPER_COLUMNS), output_path, fmt, headers)
    if errors_path and summary["failed"]:
        errors = errors_of(staged)
        if fmt == "csv":
            errors.orderBy("row").write.mode("overwrite").options(**CSV_WRITE).csv(errors_path)
        else:
            errors.write.mode("overwrite").parquet(errors_path)
    return summary


def search_file(spark: SparkSession, places: DataFrame, query: str, output_path: str,
                max_results: int = 20, location: str | None = None,
                radius_miles: float | None = None, append: bool = False,
                pages: DataFrame | None = None, fmt: str = "parquet", indexed: bool = False) -> int:
    """Search and save.  ``append=True`` adds only the found rows the
    dataset at ``output_path`` does not hold yet (``indexed``: by its key index).  Returns the number of rows
    written; a search without hits writes nothing."""
    loc = parse_location(location) if location else None
    radius = miles_to_metres(radius_miles) if radius_miles else None
    found = _staged(search(places, query, max_results, loc, radius, pages=pages), "search")
    n = found.count()   # of the written result: the search runs once
    if append:
        return append_dataset(spark, output_path, found, fmt=fmt, indexed=indexed) if n else 0
    if n:
        _write(found, output_path, fmt)
    return n


def enrich_web_file(spark: SparkSession, input_path: str, output_path: str, pages: DataFrame,
                    mode: str = "batch", fmt: str = "csv") -> None:
    leads, headers = read_table(spark, input_path, fmt)
    _write(_staged(enrich_web(leads, pages, mode=mode), "web"), output_path, fmt, headers)


def generate_file(spark: SparkSession, input_path: str, output_path: str, fn,
                  product_description: str, template: str = DEFAULT_TEMPLATE,
                  retry_errors: bool = False, fmt: str = "csv", batch_rows: int = 1,
                  partitions: int | None = None, journal: str | None = None) -> None:
    """Generated texts for the pending rows; ``fn`` sees each prompt once, with a
    ``journal`` also over interrupted runs."""
    leads, headers = read_table(spark, input_path, fmt)
    out = generate(leads, fn, template, product_description, retry_errors,
                   batch_rows=batch_rows, partitions=partitions, journal=journal)
    _write(_staged(out, "generate"), output_path, fmt, headers)


__all__ = ["enrich_file", "search_file", "enrich_web_file", "generate_file", "read_table"]
