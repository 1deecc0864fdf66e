"""Lead tables on disk: CSV in the spreadsheet dialect, parquet preferred.

CSV is read with every column as a string (no inference), multi-line quoted
cells, ``"`` as its own escape, and without trimming cells; the usual
missing-value tokens become null; known columns are then renamed and typed.
Writing mirrors that so a file reads back unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import to_external, to_internal
from ..session import scratch_path
from . import files

# Cell texts read as missing (the pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "mode": "PERMISSIVE"}
CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def with_row_id(df: DataFrame, kind: str = "parquet", col: str = "row_id") -> DataFrame:
    """Stable 0-based row position across all input files, in (file path,
    position in file) order -- the row number a spreadsheet user sees.

    ``df`` must come straight from a file scan (no shuffle in between).
    parquet: position = ``_metadata.row_index``.  csv: files are read with
    ``multiLine`` (not splittable; several files may share a partition), so
    the position is ``monotonically_increasing_id`` minus the file's least
    id.  Offsets come from a one-row-per-file aggregate.
    """
    if kind == "parquet":
        pos = F.col("_metadata.row_index")
    elif kind == "csv":
        pos = F.monotonically_increasing_id()
    else:
        raise ValueError(f"unknown kind {kind!r}")
    base = df.select("*", F.col("_metadata.file_path").alias("_file"), pos.alias("_pos"))
    counts = base.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_min"))
    # One row per file: the running sum runs in a single task over file rows.
    offsets = counts.select(
        "_file", "_min", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (base.join(offsets, "_file")
            .withColumn(col, (F.col("_off") + F.col("_pos") - F.col("_min")).cast("bigint"))
            .drop("_file", "_pos", "_off", "_min"))


def unique_headers(names: list[str]) -> list[str]:
    """Spark resolves column names case-insensitively, so a header repeated
    with any casing gets a '.N' suffix (the pandas convention for exact
    repeats): ['a', 'A', 'a'] -> ['a', 'A.1', 'a.2']."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = n.lower()
        if k in seen:
            seen[k] += 1
            m = f"{n}.{seen[k]}"
            while m.lower() in seen:
                seen[k] += 1
                m = f"{n}.{seen[k]}"
            seen[m.lower()] = 0
            out.append(m)
        else:
            seen[k] = 0
            out.append(n)
    return out


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.options(**{**CSV_READ, "header": "false"}).csv(path).limit(1).collect()
    return [str(v) if v is not None else "" for v in first[0]] if first else []


def read_leads_csv(spark: SparkSession, path: str, na_tokens=NA_TOKENS,
                   internal: bool = True, row_id: bool = False, typed: bool = True) -> DataFrame:
    """CSV -> DataFrame.  Columns are read positionally (headers that differ
    only by case stay distinct), missing tokens -> null, known columns typed.
    ``row_id=True`` adds the 0-based data-row position (see ``with_row_id``)."""
    names = unique_headers(_header(spark, path))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.options(**CSV_READ).schema(schema).csv(path)
    if row_id and "row_id" not in names:
        raw = with_row_id(raw, kind="csv")
    keep = ["row_id"] if row_id and "row_id" not in names else []
    df = raw.select(*keep, *[F.when(~F.col(f"_c{i}").isin(*na_tokens), F.col(f"_c{i}")).alias(n)
                             for i, n in enumerate(names)])
    return to_internal(df, typed=typed) if internal else df


def in_order(df: DataFrame, col: str = "row_id", then: str | None = None, rows_a_part: int = 250_000) -> DataFrame:
    """``df`` sorted by ``col`` over its parts, for a whole number that counts rows from 0.

    Its range is known from its maximum, so rows go straight to their part:
    one shuffle, no sampling of the input.  Rows without a number come last, by
    ``then`` if given, in as many parts as their count asks for.
    """
    top, unnumbered = df.agg(F.max(col), F.count_if(F.col(col).isNull())).first()
    head, tail = (max(1, -(-n // rows_a_part)) for n in ((top or 0) + 1, unnumbered))
    number = F.least(F.greatest(F.floor(F.col(col) / rows_a_part), F.lit(0)), F.lit(head - 1))
    if then:
        at = df.where(F.col(col).isNull()).agg(F.min(then), F.max(then)).first()
        width = max(1, -(-(((at[1] or 0) - (at[0] or 0)) + 1) // tail))
        late = F.lit(head) + F.floor((F.col(then) - (at[0] or 0)) / width)
    else:
        late = F.lit(head) + F.pmod(F.monotonically_increasing_id(), F.lit(tail))
    part = F.when(F.col(col).isNotNull(), number).otherwise(late).cast("int")
    keys = [F.col(col).asc_nulls_last(), *([F.col(then)] if then else [])]
    return df.repartitionById(head + tail, part).sortWithinPartitions(*keys)


def write_leads(df: DataFrame, path: str, fmt: str = "parquet", external_headers: bool = True,
                order_by: str | None = None, mode: str = "overwrite",
                headers: dict[str, str] | None = None) -> None:
    """Write a lead table.  CSV uses external headers (``headers``: those the
    user's file had) and keeps cell text byte for byte.  ``order_by='row_id'`` restores input order across the
    file parts; it is one more shuffle, so it is opt-in."""
    out = df
    if order_by and order_by in df.columns:
        dense = order_by == "row_id" and dict(df.dtypes)[order_by] in ("bigint", "int")
        out = in_order(df, order_by) if dense else df.orderBy(order_by)
    if fmt == "csv":
        if external_headers:
            # A spreadsheet file has no row-id column: identity is the line
            # position, recomputed on read (``with_row_id``).
            out = to_external(out.drop("row_id"), headers)
        out.write.mode(mode).options(**CSV_WRITE).csv(path)
    elif fmt == "parquet":
        if headers:
            out = out.withColumnsRenamed({k: v for k, v in headers.items() if k in out.columns})
        out.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_enriched(result, leads_path: str, errors_path: str, fmt: str = "parquet",
                   summary: dict | None = None):
    """Write the enriched leads once, then derive the error table from the
    written data (the lookup join runs once; the errors file is written only
    when there are errors).  Returns the number of error rows.

    When a ``summary`` dict is passed it is filled with the run summary,
    counted by an ``Observation`` during the same write (no second pass).
    """
    from ..plans.enrich import errors_of, summary_columns

    spark = result.leads.sparkSession
    obs = Observation("enrich_summary")
    write_leads(result.leads.observe(obs, *summary_columns()), leads_path, fmt="parquet")
    if summary is not None:
        got = obs.get
        summary.update(got)
        summary["successful"] = got["total"] - got["failed"]
    written = spark.read.parquet(leads_path)
    errors = errors_of(written)  # short lineage: a filtered scan of the written table
    n = errors.count()
    if n:
        if fmt == "csv":
            errors.orderBy("row").write.mode("overwrite").options(**CSV_WRITE).csv(errors_path)
        else:
            errors.write.mode("overwrite").parquet(errors_path)
    return n


def missing_path(e: AnalysisException) -> bool:
    """The path does not exist, or holds no file yet; every other error is one."""
    return (e.getCondition() or "").split(".")[0] in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_dataset(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet dataset at ``path``, or None if there is none yet."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return None


def append_dataset(spark: SparkSession, path: str, new: DataFrame, by: str = "auto",
                   fmt: str = "parquet", indexed: bool = False) -> int:
    """Append the rows of ``new`` that the dataset at ``path`` does not hold
    yet; returns their number.  A missing dataset is created.

    parquet: ``mode('append')``, existing files are never rewritten, and the
    rows are counted during the write by an ``Observation``.  csv: one header
    holds for the whole file, so the union is written once to the shared
    checkpoint folder, written beside the file in order, and then put in its
    place, under the headers it had: a failed append leaves the file whole.

    ``indexed`` (parquet): the keys come from a persisted index instead of the
    whole dataset (``sources.seen_keys``).  It is built by the first such
    append and kept in the dataset's folder; the batch is written once to the
    shared checkpoint folder, as it is read twice.
    """
    from ..operators.append import append_new, new_rows

    if fmt == "csv":
        return _append_csv(spark, path, new, by, append_new)
    current = read_dataset(spark, path)
    if current is None:
        kept = new
    elif indexed:
        kept = _unseen_by_index(spark, path, current, new, by)
    else:
        kept = new_rows(current, new, by)
    obs = Observation("appended")
    kept.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(obs.get["n"])


def _unseen_by_index(spark: SparkSession, path: str, current: DataFrame, new: DataFrame, by: str) -> DataFrame:
    from ..operators.append import KEYS, dedup_rule, keyed, unseen
    from .seen_keys import SeenKeys

    rule = dedup_rule(current) if by == "auto" else by
    if rule not in KEYS:
        return new
    staged = scratch_path(spark, f"batch-{uuid.uuid4().hex}")
    new.write.parquet(staged)
    batch = keyed(spark.read.schema(new.schema).parquet(staged), rule)
    index = SeenKeys(spark, path, rule)
    index.sync(current)
    return unseen(batch, index.known(batch), rule)


def _append_csv(spark: SparkSession, path: str, new: DataFrame, by: str, append_new) -> int:
    try:
        current = read_leads_csv(spark, path, internal=False, row_id=True)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        current = None
    # An order column keeps the file's rows in place and the new ones, which have none, last.
    new = new.withColumn("row_id", F.lit(None).cast("bigint"))
    union = to_external(new) if current is None else append_new(current, new, by)
    staged = scratch_path(spark, f"append-{uuid.uuid4().hex}")
    obs = Observation("appended")
    (union.observe(obs, F.count_if(F.col("row_id").isNull()).alias("n"))
     .withColumn("_nth", F.monotonically_increasing_id()).write.parquet(staged))
    # The staged position orders the new rows and spreads them over tasks.
    back = in_order(spark.read.parquet(staged), then="_nth").drop("row_id", "_nth")
    replace(spark, path, lambda beside: back.write.options(**CSV_WRITE).csv(beside))
    return int(obs.get["n"])


def replace(spark: SparkSession, path: str, write) -> None:
    """Let ``write`` make a folder beside ``path``, then put it in the place of ``path``.

    What was at ``path`` is there untouched until the new folder is whole; if
    the swap itself fails it is moved back."""
    home, tag = path.rstrip("/"), uuid.uuid4().hex
    beside, old = f"{home}.new-{tag}", f"{home}.old-{tag}"
    try:
        write(beside)
        had = files.exists(spark, home)
        if had:
            files.move(spark, home, old)
        try:
            files.move(spark, beside, home)
        except Exception:
            if had:
                files.move(spark, old, home)
            raise
    except Exception:
        files.delete(spark, beside)
        raise
    if had:
        files.delete(spark, old)
