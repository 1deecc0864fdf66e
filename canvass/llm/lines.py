"""Operator 4: remove lines that many sites share (distinct-site spread).

A line is the text between newlines without outer blanks.  Its spread is the
number of distinct sites whose documents hold it.  HyperLogLog sketches per
line hash, merged by aggregation, estimate the spread.  Lines estimated well
above ``min_sites`` are boilerplate and those well below are not; lines whose
estimate is near the threshold get an exact distinct count.  Boilerplate lines
are taken out of every document.  A document of which no line would stay is a
copy rather than boilerplate and keeps its text.

Defined cases: null text stays null, and blank lines are never boilerplate
and always stay; null sites count as one site; null ids are ordinary values;
repeated rows are alike and treated alike; an empty table gives an empty
result; columns other than the text pass unchanged, and an input column named
``n_lines_removed`` is replaced.

Scale: the sketches are built in the tasks that read the text and merged after
one shuffle of (line hash, sketch), so a line that a third of the rows share
arrives once per task, whatever its sites.  The few lines near the threshold
are looked up in a second read and counted exactly; no other pair of line and
site is shuffled.  The text is shuffled once, when the documents meet their
removed line numbers.  Nothing is broadcast by hint and nothing reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stage

#: Half the width of the band around the threshold that is counted exactly, in
#: standard errors of the sketch; beyond it an estimate decides.
BAND_ERRORS = 8


def line_parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _numbered(line: Column, number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), line)


def _hash(line: Column) -> Column:
    """Two 64-bit hashes of the line without outer blanks; null for a blank line."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b")))


def boilerplate(docs: DataFrame, text: str, site: str, min_sites: int, precision: int = 12) -> DataFrame:
    """One row per boilerplate line: its hash (struct of two longs) as ``line``."""
    # A line counts once per text; no pair of line and site is shuffled for the sketches.
    held = (docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
                        F.explode(F.array_distinct(F.transform(line_parts(F.col(text)), _hash))).alias("line"))
            .where(F.col("line").isNotNull()))
    spread = (held.groupBy("line").agg(F.hll_sketch_agg("site", precision).alias("sketch"))
              .select("line", F.hll_sketch_estimate("sketch").alias("spread")))
    band = min_sites * BAND_ERRORS * 1.04 / 2 ** (precision / 2) + 1
    spread = stage(spread.where(F.col("spread") > min_sites - band), "line-spread")
    sure = spread.where(F.col("spread") >= min_sites + band).select("line")
    near = spread.where(F.col("spread") < min_sites + band).select("line")
    # Exact counts of the near lines, from a second read; their pairs are reduced in the task.
    exact = (held.join(near, "line", "left_semi").distinct().groupBy("line")
             .agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"))
    return stage(sure.unionByName(exact), "boilerplate-lines")


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id",
               min_sites: int = 10, precision: int = 12) -> DataFrame:
    """Documents with boilerplate lines removed and ``n_lines_removed`` (long)."""
    docs = docs.drop("n_lines_removed")
    lines = boilerplate(docs, text, site, min_sites, precision)
    own_key, own_gone = fresh("__key", docs.columns), fresh("__gone", docs.columns)
    keyed = docs.withColumn(own_key, F.struct(row_key(F.col(key), F.col(text)).alias("a"),
                                              row_key(F.col(text), F.col(key), seed=1).alias("b")))
    places = (keyed.select(own_key, F.posexplode(line_parts(F.col(text))).alias("__no", "__line"))
              .select(own_key, _numbered(F.col("__line"), F.col("__no")).alias("__mark"), _hash(F.col("__line")).alias("line")))
    gone = (places.where(F.col("line").isNotNull()).join(lines, "line", "left_semi")
            .groupBy(own_key).agg(F.collect_set("__mark").alias(own_gone)))
    gone = stage(gone, "line-places")
    parts = line_parts(F.col(text))
    # Lines are told apart by their numbers, and array_except hashes: linear in
    # the lines of a text, however many go.
    kept = F.transform(F.array_except(F.transform(parts, _numbered), F.col(own_gone)),
                       lambda x: F.substring_index(x, "\n", -1))
    left = F.exists(kept, lambda x: _hash(x).isNotNull())
    cut = F.col(own_gone).isNotNull() & left
    out = keyed.join(gone, own_key, "left")
    return out.select(
        *[F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c)
          for c in docs.columns],
        F.when(cut, F.size(own_gone)).otherwise(0).cast("long").alias("n_lines_removed"))
