"""Preview / resume / write-back by row key, and result metrics.

``preview`` and ``resume`` split the table by complementary predicates on
``row_id`` and run the stages on one side only: the untouched side is never
shuffled or joined.  ``merge_back`` is the general write-back of an
arbitrary enriched subset (an anti join + union on the key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW_SIZE = 10  # fixed value: rows enriched by a preview run


def merge_back(full: DataFrame, part: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``part`` replace the rows of ``full`` with the same key."""
    rest = full.join(part.select(key), key, "left_anti")
    return rest.unionByName(part, allowMissingColumns=True)


def preview(df: DataFrame, stages, n: int = PREVIEW_SIZE, key: str = "row_id") -> DataFrame:
    """Run ``stages`` (DataFrame -> DataFrame) on rows with key < n; the
    rest is passed through unchanged."""
    head = stages(df.where(F.col(key) < n))
    tail = df.where(~(F.col(key) < n))
    return tail.unionByName(head, allowMissingColumns=True)


def resume_start(df: DataFrame, start: int, key: str = "row_id") -> int:
    """``start``, or 0 when no row is left at or after it (then everything
    is redone).  A bounded probe: at most one row reaches the driver."""
    left = df.where(F.col(key) >= start).select(key).limit(1).collect()
    return start if left else 0


def resume(df: DataFrame, stages, start: int, key: str = "row_id") -> DataFrame:
    """Run ``stages`` on rows with key >= start; earlier rows unchanged."""
    done = df.where(~(F.col(key) >= start))
    rest = stages(df.where(F.col(key) >= start))
    return done.unionByName(rest, allowMissingColumns=True)


def result_metrics(df: DataFrame, col: str = "generated_email") -> DataFrame:
    """One row: rows, columns, texts present (non-null, blank included) and
    texts that are blank."""
    n_cols = len(df.columns)
    if col in df.columns:
        c = F.col(col)
        present, blank = F.count(c), F.count_if(F.coalesce(F.trim(c) == "", F.lit(False)))
    else:
        present, blank = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(n_cols).alias("total_columns"),
                  present.alias("texts_generated"), blank.alias("texts_blank"))
