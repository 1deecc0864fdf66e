"""Top-1 per key and top-N per group without one-task-per-hot-group plans.

* ``best_per_key`` is a ``groupBy().agg(min(struct(order..., payload...)))``:
  the hash aggregate runs a partial (map-side) step, so a key that holds a
  third of all rows is reduced to one row per map partition before the
  shuffle -- no task ever sees the whole hot group.
* ``top_n`` is ``row_number() <= n`` over a window; Spark inserts a
  partial ``WindowGroupLimit`` below the exchange, so at most ``n`` rows per
  group and map partition are shuffled (exact, no sampling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort_fields(order) -> list[Column]:
    """(nulls-last flag, value) pairs encoding ``order`` for ascending min()."""
    out = []
    for i, (c, direction) in enumerate(order):
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.isNull().alias(f"_n{i}"))
        if direction == "desc":
            out.append((-col).alias(f"_v{i}"))  # numeric columns only
        else:
            out.append(col.alias(f"_v{i}"))
    return out


def best_per_key(df: DataFrame, keys: list[str], order, payload: list[str]) -> DataFrame:
    """One row per ``keys``: the first by ``order`` ([(col, 'asc'|'desc')],
    nulls last), with ``payload`` columns."""
    best = F.min(F.struct(*_sort_fields(order), *[F.col(p).alias(p) for p in payload]))
    return (df.groupBy(*keys).agg(best.alias("_best"))
            .select(*keys, *[F.col("_best." + p).alias(p) for p in payload]))


def order_cols(order) -> list[Column]:
    cols = []
    for c, direction in order:
        col = F.col(c) if isinstance(c, str) else c
        cols.append(col.desc_nulls_last() if direction == "desc" else col.asc_nulls_last())
    return cols


def top_n(df: DataFrame, group: list[str], order, n: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n within each group by ``order`` (ties broken by the
    caller's order list; make it total for a deterministic result)."""
    w = Window.partitionBy(*group).orderBy(*order_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
