"""Joins that stay balanced when one key holds a large share of the rows.

Every lookup-style join in this package has a one-row-per-key right side that
comes out of an aggregate (catalogue dedup, distinct keys, page dedup).  Such a
side keeps the aggregate's partitioning, and adaptive execution only splits
joins whose *both* inputs are shuffled for the join itself.  ``skew_safe_join``
therefore joins on one more column, a hash of the keys made after the
aggregate: both sides get a shuffle of their own, and a partition that a hot
key fills is split at run time, its right row replicated per part.  Nothing is
counted beforehand, and no key or size is treated apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``left.join(right, on, how)`` in a shape that adaptive execution can split."""
    key = F.xxhash64(*[F.col(c) for c in on])
    return left.withColumn("_jk", key).join(right.withColumn("_jk", key), ["_jk", *on], how).drop("_jk")
