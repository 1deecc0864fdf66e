"""Place lookup: lead rows joined to a place catalogue on a normalised key.

The remote "search then fetch details" round trip of a lead tool becomes one
left outer equi-join against a catalogue reduced to one row per key.

Scale notes
-----------
* The catalogue is reduced with a partial-aggregating ``groupBy`` (see
  ``best_per_key``) so duplicated / hot catalogue keys never meet in one task.
* Join keys are never null (``match_key`` maps null to ''), so no artificial
  null-key partition forms.
* A lead key that holds a large share of rows is split at run time by
  adaptive execution (``operators.skew``).
* No broadcast hint: the catalogue can be large; AQE turns the join into a
  broadcast only when the runtime size is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from .skew import skew_safe_join
from .topn import best_per_key

KEY_COLS = ["_kn", "_ka"]
PLACE_ORDER = [("review_count", "desc"), ("place_id", "asc")]
PLACE_PAYLOAD = ["place_id", "rating", "review_count", "maps_url"]


def with_key(df: DataFrame, name_col: str, addr_col: str) -> DataFrame:
    return df.withColumns({"_kn": match_key(name_col), "_ka": match_key(addr_col)})


def catalogue_by_key(places: DataFrame, payload=PLACE_PAYLOAD, order=PLACE_ORDER,
                     name_col: str = "name", addr_col: str = "address") -> DataFrame:
    """One catalogue row per normalised (name, address): most reviews first,
    then lowest place id (the 'first search hit')."""
    keyed = with_key(places.where(F.col("place_id").isNotNull()), name_col, addr_col)
    return best_per_key(keyed, KEY_COLS, order, list(payload))


def lookup(leads: DataFrame, catalogue: DataFrame, name_col: str = "company_name",
           addr_col: str = "company_address", prefix: str = "p_") -> DataFrame:
    """``leads`` left-joined to a one-row-per-key ``catalogue``.

    Catalogue payload columns arrive prefixed with ``prefix`` plus a boolean
    ``{prefix}hit``; lead rows are never multiplied or dropped.
    """
    cat = catalogue.select(*KEY_COLS, *[F.col(c).alias(prefix + c) for c in catalogue.columns
                                        if c not in KEY_COLS],
                           F.lit(True).alias(prefix + "hit"))
    keyed = with_key(leads, name_col, addr_col)
    joined = skew_safe_join(keyed, cat, list(KEY_COLS), "left")
    return joined.withColumn(prefix + "hit", F.coalesce(F.col(prefix + "hit"), F.lit(False))) \
        .drop(*KEY_COLS)
