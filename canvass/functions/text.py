"""String predicates and normalisers as JVM-side column expressions.

Python's ``str.split()`` / ``str.strip()`` / ``re`` ``\\s`` treat all Unicode
white space *and* the separators U+001C..U+001F as space; Java's ``\\s`` is
ASCII-only unless ``(?U)`` is given and never includes U+001C..U+001F.  The
class below makes the two agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{WS}+|{WS}+$"
_WS_RUN_RE = rf"(?U){WS}+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: runs of white space -> one space, stripped."""
    return strip(F.regexp_replace(_c(c), _WS_RUN_RE, " "))


def is_blank(c) -> Column:
    """Null, or only white space (the value is cast to string first)."""
    c = _c(c)
    return F.coalesce(strip(c.cast("string")) == "", F.lit(True))


def has_value(c) -> Column:
    """Not null and not blank (a ``'Not Found'`` text counts as a value)."""
    return ~is_blank(c)


def is_valid(c, placeholders=("Not Found",)) -> Column:
    """Not null, and the stripped text is neither '' nor a placeholder.

    Placeholders compare case-sensitively; numbers (incl. 0) are valid.
    """
    s = strip(_c(c).cast("string"))
    return F.coalesce(~s.isin("", *placeholders), F.lit(False))


def match_key(c) -> Column:
    """Dedup / lookup key: null -> '', white-space runs -> ' ', strip, lower."""
    return F.lower(collapse_ws(F.coalesce(_c(c).cast("string"), F.lit(""))))


def with_scheme(c) -> Column:
    """Website URL: prefix ``https://`` unless it already starts with 'http'."""
    c = _c(c)
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))


def link_with_scheme(c) -> Column:
    """Found link: as ``with_scheme`` but leading '/' are dropped first."""
    c = _c(c)
    return F.when(c.startswith("http"), c).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(c, "^/+", "")))


def prompt_value(c) -> Column:
    """Template value: null/blank -> 'N/A', otherwise the stripped text."""
    c = _c(c)
    return F.when(is_blank(c), F.lit("N/A")).otherwise(strip(c.cast("string")))


def short_error(c, n: int) -> Column:
    """First ``n`` characters of an error text (code points, like Python)."""
    return F.substring(_c(c), 1, n)


def tokens(c) -> Column:
    """Lower-cased word tokens (letters/digits), empty tokens dropped."""
    parts = F.split(F.lower(F.coalesce(_c(c), F.lit(""))), r"(?U)[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


# --- plain-Python argument helpers (not data paths) -------------------------

MILES_TO_METRES = 1609.34  # fixed value


def miles_to_metres(miles: float) -> int:
    if miles is None or miles <= 0:
        raise ValueError("radius must be > 0")
    return int(math.floor(miles * MILES_TO_METRES))


def parse_location(text: str) -> tuple[float, float]:
    """``'lat,lng'`` -> (lat, lng); anything else raises ValueError."""
    parts = str(text).split(",")
    if len(parts) != 2:
        raise ValueError(f"location must be 'lat,lng', got {text!r}")
    return float(parts[0]), float(parts[1])


def parse_location_col(c) -> Column:
    """Column form of ``parse_location``: struct(lat, lng), null if invalid."""
    parts = F.split(_c(c), ",")
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, parts.getItem(0).try_cast("double")).alias("lat"),
        F.when(ok, parts.getItem(1).try_cast("double")).alias("lng"),
    )
