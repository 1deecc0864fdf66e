"""Column resolution and conditional updates (metadata + projections only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HEADER_ALIASES, LEAD_FIELDS


def _norm_header(name: str) -> str:
    return name.lower().replace("_", " ").replace("-", " ").strip()


def find_column(columns, name: str) -> str | None:
    """First column whose loose form equals ``name``'s (case, '_'/'-' as
    space, outer spaces); inner repeated spaces are not collapsed."""
    want = _norm_header(name)
    for c in columns:
        if _norm_header(c) == want:
            return c
    return None


def resolve_columns(columns, aliases: dict[str, list[str]],
                    required=()) -> dict[str, str]:
    """{internal: actual header} for every alias list that resolves.

    Raises ``ValueError`` listing the available columns when a required one
    is missing.
    """
    found = {}
    for internal, names in aliases.items():
        for n in names:
            hit = find_column(columns, n)
            if hit is not None:
                found[internal] = hit
                break
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(
            f"could not find column(s) {missing}; available columns: {', '.join(columns)}")
    return found


def found_headers(columns, aliases: dict[str, list[str]] | None = None,
                  required=()) -> dict[str, str]:
    """{internal name: the header that the table has for it}."""
    cols = [c for c in columns if c not in LEAD_FIELDS]
    required = [r for r in required if r not in columns]
    return resolve_columns(cols, {k: v for k, v in {**HEADER_ALIASES, **(aliases or {})}.items()
                                  if k not in columns}, required)


def to_internal(df: DataFrame, aliases: dict[str, list[str]] | None = None,
                required=(), typed: bool = True) -> DataFrame:
    """Rename external headers to internal names and cast known columns.

    Unknown columns pass through untouched.  Known typed columns use
    ``try_cast`` (text such as 'Not Found' in a numeric column becomes null;
    '127.0' becomes 127).  ``typed=False`` keeps every cell as it is, for jobs
    that write a user's file back.
    """
    inv = {v: k for k, v in found_headers(df.columns, aliases, required).items()}
    out = []
    for c in df.columns:
        internal = inv.get(c, c if c in LEAD_FIELDS else None)
        if internal is None:
            out.append(F.col(f"`{c}`"))
            continue
        typ = LEAD_FIELDS[internal][0]
        col = F.col(f"`{c}`")
        if not typed:
            pass
        elif isinstance(typ, T.LongType):
            col = col.cast("string").try_cast("double").try_cast("bigint") \
                if not isinstance(df.schema[c].dataType, T.LongType) else col
        elif isinstance(typ, T.DoubleType):
            col = col.cast("string").try_cast("double") \
                if not isinstance(df.schema[c].dataType, T.DoubleType) else col
        out.append(col.alias(internal))
    return df.select(*out)


def to_external(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Internal names back to headers: those the user had (``headers``, see
    ``found_headers``), else the external CSV headers."""
    headers = headers or {}
    return df.select(*[F.col(f"`{c}`").alias(headers.get(c, LEAD_FIELDS[c][1])) if c in LEAD_FIELDS
                       and c != "row_id" else F.col(f"`{c}`") for c in df.columns])


def ensure_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add absent columns as ``{name: (type, default)}``; existing ones kept."""
    add = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns}
    return df.withColumns(add) if add else df


def first_present(columns, *names: str, default=None) -> Column:
    """First of ``names`` that exists and is non-null ('' counts as present);
    ``default`` when none is."""
    cols = [F.col(f"`{n}`") for n in names if n in set(columns)]
    if default is not None:
        cols.append(F.lit(default))
    if not cols:
        return F.lit(None)
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]
