"""DuckDB SQL snippets used to write the independent oracle queries.

RE2 (DuckDB) has ASCII ``\\s``; the fixtures only contain ASCII white space,
where it agrees with the Unicode-aware Spark expressions.
"""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(f'CAST({x} AS VARCHAR)')} = '')"


def valid(x: str, placeholders=("Not Found",)) -> str:
    ph = ", ".join(["''"] + [f"'{p}'" for p in placeholders])
    return f"({x} IS NOT NULL AND {strip(f'CAST({x} AS VARCHAR)')} NOT IN ({ph}))"


def key(x: str) -> str:
    return (rf"lower({strip(rf'''regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\s+', ' ', 'g')''')})")


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plan_state(prefix: str = "") -> str:
    p = prefix
    r, c, u = valid(p + "rating"), valid(p + "review_count"), valid(p + "maps_url")
    return (f"CASE WHEN {blank(p + 'company_name')} OR {blank(p + 'company_address')} "
            f"THEN 'invalid' WHEN {r} AND {c} AND {u} THEN 'complete' "
            f"WHEN {r} AND {c} THEN 'url_only' ELSE 'full' END")


def catalogue(places_cte: str, cols=("place_id", "rating", "review_count", "maps_url")) -> str:
    sel = ", ".join(cols)
    return f"""
SELECT kn, ka, {sel} FROM (
  SELECT kn, ka, {sel}, row_number() OVER (
    PARTITION BY kn, ka ORDER BY review_count DESC NULLS LAST, place_id) AS rn
  FROM (SELECT *, {key('name')} AS kn, {key('address')} AS ka
        FROM {places_cte} WHERE place_id IS NOT NULL) x) y
WHERE rn = 1"""
