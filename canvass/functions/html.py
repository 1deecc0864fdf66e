"""Web-page extraction as column expressions (no tree parser, no UDF).

A page is cleaned once (comments, scripts, styles blanked), its anchor
``href`` values are pulled out in document order as an array, and every
extracted field is a regular-expression projection over those two values.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, collapse_ws, link_with_scheme, strip

# Social platforms and the link patterns that identify them,
# tried in this order; an href is matched case-insensitively anywhere.
SOCIAL_PATTERNS: dict[str, list[str]] = {
    "linkedin_url": [r"linkedin\.com/company/[\w-]+", r"linkedin\.com/in/[\w-]+"],
    "facebook_url": [r"facebook\.com/[\w.-]+", r"fb\.com/[\w.-]+"],
    "instagram_url": [r"instagram\.com/[\w._]+"],
    "twitter_url": [r"twitter\.com/[\w_]+", r"x\.com/[\w_]+"],
}

# Named references: the HTML set of the standard library, plus two; a
# non-breaking space reads as a space.
NAMED = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'", "nbsp": " "}
_REFERENCE_RE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});"

# The end of a tag name: 'p' must not match '<p-card>'.
_E = r"(?=[\s/>])"
# What is never closed goes to the end of the page, as browsers have it; so no
# opening is looked at twice, however many there are.
_HIDDEN_RE = (r"(?is)<!--.*?(?:-->|\z)"
              r"|<script" + _E + r"[^>]*+(?:>.*?(?:</script\s*>|\z)|\z)"
              r"|<style" + _E + r"[^>]*+(?:>.*?(?:</style\s*>|\z)|\z)")
_ATTR_VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_HREF_RE = r"(?is)<a\s[^>]*?(?<![\w-])href\s*=\s*" + _ATTR_VALUE
_TITLE_RE = r"(?is)<title" + _E + r"[^>]*>(.*?)</title\s*>"
_META_DESC_RE = (r"(?s)(<(?i:meta)" + _E + r"[^>]*?(?<![\w-])(?i:name)\s*=\s*"
                 r"(?:\"description\"|'description'|description(?=[\s/>]))[^>]*>)")
_CONTENT_RE = r"(?s)(?<![\w-])(?i:content)\s*=\s*" + _ATTR_VALUE
# First <p>: its body ends at </p, at the next block-level start tag, at the
# end tag of an enclosing block, or at the end of the page.
_BLOCK = (r"p|div|ul|ol|dl|table|h[1-6]|hr|pre|form|blockquote|address|fieldset"
          r"|section|article|header|footer|nav|aside|main|figure")
_CLOSE = r"div|article|section|body|html|td|th|li|blockquote|form|main|aside|header|footer|nav"
_FIRST_P_RE = (r"(?is)<p" + _E + r"[^>]*>(.*?)(?=</p\s*>|<(?:" + _BLOCK + ")" + _E + "|</(?:"
               + _CLOSE + ")" + _E + r"|\z)")


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def decode_entities(c) -> Column:
    """Numeric and named character references decoded, each once."""
    c = _c(c)
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(ref):
        body = F.regexp_replace(ref, "^&|;$", "")
        return (F.when(body.rlike("^#[xX]"), _character(F.conv(F.substring(body, 3, 8), 16, 10).cast("bigint")))
                .when(body.startswith("#"), _character(F.substring(body, 2, 8).cast("bigint")))
                .otherwise(F.coalesce(F.try_element_at(names, body), ref)))

    found = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE_RE), F.lit(0)), decoded)
    text = F.array_join(F.transform(F.split(c, _REFERENCE_RE, -1), lambda part, i: F.concat(
        part, F.coalesce(F.get(found, i), F.lit("")))), "")
    return F.when(c.contains("&"), text).otherwise(c)


def unquote(c) -> Column:
    """Drop one pair of matching outer quotes from an attribute value."""
    c = _c(c)
    quoted = c.rlike(r"^(\"[\s\S]*\"|'[\s\S]*')$")
    return F.when(quoted, c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def clean_html(html) -> Column:
    """Page with comments, scripts and styles removed, and a tag that its end cuts off."""
    page = F.regexp_replace(F.coalesce(_c(html), F.lit("")), _HIDDEN_RE, " ")
    tail = F.substring_index(page, ">", -1)
    return F.concat(F.substr(page, F.lit(1), F.length(page) - F.length(tail)), F.substring_index(tail, "<", 1))


def hrefs(clean) -> Column:
    """All ``<a href>`` values in document order, unquoted and decoded."""
    raw = F.regexp_extract_all(_c(clean), F.lit(_HREF_RE), 1)
    return F.transform(raw, lambda v: decode_entities(unquote(v)))


def first_match(href_array, patterns) -> Column:
    """First element matching any pattern (case-insensitive search), or null."""
    rx = "(?iU)" + "|".join(patterns)
    return F.get(F.filter(_c(href_array), lambda h: h.rlike(rx)), 0)


def social_links(href_array) -> dict[str, Column]:
    """First href per platform (document order), given a scheme; else ''."""
    return {name: F.coalesce(link_with_scheme(first_match(href_array, pats)), F.lit(""))
            for name, pats in SOCIAL_PATTERNS.items()}


def page_title(clean) -> Column:
    return strip(decode_entities(F.regexp_extract(_c(clean), _TITLE_RE, 1)))


def meta_description(clean) -> Column:
    tag = F.regexp_extract(_c(clean), _META_DESC_RE, 1)
    content = F.regexp_extract(tag, _CONTENT_RE, 1)
    return strip(decode_entities(unquote(content)))


def first_paragraph(clean) -> Column:
    body = F.regexp_extract(_c(clean), _FIRST_P_RE, 1)
    text = decode_entities(F.regexp_replace(body, r"(?s)<[^>]*>", ""))
    return F.substring(strip(text), 1, 300)


def page_description(clean) -> Column:
    """Meta description, or (only when it is blank) the first paragraph."""
    meta = meta_description(clean)
    return F.when(meta != "", meta).otherwise(first_paragraph(clean))


def brief(name, title, description) -> Column:
    """``name: desc`` (white space collapsed, 200 chars), else ``name - title``,
    else the name.  A null name is treated as ''."""
    n = F.coalesce(_c(name).cast("string"), F.lit(""))
    d, t = _c(description), _c(title)
    return (F.when(F.coalesce(d, F.lit("")) != "",
                   F.concat(n, F.lit(": "), F.substring(collapse_ws(d), 1, 200)))
            .when(F.coalesce(t, F.lit("")) != "", F.concat(n, F.lit(" - "), t))
            .otherwise(n))


def failure_brief(reason) -> Column:
    return F.concat(F.lit("Could not fetch: "), _c(reason))


def page_features(pages, url_col: str = "url", html_col: str = "html", keep=()):
    """Per-page extraction: url, 4 social links, title, description.

    A narrow projection chain (no shuffle).  Each regular expression that
    scans the whole page runs once per page in its own projection (the
    optimizer does not inline a non-trivial expression that is used twice);
    the raw HTML is dropped right after cleaning so it never reaches a
    shuffle.
    """
    passthrough = [c for c in pages.columns if c == "status" or c in keep]
    s1 = pages.select(F.col(url_col).alias("url"), *passthrough,
                      clean_html(F.col(html_col)).alias("_clean"))
    s2 = s1.select(
        "url", *passthrough,
        hrefs("_clean").alias("_hrefs"),
        F.regexp_extract("_clean", _TITLE_RE, 1).alias("_title"),
        F.regexp_extract("_clean", _META_DESC_RE, 1).alias("_meta_tag"),
        F.regexp_extract("_clean", _FIRST_P_RE, 1).alias("_p_body"))
    firsts = {name: first_match(F.col("_hrefs"), pats) for name, pats in SOCIAL_PATTERNS.items()}
    s3 = s2.select(
        "url", *passthrough,
        *[v.alias("_first_" + k) for k, v in firsts.items()],
        strip(decode_entities(F.col("_title"))).alias("title"),
        F.regexp_extract("_meta_tag", _CONTENT_RE, 1).alias("_content"),
        "_p_body")
    s4 = s3.select(
        "url", *passthrough,
        *[F.coalesce(link_with_scheme(F.col("_first_" + k)), F.lit("")).alias(k)
          for k in SOCIAL_PATTERNS],
        "title",
        strip(decode_entities(unquote("_content"))).alias("_meta"),
        "_p_body")
    return s4.select(
        "url", *passthrough, *SOCIAL_PATTERNS.keys(), "title",
        F.when(F.col("_meta") != "", F.col("_meta")).otherwise(
            F.substring(strip(decode_entities(F.regexp_replace("_p_body", r"(?s)<[^>]*>", ""))),
                        1, 300)).alias("description"))
