"""Website stage: social links and a research brief for each lead.

The crawl snapshot (``pages(url, html[, status][, fetch_error])``) replaces
live fetches.
Plan shape: pages -> per-page features (narrow; HTML dropped right there)
-> one row per URL -> left join from the leads that need a fetch.  Leads
that are done (or have no website in batch mode) never enter the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import brief, failure_brief, page_features
from ..functions.text import is_blank, short_error, with_scheme
from ..operators.columns import ensure_columns
from ..operators.skew import skew_safe_join
from ..operators.topn import best_per_key
from ..schema import (MSG_NO_WEBSITE, MSG_NO_WEBSITE_URL, MSG_NOT_IN_SNAPSHOT,
                      SOCIAL_COLUMNS, WEB_COLUMNS)

FEATURES = SOCIAL_COLUMNS + ["title", "description"]


def web_state(mode: str = "batch") -> Column:
    """'done' | 'no_site' | 'fetch'.

    batch:       done when the brief is a non-empty text that does not start
                 with 'Could not fetch'; a null or '' website -> 'no_site'.
    interactive: done when the brief is non-blank and does not start with
                 'Could not'; every other row is fetched.
    """
    b = F.col("research_brief")
    if mode == "batch":
        done = b.isNotNull() & (b != "") & ~b.startswith("Could not fetch")
        w = F.col("website")
        return (F.when(done, "done").when(w.isNull() | (w == ""), "no_site")
                .otherwise("fetch"))
    if mode == "interactive":
        done = ~is_blank(b) & ~F.coalesce(b.startswith("Could not"), F.lit(False))
        return F.when(done, "done").otherwise("fetch")
    raise ValueError(f"unknown mode {mode!r}")


def page_table(pages: DataFrame, unique_urls: bool = False) -> DataFrame:
    """One feature row per URL.

    A URL crawled more than once keeps one crawl: the latest (when the
    snapshot has ``fetched_at``), then a 2xx one, then one with a
    description, then one with a title, then the smallest texts (a
    deterministic tie-break).  A partial aggregate, never a per-URL collect.
    """
    keep = ("fetched_at",) if "fetched_at" in pages.columns else ()
    more = ("fetch_error",) if "fetch_error" in pages.columns else ()
    feats = page_features(pages, keep=keep + more)
    if unique_urls:
        return feats.drop(*keep)
    extra = [c for c in ("status", "fetch_error") if c in feats.columns]
    order = []
    if keep:
        order.append((F.col("fetched_at").cast("timestamp").cast("double"), "desc"))
    if "fetch_error" in extra:
        order.append((~is_blank("fetch_error"), "asc"))
    if "status" in extra:
        order.append((~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "asc"))
    order += [(F.col("description") == "", "asc"), (F.col("title") == "", "asc"),
              ("description", "asc"), ("title", "asc")]
    return best_per_key(feats, ["url"], order, FEATURES + extra)


def fetch_error(status_col) -> Column:
    return F.concat(F.lit("Request failed: HTTP "), status_col.cast("string"))


def captured_error(reason: Column) -> Column:
    """A crawl's own failure text: 'Timeout' and 'SSL Error' as they are, any
    other as a failed request, cut at 50 characters."""
    return F.when(reason.isin("Timeout", "SSL Error"), reason).otherwise(
        F.concat(F.lit("Request failed: "), short_error(reason, 50)))


def enrich_web(leads: DataFrame, pages: DataFrame, mode: str = "batch",
               unique_urls: bool = False) -> DataFrame:
    """Leads with the four social links and the research brief filled for
    the rows that need them.  A website shared by very many leads is split
    at run time (``operators.skew``)."""
    leads = ensure_columns(leads, {c: ("string", "") for c in WEB_COLUMNS})
    cols = leads.columns
    staged = leads.withColumn("_ws", web_state(mode))
    ws = F.col("_ws")
    rest = staged.where(ws != "fetch").select(*[
        F.when(ws == "no_site", F.lit(MSG_NO_WEBSITE)).otherwise(F.col(c)).alias(c)
        if c == "research_brief" else F.col(c) for c in cols])

    no_url = F.col("website").isNull() | (F.col("website") == "")
    # Rows without a URL never enter the join: null join keys would all hash
    # to one partition.  They only need the failure text.
    no_site = staged.where((ws == "fetch") & no_url).select(*[
        F.lit("").alias(c) if c in SOCIAL_COLUMNS else
        failure_brief(F.lit(MSG_NO_WEBSITE_URL)).alias(c) if c == "research_brief" else
        F.col(c) for c in cols])
    todo = staged.where((ws == "fetch") & ~no_url).withColumn("_url", with_scheme("website"))
    feats = page_table(pages, unique_urls)
    feats = feats.select(F.col("url").alias("_url"), *[F.col(c).alias("_f_" + c)
                                                       for c in feats.columns if c != "url"],
                         F.lit(True).alias("_hit"))
    j = skew_safe_join(todo, feats, ["_url"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    reason = F.when(~hit, F.lit(MSG_NOT_IN_SNAPSHOT))
    if "_f_fetch_error" in j.columns:
        reason = reason.when(~is_blank("_f_fetch_error"), captured_error(F.col("_f_fetch_error")))
    if "_f_status" in j.columns:
        reason = reason.when(~F.col("_f_status").between(200, 299),
                             fetch_error(F.col("_f_status")))
    out = []
    for c in cols:
        if c in SOCIAL_COLUMNS:
            out.append(F.when(reason.isNull(), F.col("_f_" + c)).otherwise(F.lit("")).alias(c))
        elif c == "research_brief":
            out.append(F.when(reason.isNull(),
                              brief(F.col("company_name"), F.col("_f_title"),
                                    F.col("_f_description")))
                       .otherwise(failure_brief(reason)).alias(c))
        else:
            out.append(F.col(c))
    return rest.unionByName(no_site).unionByName(j.select(*out))
