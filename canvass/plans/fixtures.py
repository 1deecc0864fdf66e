"""Lead-shaped inputs derived from the driver tables.

Each derivation is one SQL text valid in both Spark SQL and DuckDB, so the
Spark query and the DuckDB oracle start from identical rows.  Every
derivation reads its whole source tables: the modulo rules below only vary
*values* (blank names, present ratings, ...) and never drop rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "pages", "documents",
          "events", "conversations"]


_REGISTERED: dict[tuple[int, str], str] = {}


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose driver tables as temp views (the names the SQL below uses).

    A view is (re)created only when it is missing or points at another
    directory, so building a plan does not re-read parquet footers.
    """
    sid = id(spark)
    for t in names:
        if _REGISTERED.get((sid, t)) == sf_dir and spark.catalog.tableExists(t):
            continue
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        _REGISTERED[(sid, t)] = sf_dir


def tables_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql.lower()))
    return [t for t in TABLES if t in words]


def _url(k: str) -> str:
    return f"'https://maps.example/?cid=' || CAST({k} AS STRING)"


# Leads: one per customer.  Names are missing for k%17, padded upper case
# for k%5; addresses blank for k%19; ratings present for k%4; counts for
# k%4 or k%6; map URLs present for k%8, 'Not Found' for k%12.
F_LEADS = f"""
SELECT c.c_custkey AS row_id,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL
       WHEN c.c_custkey % 5 = 0 THEN '  ' || upper(c.c_name) || ' '
       ELSE c.c_name END AS company_name,
  CASE WHEN c.c_custkey % 19 = 0 THEN '   '
       ELSE n.n_name || ',  ' || r.r_name END AS company_address,
  c.c_mktsegment || '-' || CAST(c.c_custkey AS STRING) AS company_phone,
  p.url AS website,
  CASE WHEN c.c_custkey % 4 = 0
       THEN round(CAST(1.0 + (c.c_custkey % 41) / 10 AS DOUBLE), 1) END AS rating,
  CASE WHEN c.c_custkey % 4 = 0 OR c.c_custkey % 6 = 0
       THEN CAST(c.c_custkey % 300 AS BIGINT) END AS review_count,
  CASE WHEN c.c_custkey % 8 = 0 THEN {_url('c.c_custkey')}
       WHEN c.c_custkey % 12 = 0 THEN 'Not Found' END AS maps_url
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN pages p ON p.page_id = c.c_custkey
"""

# Place catalogue: one place per customer (addresses of k%3 carry a
# ' (branch)' suffix so those leads miss), plus a second, lower-ranked
# place with the same name and address for k%7 (top-1 must pick the first).
_PLACE_COLS = """
  c.c_name AS name,
  CASE WHEN c.c_custkey % 3 = 0 THEN n.n_name || ', ' || r.r_name || ' (branch)'
       ELSE n.n_name || ', ' || r.r_name END AS address,
  c.c_mktsegment || '-' || CAST(c.c_custkey AS STRING) AS phone,
  lower(c.c_mktsegment) AS category,
  p.url AS website,
  CASE WHEN c.c_custkey % 10 <> 0
       THEN round(CAST(1.0 + ((c.c_custkey * 7) % 41) / 10 AS DOUBLE), 1) END AS rating,
  {count} AS review_count,
  {url} AS maps_url,
  CAST(-60 + c.c_custkey % 120 AS DOUBLE) AS lat,
  CAST(-170 + (7 * c.c_custkey) % 340 AS DOUBLE) AS lng
"""
_PLACE_FROM = """
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN pages p ON p.page_id = c.c_custkey
"""
_COUNT = "CASE WHEN c.c_custkey % 11 <> 0 THEN CAST((c.c_custkey * 13) % 500 AS BIGINT) END"
F_PLACES = (
    "SELECT 'places/' || CAST(c.c_custkey AS STRING) AS place_id,"
    + _PLACE_COLS.format(count=_COUNT, url=_url("c.c_custkey")) + _PLACE_FROM
    + " UNION ALL SELECT 'places/x' || CAST(c.c_custkey AS STRING) AS place_id,"
    + _PLACE_COLS.format(count=f"({_COUNT}) - 1",
                         url="'https://maps.example/?alt=' || CAST(c.c_custkey AS STRING)")
    + _PLACE_FROM + " WHERE c.c_custkey % 7 = 0"
)

# Append inputs.  Existing: every customer with its map URL.  New: every
# customer again, where odd keys got a new URL (cid + 1,000,000), k%5 names
# are upper-cased and double-spaced, k%13 URLs are blank, and k%50 rows are
# sent twice (a duplicate inside the new batch survives).
# Leads as a user's spreadsheet holds them: own headers, text cells with
# quotes, newlines, outer spaces, thousands separators and placeholders.
F_SHEET = f"""
SELECT row_id, company_name AS business_name, company_address AS business_address,
  CASE WHEN row_id % 9 = 0 THEN 'said "' || company_phone || '"' || chr(10) || ' twice '
       WHEN row_id % 10 = 0 THEN ' n/k, ' || company_phone ELSE company_phone END AS notes,
  CASE WHEN row_id % 4 = 0 THEN CAST(rating AS STRING) WHEN row_id % 7 = 0 THEN 'n/k' END AS rating,
  CASE WHEN row_id % 4 = 0 THEN '1,' || CAST(100 + row_id % 300 AS STRING)
       WHEN row_id % 6 = 0 THEN 'Not Found' END AS review_count,
  maps_url
FROM ({F_LEADS}) sheet_leads
"""

F_APPEND_EXISTING = f"""
SELECT c.c_custkey AS row_id, c.c_name AS company_name,
  n.n_name || ', ' || r.r_name AS company_address,
  {_url('c.c_custkey')} AS maps_url
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
_NEW_COLS = f"""
  CASE WHEN c.c_custkey % 5 = 0 THEN ' ' || replace(upper(c.c_name), '#', '  #') || ' '
       ELSE c.c_name END AS company_name,
  n.n_name || ', ' || r.r_name AS company_address,
  c.c_mktsegment || '-' || CAST(c.c_custkey AS STRING) AS company_phone,
  CAST(NULL AS STRING) AS website,
  round(CAST(1.0 + (c.c_custkey % 41) / 10 AS DOUBLE), 1) AS rating,
  CAST(c.c_custkey % 300 AS BIGINT) AS review_count,
  CASE WHEN c.c_custkey % 13 = 0 THEN ''
       WHEN c.c_custkey % 2 = 1 THEN {_url('c.c_custkey + 1000000')}
       ELSE {_url('c.c_custkey')} END AS maps_url
"""
_NEW_FROM = """
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
F_APPEND_NEW = (
    "SELECT c.c_custkey AS row_id," + _NEW_COLS + _NEW_FROM
    + " UNION ALL SELECT c.c_custkey + 10000000 AS row_id," + _NEW_COLS + _NEW_FROM
    + " WHERE c.c_custkey % 50 = 0"
)
# Existing side without a URL column (forces the name + address rule).
F_APPEND_EXISTING_NO_URL = f"""
SELECT row_id, company_name, company_address FROM ({F_APPEND_EXISTING}) e
"""

# Pages with injected markup (identical ``replace`` in both engines):
#   id%6=0 facebook (protocol-relative) + x.com link with an entity,
#   id%6=1 upper-case single-quoted LinkedIn link + a commented-out link,
#   id%6=2 a meta description, id%6=3 no <p> at all, id%6=4 unquoted
#   instagram link, id%6=5 unchanged.
F_HTML = """
SELECT page_id, url,
  CASE page_id % 6
    WHEN 0 THEN replace(html, '</nav>',
      '<a href="//facebook.com/biz.' || CAST(page_id AS STRING) || '">f</a>'
      || '<a href="https://x.com/b_' || CAST(page_id AS STRING) || '?a=1&amp;b=2">x</a></nav>')
    WHEN 1 THEN replace(html, '</nav>',
      '<A HREF=''linkedin.com/company/c-' || CAST(page_id AS STRING) || '''>l</A>'
      || '<!-- <a href="https://instagram.com/hidden_' || CAST(page_id AS STRING)
      || '">i</a> --></nav>')
    WHEN 2 THEN replace(html, '</head>',
      '<meta name="description" content="  Best   shop  ' || CAST(page_id AS STRING)
      || ' "></head>')
    WHEN 3 THEN replace(replace(html, '<p>', '<div>'), '</p>', '</div>')
    WHEN 4 THEN replace(html, '</nav>',
      '<a class=s href=instagram.com/shop_' || CAST(page_id AS STRING) || '>i</a></nav>')
    ELSE html END AS html
FROM pages
"""

# Leads for the web stage: F-leads with an existing brief for k%7 (kept),
# a failed brief for k%9 (retried), and websites without a scheme for k%10.
F_WEB_LEADS = f"""
SELECT row_id, company_name, company_address,
  CASE WHEN row_id % 10 = 0 AND website IS NOT NULL
       THEN replace(replace(website, 'https://', ''), 'http://', '')
       WHEN row_id % 23 = 0 THEN '' ELSE website END AS website,
  CASE WHEN row_id % 7 = 0 THEN 'Known brief ' || CAST(row_id AS STRING)
       WHEN row_id % 9 = 0 THEN 'Could not fetch: Timeout'
       WHEN row_id % 29 = 0 THEN '  ' END AS research_brief,
  rating, review_count
FROM ({F_LEADS}) l
"""

# Leads for prompts / generation: F-leads plus web columns and an existing
# generated text for some rows.
F_EMAIL_LEADS = f"""
SELECT row_id, company_name, company_address, company_phone, website, rating,
  review_count, maps_url,
  CASE WHEN row_id % 6 = 0 THEN 'https://linkedin.com/company/c-' || CAST(row_id AS STRING)
       ELSE '' END AS linkedin_url,
  '' AS facebook_url, CAST(NULL AS STRING) AS instagram_url, '' AS twitter_url,
  CASE WHEN row_id % 3 = 0 THEN company_name || ': sells {{website}} things' END
    AS research_brief,
  CASE WHEN row_id % 9 = 0 THEN 'Error: LLM error: x'
       WHEN row_id % 10 = 0 THEN 'done'
       WHEN row_id % 11 = 0 THEN '  ' END AS generated_email
FROM ({F_LEADS}) l
"""


_PLANS: dict[tuple[int, str, str], DataFrame] = {}


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived input as a lazy DataFrame.  The analysed plan is reused
    per (session, directory, SQL): nothing is cached or precomputed, every
    action still reads the files."""
    key = (id(spark), sf_dir, sql)
    df = _PLANS.get(key)
    if df is None or df.sparkSession is not spark:
        register(spark, sf_dir, tables_in(sql))
        df = _PLANS[key] = spark.sql(sql)
    return df


# Captured responses: one search query per nation, place pages of
# customers grouped by key range (page = k div 100, at most 100 places per
# page, places ordered by key).  Nation 1's last page failed (HTTP 500),
# nation 2's last page has no ``places``, nation 3's first page has an empty
# list, nation 4's first page has no next-page token.
F_RESPONSE_ROWS = """
SELECT n.n_name AS query, n.n_nationkey AS nkey, c.c_custkey AS k,
  CAST(floor(c.c_custkey / 100) AS BIGINT) AS page,
  'places/' || CAST(c.c_custkey AS STRING) AS id,
  c.c_name AS name,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE n.n_name || ', ' || r.r_name END AS address,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE '555-' || CAST(c.c_custkey AS STRING) END AS phone,
  CASE WHEN c.c_custkey % 10 <> 0
       THEN round(CAST(1.0 + ((c.c_custkey * 7) % 41) / 10 AS DOUBLE), 1) END AS rating,
  CASE WHEN c.c_custkey % 11 <> 0 THEN CAST((c.c_custkey * 13) % 500 AS BIGINT) END AS review_count,
  'https://maps.example/?cid=' || CAST(c.c_custkey AS STRING) AS maps_url
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
F_RESPONSE_PAGES = f"""
WITH rows AS ({F_RESPONSE_ROWS}),
pages AS (SELECT query, nkey, page FROM rows GROUP BY query, nkey, page),
span AS (SELECT query, min(page) AS lo, max(page) AS hi FROM pages GROUP BY query)
SELECT p.query, p.nkey, p.page,
  CASE WHEN p.nkey = 1 AND p.page = s.hi THEN 500 ELSE 200 END AS status,
  CASE WHEN p.nkey = 2 AND p.page = s.hi THEN 'missing'
       WHEN p.nkey = 3 AND p.page = s.lo THEN 'empty'
       WHEN p.nkey = 1 AND p.page = s.hi THEN 'error'
       ELSE 'ok' END AS body_kind,
  NOT (p.nkey = 4 AND p.page = s.lo) AS has_token
FROM pages p JOIN span s ON p.query = s.query
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query, page, status, body)`` with JSON bodies built by Spark."""
    from pyspark.sql import functions as F

    register(spark, sf_dir, tables_in(F_RESPONSE_ROWS))
    rows = spark.sql(F_RESPONSE_ROWS)
    place = F.struct(
        F.col("id"), F.struct(F.col("name").alias("text")).alias("displayName"),
        F.col("address").alias("formattedAddress"), F.col("phone").alias("nationalPhoneNumber"),
        F.col("rating"), F.col("review_count").alias("userRatingCount"),
        F.col("maps_url").alias("googleMapsUri"))
    # At most 100 places per (query, page): the key range bounds the list.
    packed = (rows.groupBy("query", "page")
              .agg(F.sort_array(F.collect_list(F.struct(F.col("k"), place.alias("p"))))
                   .alias("_ps"))
              .select("query", "page", F.transform("_ps", lambda x: x["p"]).alias("places")))
    meta = spark.sql(F_RESPONSE_PAGES)
    j = packed.join(meta, ["query", "page"])
    token = F.when(F.col("has_token"), F.concat(F.lit("tok-"), F.col("page").cast("string")))
    kind = F.col("body_kind")
    body = (F.when(kind == "ok", F.to_json(F.struct(F.col("places"), token.alias("nextPageToken"))))
            .when(kind == "empty", F.to_json(F.struct(
                F.array().cast(T_PLACES).alias("places"), token.alias("nextPageToken"))))
            .when(kind == "missing", F.to_json(F.struct(token.alias("nextPageToken"))))
            .otherwise(F.lit('{"error": {"message": "quota exceeded"}}')))
    return j.select("query", "page", "status", body.alias("body"))


T_PLACES = ("array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,"
            "nationalPhoneNumber:string,rating:double,userRatingCount:bigint,"
            "googleMapsUri:string>>")

# Search results in two field-naming styles (customers in the current style,
# suppliers in the legacy one) for record harmonisation.
F_RECORDS_NEW = """
SELECT c.c_custkey AS rec_id, c.c_name AS `Company Name`, n.n_name AS `Company Address`,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_mktsegment END AS `Phone Number`,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'https://c' || CAST(c.c_custkey AS STRING) || '.example'
       END AS `Website`,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE round(abs(c.c_acctbal) / 2000, 1) END
    AS `Google Review Rating`,
  CAST(c.c_custkey % 97 AS BIGINT) AS `Google Review Count`
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
F_RECORDS_LEGACY = """
SELECT s.s_suppkey + 100000000 AS rec_id, s.s_name AS name, n.n_name AS address,
  'tel-' || CAST(s.s_suppkey AS STRING) AS phone,
  CASE WHEN s.s_suppkey % 2 = 1 THEN 'https://s' || CAST(s.s_suppkey AS STRING) || '.example'
       END AS website,
  round(abs(s.s_acctbal) / 2000, 1) AS rating,
  CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE CAST(s.s_suppkey % 89 AS BIGINT) END
    AS review_count
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

# Leads with misspelled names: one inserted letter (k%4=1), one substituted
# letter (k%4=2), two edits (k%4=3, must not match); others as in F-leads.
F_FUZZY_LEADS = f"""
SELECT row_id,
  CASE row_id % 4 WHEN 1 THEN replace(company_name, 'Customer#', 'Custommer#')
                  WHEN 2 THEN replace(company_name, 'Customer#', 'Kustomer#')
                  WHEN 3 THEN replace(company_name, 'Customer#', 'Costumer#')
                  ELSE company_name END AS company_name,
  company_address
FROM ({F_LEADS}) l
"""

# The leads with all their columns and the misspellings above.
F_MISSPELT = f"""
SELECT l.row_id, f.company_name, l.company_address, l.company_phone, l.website, l.rating, l.review_count, l.maps_url
FROM ({F_LEADS}) l JOIN ({F_FUZZY_LEADS}) f ON l.row_id = f.row_id
"""
