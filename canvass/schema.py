"""Canonical lead schema: internal column names, types and external headers."""

from __future__ import annotations

from pyspark.sql import types as T

# Internal column name -> (Spark type, external CSV header).
LEAD_FIELDS: dict[str, tuple[T.DataType, str]] = {
    "row_id": (T.LongType(), "Row Id"),
    "company_name": (T.StringType(), "Company Name"),
    "company_address": (T.StringType(), "Company Address"),
    "company_phone": (T.StringType(), "Company Phone"),
    "website": (T.StringType(), "Website"),
    "rating": (T.DoubleType(), "Google Review Rating"),
    "review_count": (T.LongType(), "Google Review Count"),
    "maps_url": (T.StringType(), "Google Maps URL"),
    "linkedin_url": (T.StringType(), "LinkedIn URL"),
    "facebook_url": (T.StringType(), "Facebook URL"),
    "instagram_url": (T.StringType(), "Instagram URL"),
    "twitter_url": (T.StringType(), "Twitter URL"),
    "research_brief": (T.StringType(), "Research Brief"),
    "generated_email": (T.StringType(), "Generated Email"),
}

# Header aliases accepted for each internal column, in the
# order they are tried (loose match: case, '_' and '-' as space, outer
# spaces ignored).  Enrichment prefers "Business ..." headers, append-dedup
# prefers "Company ..." headers.
HEADER_ALIASES: dict[str, list[str]] = {
    "company_name": ["Company Name", "Business Name"],
    "company_address": ["Company Address", "Business Address"],
    "company_phone": ["Company Phone", "Phone Number"],
    "website": ["Website"],
    "rating": ["Google Review Rating"],
    "review_count": ["Google Review Count"],
    "maps_url": ["Google Maps URL"],
    "linkedin_url": ["LinkedIn URL"],
    "facebook_url": ["Facebook URL"],
    "instagram_url": ["Instagram URL"],
    "twitter_url": ["Twitter URL"],
    "research_brief": ["Research Brief"],
    "generated_email": ["Generated Email"],
}
ENRICH_ALIASES = {
    "company_name": ["Business Name", "Company Name"],
    "company_address": ["Business Address", "Company Address"],
}

SOCIAL_COLUMNS = ["linkedin_url", "facebook_url", "instagram_url", "twitter_url"]
WEB_COLUMNS = SOCIAL_COLUMNS + ["research_brief"]

# Place catalogue (the lookup side): one row per place.
PLACE_SCHEMA = T.StructType([
    T.StructField("place_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("maps_url", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

ERROR_COLUMNS = ["row", "business_name", "business_address", "error", "timestamp"]

# Messages written to error rows and briefs.
MSG_MISSING_KEY = "Missing business name or address"
MSG_NOT_FOUND = "Business not found on Google Maps"
MSG_NO_WEBSITE = "No website available"
MSG_NO_WEBSITE_URL = "No website URL"
MSG_NOT_IN_SNAPSHOT = "Page not in snapshot"
PREFIX_FETCH_FAILED = "Could not fetch: "
PREFIX_GEN_ERROR = "Error: "
PREFIX_LLM_ERROR = "LLM error: "
NOT_FOUND_TOKEN = "Not Found"
