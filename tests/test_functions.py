"""Column expressions against small independent Python models."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions import html as H
from canvass.functions import text as T
from canvass.functions.template import parse_template, render_prompt

WS_CHARS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\xa0", " ", "　"]
texts = st.lists(st.sampled_from(WS_CHARS + list("aBc#Z9é-")), max_size=12).map("".join)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


@settings(max_examples=1, deadline=None)
@given(st.lists(texts, min_size=30, max_size=30))
def test_strip_collapse_key_match_python(spark, values):
    assert _eval(spark, values, T.strip) == [v.strip() for v in values]
    assert _eval(spark, values, T.collapse_ws) == [" ".join(v.split()) for v in values]
    assert _eval(spark, values, T.match_key) == [
        re.sub(r"\s+", " ", v).strip().lower() for v in values]
    assert _eval(spark, values, T.is_blank) == [not v.strip() for v in values]


def test_is_valid_rules(spark):
    vals = [None, "", "  ", "Not Found", " Not Found ", "not found", "0", "x"]
    assert _eval(spark, vals, T.is_valid) == [False, False, False, False, False, True, True, True]
    assert _eval(spark, vals, T.has_value) == [False, False, False, True, True, True, True, True]


def test_scheme_rules(spark):
    vals = ["//fb.com/a", "fb.com/a", "http://a", "httpbin.org", "/x"]
    assert _eval(spark, vals, T.link_with_scheme) == [
        "https://fb.com/a", "https://fb.com/a", "http://a", "httpbin.org", "https://x"]
    assert _eval(spark, vals, T.with_scheme) == [
        "https:////fb.com/a", "https://fb.com/a", "http://a", "httpbin.org", "https:///x"]


def test_prompt_value(spark):
    assert _eval(spark, [None, " ", " a b "], T.prompt_value) == ["N/A", "N/A", "a b"]


def test_location_and_radius_arguments():
    assert T.parse_location("30.2,-97.7") == (30.2, -97.7)
    with pytest.raises(ValueError):
        T.parse_location("30.2")
    with pytest.raises(ValueError):
        T.miles_to_metres(0)
    assert T.miles_to_metres(10) == 16093


PAGE = """<html><head><title> Joe &amp; Co </title>
<script>var a = '<a href="https://facebook.com/inscript">x</a></p>';</script>
<meta content="  Fresh   bread &amp; cakes " name="description"></head><body>
<!-- <a href="https://linkedin.com/company/commented">c</a> -->
<a href=''>empty</a>
<A HREF='//LinkedIn.com/company/joe-co'>L</A>
<a class="x" href=instagram.com/joe.co_1>i</a>
<a href="https://netflix.com/title/1">n</a>
<a href="https://facebook.com/second">f2</a>
<a href="https://x.com/joe?a=1&amp;b=2">t</a>
<p>First <b>para</b></p><p>second</p></body></html>"""


def _page(spark, html):
    df = spark.createDataFrame([("u", html)], "url string, html string")
    return H.page_features(df).collect()[0]


def test_page_links_title_meta(spark):
    r = _page(spark, PAGE)
    assert r["linkedin_url"] == "https://LinkedIn.com/company/joe-co"
    assert r["instagram_url"] == "https://instagram.com/joe.co_1"
    assert r["facebook_url"] == "https://facebook.com/second"
    # unanchored patterns: netflix.com/title matches x.com/ first (document order)
    assert r["twitter_url"] == "https://netflix.com/title/1"
    assert r["title"] == "Joe & Co"
    assert r["description"] == "Fresh   bread & cakes"


def test_first_paragraph_fallbacks(spark):
    r = _page(spark, "<title>T</title><meta name='description' content='  '>"
                     "<p></p><p>later</p>")
    assert r["description"] == ""
    r = _page(spark, "<title>T</title><body><p><b>Open <br><p>Next</p>")
    assert r["description"] == "Open"
    long = "w " * 400
    r = _page(spark, f"<p>{long}</p>")
    assert r["description"] == long.strip()[:300]
    r = _page(spark, "<meta name='Description' content='case matters'><p>para</p>")
    assert r["description"] == "para"


def test_brief_rules(spark):
    df = spark.createDataFrame(
        [("N", "T", "d  " * 150), ("N", "T", ""), ("N", "", ""), (None, "T", "")],
        "n string, t string, d string")
    out = [r[0] for r in df.select(H.brief("n", "t", "d")).collect()]
    assert out[0] == "N: " + " ".join(("d  " * 150).split())[:200]
    assert out[1:] == ["N - T", "N", " - T"]


def test_template_single_pass_and_escapes(spark):
    tpl = "Hi {company_name} {{literal}} at {website}; {product_description}"
    df = spark.createDataFrame([("{website}", "w.example")], "company_name string, website string")
    out = df.select(render_prompt(tpl, "P {x}", df.columns)).collect()[0][0]
    assert out == "Hi {website} {literal} at w.example; P {x}"
    assert out == tpl.format(company_name="{website}", website="w.example",
                             product_description="P {x}")


def test_template_errors_fail_early():
    with pytest.raises(KeyError):
        parse_template("Hello {nope}")
    with pytest.raises(ValueError):
        parse_template("Hello {}")
    with pytest.raises(ValueError):
        parse_template("{rating:.1f}")


def test_template_missing_column_is_na(spark):
    df = spark.createDataFrame([(1,)], "row_id int")
    out = df.select(render_prompt("{company_phone}|{rating}", "", df.columns)).collect()[0][0]
    assert out == "N/A|N/A"


def test_character_references_and_exact_tag_names(spark):
    from canvass.functions.html import decode_entities, page_features
    cases = [("Caf&eacute; &#8217;n&#x27; &mdash;&hellip; &amp;lt; &bogus; &#0; &#x1F600; a&b &nbsp;.",
              "Café ’n' —… &lt; &bogus; � \U0001F600 a&b  ."), ("plain", "plain"), (None, None), ("&", "&"), ("", "")]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", decode_entities("raw").alias("got")).collect())
    page = ("<title-bar>no</title-bar><title>Caf&eacute;</title><p-card>no</p-card><metadata name='description' "
            "content='no'><p class=x>It&#8217;s</p>")
    r = page_features(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert (r["title"], r["description"]) == ("Café", "It’s")


def test_captured_failure_reasons(spark):
    from canvass.plans.web import enrich_web
    long = "connection reset " + "by peer " * 20
    pages = spark.createDataFrame([("https://a", None, "Timeout"), ("https://b", None, "SSL Error"), ("https://c", None, long),
                                   ("https://d", "<title>T</title>", None)], "url string, html string, fetch_error string")
    leads = spark.createDataFrame([(i, "N", f"https://{s}", None) for i, s in enumerate("abcd")],
                                  "row_id bigint, company_name string, website string, research_brief string")
    got = [r["research_brief"] for r in enrich_web(leads, pages).orderBy("row_id").collect()]
    assert got == ["Could not fetch: Timeout", "Could not fetch: SSL Error",
                   "Could not fetch: Request failed: " + long[:50], "N - T"]


def test_hostile_pages_take_linear_time(spark):
    import time

    from canvass.functions.html import clean_html, page_features

    units = ["<!--", "<script>", "<script ", "<style>x", "<a ", "<", "<!-- x --", "</script ", "<script><!--"]
    pages = [(i, u * (1_000_000 // len(u))) for i, u in enumerate(units)]
    df = spark.createDataFrame(pages, "page_id int, html string").withColumn("url", F.lit("u"))
    page_features(df.limit(1), keep=("page_id",)).collect()
    begun = time.perf_counter()
    assert len(page_features(df, keep=("page_id",)).collect()) == len(units)
    assert time.perf_counter() - begun < 1.5 * len(units)
    got = {h: c for h, c in spark.createDataFrame([("a<!-- b",), ("a<script>b",), ("a <p>b <i",), ("a < b > c",)], "h string")
           .select("h", clean_html("h")).collect()}
    assert got == {"a<!-- b": "a ", "a<script>b": "a ", "a <p>b <i": "a <p>b ", "a < b > c": "a < b > c"}
