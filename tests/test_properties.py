"""Property tests against small independent Python models."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions.html import brief
from canvass.functions.template import TEMPLATE_VARIABLES, render_prompt
from canvass.functions.text import link_with_scheme, with_scheme
from canvass.operators.append import append_new
from canvass.plans import fixtures as fx
from canvass.plans.enrich import enrich_leads, enrich_reviews
from canvass.plans.web import enrich_web
from canvass.operators.generate import generate

from conftest import SF_SMALL

VARS = [v for v in TEMPLATE_VARIABLES if v != "product_description"]
piece = st.one_of(
    st.sampled_from([f"{{{v}}}" for v in TEMPLATE_VARIABLES]),
    st.sampled_from(["{{", "}}", "{{x}}", " ", "\n", "é", "Hi ", ": "]),
    st.text(alphabet="abc XYZ.,-", max_size=5))
templates = st.lists(piece, max_size=8).map("".join)
values = st.one_of(st.none(), st.sampled_from(["", "  ", " a ", "{website}", "x\ny", "N/A"]))


def _py_value(v):
    if v is None or not v.strip():
        return "N/A"
    return v.strip()


@settings(max_examples=4, deadline=None)
@given(st.lists(templates, min_size=5, max_size=5),
       st.lists(st.fixed_dictionaries({v: values for v in VARS}), min_size=3, max_size=3),
       st.sampled_from(["P", "{x} & {{y}}", ""]))
def test_render_matches_str_format(spark, tpls, rows_, product):
    df = spark.createDataFrame([tuple(r[v] for v in VARS) for r in rows_],
                               ", ".join(f"{v} string" for v in VARS))
    for tpl in tpls:
        got = [r[0] for r in df.select(render_prompt(tpl, product, df.columns)).collect()]
        want = [tpl.format(product_description=product,
                           **{v: _py_value(r[v]) for v in VARS}) for r in rows_]
        assert sorted(got) == sorted(want)


def _py_brief(name, title, desc):
    name = name or ""
    if desc:
        return f"{name}: {' '.join(desc.split())[:200]}"
    if title:
        return f"{name} - {title}"
    return name


words = st.lists(st.sampled_from(["a", "bb", " ", "  ", "\t", "é", "x" * 30]), max_size=20).map("".join)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), words), words, words), min_size=20, max_size=20))
def test_brief_matches_python_model(spark, triples):
    df = spark.createDataFrame(triples, "n string, t string, d string")
    got = [r[0] for r in df.select(brief("n", "t", "d")).collect()]
    assert got == [_py_brief(*t) for t in triples]


hrefs = st.lists(st.sampled_from(["/", "//", "http", "https://", "fb.com/", "x", "s"]),
                 min_size=1, max_size=5).map("".join)


@settings(max_examples=2, deadline=None)
@given(st.lists(hrefs, min_size=20, max_size=20))
def test_scheme_rules_match_python(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "h string")
    got = df.select(link_with_scheme("h").alias("a"), with_scheme("h").alias("b")).collect()
    assert [r["a"] for r in got] == [v if v.startswith("http") else "https://" + v.lstrip("/")
                                    for v in vals]
    assert [r["b"] for r in got] == [v if v.startswith("http") else "https://" + v for v in vals]


def test_append_is_idempotent_for_non_blank_urls(spark):
    existing = fx.fixture(spark, SF_SMALL, fx.F_APPEND_EXISTING)
    new = fx.fixture(spark, SF_SMALL, fx.F_APPEND_NEW).where(F.trim("maps_url") != "")
    once = append_new(existing, new)
    twice = append_new(once, new)
    assert twice.count() == once.count()


def test_every_enrichment_stage_preserves_rows(spark):
    leads = fx.fixture(spark, SF_SMALL, fx.F_LEADS)
    places = fx.fixture(spark, SF_SMALL, fx.F_PLACES)
    pages = fx.fixture(spark, SF_SMALL, fx.F_HTML)
    n = leads.count()
    ids = sorted(r[0] for r in leads.select("row_id").collect())
    for out in (enrich_leads(leads, places), enrich_reviews(leads, places),
                enrich_web(leads, pages, mode="batch"), enrich_web(leads, pages, mode="interactive"),
                generate(leads, lambda s: list(s), "{company_name}")):
        assert out.count() == n
        assert sorted(r[0] for r in out.select("row_id").collect()) == ids
