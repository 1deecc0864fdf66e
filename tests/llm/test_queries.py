"""The registered queries: SQL side by side, schemas, plans, and whole-table checks without SQL."""

import hashlib
import html
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from canvass.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES) and all(entry.oracle_sql()[n] == ORACLE[n] for n in ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert canon(tuple(r[c] for c in cols) for r in df.collect()) == canon(rel.select(*cols).fetchall())


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_query(spark, duck):
    before = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    found = re.compile(r"[\w.+-]+@[\w.-]+\.com|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b")
    df = QUERIES["op1_surrogates"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    seen = {}
    for r in df.collect():
        old, new = found.findall(before[r.doc_id]), found.findall(r.text)
        # Sixteen digits that fail the check digit are a number, not a card.
        plain = [x for x in old if re.fullmatch(r"\d{16}", x) and not luhn(x)]
        assert len(old) == len(new) and set(old) & set(new) == set(plain)
        old, new = [x for x in old if x not in plain], [x for x in new if x not in plain]
        assert r.text == before[r.doc_id] or r.n_entities > 0
        assert found.sub("", r.text) == found.sub("", before[r.doc_id]) or r.n_entities > len(old)
        assert all(luhn(x) for x in new if re.fullmatch(r"\d{16}", x))
        for a, b in zip(old, new):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_language_query(spark, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    df = QUERIES["op9_language_id"](spark, SF)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = df.collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.9


def test_page_query(spark, duck):
    want = {}
    for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall():
        inner = re.sub(r"</?(?:p|h1|br)[^>]*>", "\0", re.search(r"<article>(.*)</article>", h, re.S)[1])
        parts = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", inner).split("\0"))
        want[i] = "\n".join(x for x in parts if x)
    rows = QUERIES["op7_main_html"](spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_language_model_query_beats_the_base_on_held_out_text(spark):
    rows = QUERIES["op5_hidden_markov"](spark, SF).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_mix_query(spark, duck):
    docs = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    taken, target = {}, {}
    for r in QUERIES["op2_mix_sources"](spark, SF).collect():
        s = docs[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 2 + 0.001 * target[s] for s in target)


def test_digest_matches_kept_words(spark):
    df = QUERIES["op8_substring_dedup"](spark, SF).where("n_words = 0")
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in df.collect())
