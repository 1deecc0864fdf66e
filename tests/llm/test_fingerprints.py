"""Prefix hashes and fingerprints against plain string comparison; the query against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from canvass.llm.fingerprint import (MOD, ROOTS, Batch, PrefixHashes, edited, fingerprints, likeness, likeness_of, steps,
                                     with_next)
from canvass.llm.registry import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def codes(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def print_of(text):
    return Batch([text]).fingerprints()[0]


def test_span_hashes_are_the_polynomial():
    r = random.Random(1)
    text = "".join(r.choice("ab\U0001F600é") for _ in range(300))
    h = PrefixHashes(codes(text))
    for _ in range(200):
        s = r.randrange(300)
        e = r.randrange(s, 301)
        for w, root in enumerate(ROOTS):
            want = sum((ord(c) + 1) * pow(root, i, MOD) for i, c in enumerate(text[s:e])) % MOD
            assert int(h.span(np.array([s]), np.array([e]), w)[0]) == want


def test_equality_and_extension_by_brute_force():
    r = random.Random(2)
    text = "".join(r.choice("ab") for _ in range(400)) * 2
    h = PrefixHashes(codes(text))
    a = np.array([r.randrange(800) for _ in range(500)])
    b = np.array([r.randrange(800) for _ in range(500)])
    most = 800 - np.maximum(a, b)

    def common(i, j):
        n = 0
        while max(i, j) + n < 800 and text[i + n] == text[j + n]:
            n += 1
        return n

    want = [common(i, j) for i, j in zip(a, b)]
    assert h.extension(a, b, most).tolist() == want
    n = np.array([r.randrange(m + 1) for m in most])
    assert h.equal(a, b, n).tolist() == [text[i:i + k] == text[j:j + k] for i, j, k in zip(a, b, n)]


def test_fingerprint_does_not_depend_on_its_batch():
    texts = ["", "a", "", "abc" * 50, "x" * 11, "y" * 12, "", "word " * 700, "z" * 13, ""]
    assert Batch(texts).fingerprints() == [print_of(t) for t in texts]
    assert len({print_of(t) for t in texts}) == len(set(texts))


def test_likeness():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    for n in (1, 2, 5, 12, 40, 300, 3000):
        text, other = (" ".join(r.choice(words) for _ in range(n)) for _ in range(2))
        a, b, c = print_of(text), print_of(other), print_of(edited(text, other))
        assert likeness(a, a) == 1.0 and 0 <= likeness(a, b) < 0.5 and likeness(a, b) == likeness(b, a)
        if len(text) >= 3:
            assert 0.5 <= likeness(a, c) < 1.0
    long = " ".join(r.choice(words) for _ in range(2000))
    assert likeness(print_of(long), print_of(long[:5000] + "#" + long[5000:])) > 0.9
    assert likeness(print_of(long), print_of(long[5000:] + long[:5000])) > 0.9  # moved parts are still common
    assert likeness(print_of(""), print_of("")) == 1.0 and likeness(print_of(""), a) == 0.0
    assert likeness(None, a) is None


def test_marks_grow_with_the_logarithm():
    assert steps(0) == [] and steps(3) == [1, 2, 3] and len(steps(10 ** 6)) < 80


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        new = edited(text, nxt)
        a, b, c = print_of(text), print_of(new), print_of(nxt)
        same = next((k for k, (x, y) in enumerate(zip(text, nxt)) if x != y), min(len(text), len(nxt)))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c), same))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next")


def run(df):
    return sorted((tuple(r[c] for c in COLS) for r in with_next(df).collect()), key=repr)


def test_next_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab cé\U0001F600") for _ in range(r.choice((0, 1, 2, 3, 30, 400))))) for i in range(0, 900, 3)]
    rows += [(1000, None), (1003, ""), (None, "no id"), (2000, "long " * 300_000), (-5, "negative")]
    rows += [(7777, "copy of a row")] * 200  # equal rows follow each other in any order
    df = spark.createDataFrame([(i, t, "s", 9) for i, t in rows], "doc_id long, text string, part string, n_chars int")
    assert run(df.repartition(5)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(1, None)], [(2, "two"), (1, "one")]])
def test_few_rows(spark, rows):
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rows_of_one_id_are_all_kept(spark):
    rows = [(1, f"text {i}") for i in range(50)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(g[3] for g in got) == sorted(print_of(t) for _, t in rows)


def test_fingerprints_pass_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "old", 5), (2, None, "old", 5)], "id int, body string, fingerprint string, n int")
    got = fingerprints(df, "body")
    assert got.columns == ["id", "body", "n", "n_chars", "fingerprint"]
    assert {r.id: (r.n_chars, r.fingerprint) for r in got.collect()} == {1: (3, print_of("a b")), 2: (0, print_of(""))}
    both = got.crossJoin(got.select(F.col("fingerprint").alias("other"))).select(likeness_of(F.col("fingerprint"), F.col("other")).alias("x"))
    assert sorted(r.x for r in both.collect()) == [0.0, 0.0, 1.0, 1.0]


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    df = QUERIES["op11_fingerprints"](spark, SF)
    assert sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr) == brute(rows)
