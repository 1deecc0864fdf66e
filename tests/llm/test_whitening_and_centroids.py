"""Whitening against a floating eigensolver and exact fractions; clustering against plain Lloyd rounds."""

import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from canvass.llm.centroids import cluster
from canvass.llm.registry import QUERIES
from canvass.llm.whitening import above, characteristic, exact_products, greatest_roots, polynomials, primes_over, whiten

SF = "/root/testdata/sf0.001"


# ---- whitening: its parts ----

def determinant(m):
    total = 0
    for p in permutations(range(len(m))):
        sign = (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        total += sign * math.prod(m[i][p[i]] for i in range(len(p)))
    return total


def scatter(r, d, n, size=50):
    x = [[r.randrange(-size, size) for _ in range(d)] for _ in range(n)]
    return [[sum(v[i] * v[j] for v in x) for j in range(d)] for i in range(d)]


def test_characteristic_polynomial_by_determinants(spark):
    r = random.Random(1)
    for d in (1, 2, 3, 5):
        a = scatter(r, d, d + 2)
        poly = characteristic(spark, a)
        for x in range(-3, d + 2):
            assert sum(c * x ** i for i, c in enumerate(poly)) == determinant(
                [[(x if i == j else 0) - a[i][j] for j in range(d)] for i in range(d)])


def test_polynomials_meet_zero_pivots():
    # A zero below the diagonal needs a row swap; a zero column needs none.
    for a in ([[1, 0, 2], [0, 3, 0], [2, 0, 5]], [[2, 0, 0], [0, 2, 0], [0, 0, 2]], [[0] * 4 for _ in range(4)],
              [[5, 0, 0, 1], [0, 5, 1, 0], [0, 1, 5, 0], [1, 0, 0, 5]]):
        p = primes_over(10 ** 12)
        got = polynomials(a, p)
        for q, c in zip(p, got.tolist()):
            for x in (1, 2, 7):
                d = len(a)
                want = determinant([[(x if i == j else 0) - a[i][j] for j in range(d)] for i in range(d)])
                assert (sum(k * x ** i for i, k in enumerate(c)) - want) % q == 0


def test_roots_with_multiplicity():
    roots = [0, 0, 3, 8, 8, 8, 21, 1000, 1000]
    poly = [1]
    for z in roots:
        poly = [(poly[i - 1] if i else 0) - z * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for c in range(-2, 1003):
        if c <= 25 or c > 995:
            assert above(poly, c) == sum(z > c for z in roots)
    assert greatest_roots(poly, 3000, 5) == [999, 999, 20, 7, 7]
    assert greatest_roots(poly, 3000, 99) == [z - 1 for z in sorted(roots, reverse=True) if z]


def test_close_roots_are_isolated():
    roots = [10 ** 40, 10 ** 40 + 3, 10 ** 39]
    poly = [1]
    for z in roots:
        poly = [(poly[i - 1] if i else 0) - z * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert greatest_roots(poly, 10 ** 41, 3) == [10 ** 40 + 2, 10 ** 40 - 1, 10 ** 39 - 1]


def test_products_stay_exact():
    r = np.random.default_rng(1)
    for top in (100, 1 << 18, 1 << 40):
        x = r.integers(-top, top, (700, 3))
        o = x.astype(object)
        assert (exact_products(x) == o.T @ o).all()


# ---- whitening: the operator ----

def run(spark, vectors, **kw):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, component string, n string").repartition(3)
    return whiten(df, **kw).collect()


def expected(vectors, scale=256):
    x = {}
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, *_ in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(v + [0] * (width - len(v)))) for i, v in kept]
    return kept, sorted({v for _, v in kept}), width


def check(rows, vectors, count=4, scale=256):
    kept, fit, d = expected(vectors, scale)
    n, s = len(fit), [sum(v[i] for v in fit) for i in range(d)]
    cov = [[sum(Fraction(n * v[i] - s[i], n) * Fraction(n * v[j] - s[j], n) for v in fit) / n for j in range(d)] for i in range(d)]
    e, _ = np.linalg.eigh(np.array(cov, float))
    e = e[::-1]
    k = min(count, int(sum(v > 1e-9 * e[0] for v in e)))
    assert len(rows) == k * len(kept)
    dev = sorted((str(i), sum((n * c - t) ** 2 for c, t in zip(v, s))) for i, v in kept)
    for c in range(1, k + 1):
        mine = [r for r in rows if r.component == c]
        assert sorted((str(r.vec_id), r.deviation) for r in mine) == dev
        assert all(r.n == n and abs(r.explained - e[c - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9 for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r.whitened
    x = np.array([v for _, v in kept], float) - np.array(s, float) / n
    w = np.array([[by[i][c] for c in range(1, k + 1)] for i, _ in kept])
    # The least-squares map from x to whitened is component / sqrt(e): orthogonal eigenvectors of the covariance.
    first = {v: j for j, (_, v) in reversed(list(enumerate(kept)))}
    f = [first[v] for v in fit]
    assert np.allclose(w[f].T @ w[f] / n, np.eye(k), atol=1e-9)
    back = w[f].T @ x[f] / n  # rows: sqrt(e) * component
    assert np.allclose(back @ back.T, np.diag(e[:k]), rtol=1e-9, atol=1e-6 * e[0])
    assert np.allclose(back @ np.array(cov, float), e[:k, None] * back, rtol=1e-8, atol=1e-8 * e[0] ** 1.5)


def gaussians(seed, n, d):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 0.2) * (1 + j % 3) for j in range(d)], "c", "n") for i in range(n)]


def test_whitening_against_a_floating_solver(spark):
    rows = gaussians(1, 300, 9)
    rows += [(1000 + i, rows[5][1], "c", "n") for i in range(200)]  # copies count once in the fit
    rows += [(2000, None, "c", "n"), (2001, [1.0, None] + [0.0] * 7, "c", "n"), (2002, [float("nan")] * 9, "c", "n"),
             (2003, [float("-inf")] * 9, "c", "n"), (2004, [0.5], "c", "n"), (None, rows[6][1], "c", "n")]
    check(run(spark, rows), rows)


def test_rows_of_one_id_are_all_kept(spark):
    rows = [(7, [float(i), float(i % 3)], "c", "n") for i in range(9)] + [(7, [0.0, 0.0], "c", "n")]
    got = run(spark, rows)
    assert len(got) == 20 and {r.n for r in got} == {9} and {r.vec_id for r in got} == {7}


def test_repeated_eigenvalues(spark):
    # The corners of a cross: every direction has the same variance.
    rows = [(2 * i + s, [float((1, -1)[s]) if j == i else 0.0 for j in range(6)], "c", "n") for i in range(6) for s in range(2)]
    check(run(spark, rows), rows)


def test_few_dimensions_and_no_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0], "c", "n") for i in range(5)]
    got = run(spark, rows)
    assert {r.component for r in got} == {1} and all(r.explained == 1.0 for r in got)
    check(got, rows)
    assert run(spark, [(1, [1.0, 2.0], "c", "n"), (2, [1.0, 2.0], "c", "n")]) == []
    assert run(spark, [(1, [], "c", "n")]) == run(spark, [(1, None, "c", "n")]) == run(spark, []) == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float((-1) ** i * (1 + i) * 2.0 ** 24), float(i % 3)], "c", "n") for i in range(12)]
    got = run(spark, rows)
    assert {r.deviation for r in got} == {None} and all(r.identity_error < 1e-9 for r in got)


def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    x = {i: np.floor(256 * np.array(v, np.float64)) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(rows)
    for c in range(4):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        want = {i: (a - fit.mean(0)) @ v[:, c] / np.sqrt(e[c]) for i, a in x.items()}
        sign = np.sign(sum(mine[i] * want[i] for i in mine))
        assert all(abs(mine[i] - sign * want[i]) < 1e-9 for i in mine)


# ---- clustering ----

def lloyd(vectors, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, *_ in vectors
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, b) in zip(kept, best) if b == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    best = assign()
    within = [sum(d for d, b in best if b == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, b, d, within[b], sum(within), sha[b]) for (i, _), (d, b) in zip(kept, best)), key=repr)


COLS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(spark, vectors, **kw):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, cluster string, x string").repartition(3)
    return sorted((tuple(r[c] for c in COLS) for r in cluster(df, **kw).collect()), key=repr)


def test_clusters_by_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(i % 4, 0.4))) for _ in range(5)], "c", "x") for i in range(200)]
    rows += [(500 + i, rows[3][1], "c", "x") for i in range(90)]  # copies
    rows += [(3, rows[9][1], "c", "x"), (None, rows[10][1], "c", "x"), (600, None, "c", "x"), (601, [1.0] * 4, "c", "x"),
             (602, [None] * 5, "c", "x"), (603, [float("nan")] * 5, "c", "x"), (604, [float("inf")] * 5, "c", "x"), (605, [], "c", "x")]
    for rounds in (0, 1, 10):
        assert clustered(spark, rows, width=5, rounds=rounds) == lloyd(rows, 8, rounds, 5, 1024)


def test_ties_go_to_the_smaller_cluster(spark):
    rows = [(i, [float(i % 2), 0.0], "c", "x") for i in range(30)]  # seeds repeat: the later ones stay empty
    got = clustered(spark, rows, width=2)
    assert got == lloyd(rows, 8, 10, 2, 1024) and len({g[1] for g in got}) == 2


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0], "c", "x"), (2, [3.0, 4.0], "c", "x"), (3, None, "c", "x")]
    assert clustered(spark, rows, width=2) == lloyd(rows, 8, 10, 2, 1024)
    assert clustered(spark, rows) == clustered(spark, []) == []


def test_components_too_large_raise(spark):
    with pytest.raises(ValueError, match="after scaling"):
        clustered(spark, [(1, [1e30, 0.0], "c", "x")], width=2)


def test_no_python_on_rows(spark):
    plan = QUERIES["op13_centroids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
