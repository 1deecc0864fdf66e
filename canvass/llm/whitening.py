"""Operator 12: embedding whitening over an exact characteristic polynomial.

Components become integers x = floor(``scale`` * c).  The fit list is each
distinct x once: n vectors with sums S and products G = sum of x x^T, added up
exactly.  A = n * G - S S^T is the integer scatter, n^2 times the covariance.

1. Polynomial: A modulo each of enough 31-bit primes is brought to Hessenberg
   form and its characteristic polynomial read off by recurrence; Chinese
   remaindering gives the integer coefficients, one prime more checks them.
2. Roots: A is symmetric and positive semidefinite, so all roots are real.  Then
   the sign changes of p(x + c) count the roots above c exactly (Descartes'
   rule is sharp), which isolates the greatest roots with their
   multiplicities; a root alone in its interval is refined by the sign of p.
   Roots are scaled to 256 bits.
3. Components: inverse iteration on A - root with 100 decimal digits gives the
   null vector; equal roots get as many orthonormal vectors of their null space.

Defined cases: vectors that are null or hold null, NaN or infinite components
are dropped; shorter vectors count as padded with zeros to the longest; rows of
one id are kept one by one; equal vectors count once in the fit; a component of
eigenvalue 0 is left out (whitening it is undefined), so fewer than
``components`` may come, none for a single distinct vector or an empty table; a
deviation beyond a long is null; other columns are not carried.

Scale: one shuffle of the distinct vectors (equal ones meet map-side), then the
products are added in blocks inside tasks and by cell of the matrix between
them: width^2 / 2 rows a task.  The polynomial is a Spark job over primes; the
driver holds matrices and polynomials of the vector's width, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage, whole_vector

EXACT, LONG = 1 << 53, 1 << 63
ROOT_BITS, DIGITS = 256, 100
PRIMES_A_TASK = 64


# ---- exact sums of the fit list ----

def matrix(column, width: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x^T x as Python integers: in doubles while every sum stays below 2^53."""
    most = int(np.abs(x).max(initial=0)) if len(x) else 0
    if most * most * max(len(x), 1) < EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(x) > 256 or most < 1 << 20:
        half = max(1, len(x) // 2)
        if half < len(x):
            return exact_products(x[:half]) + exact_products(x[half:])
    o = x.astype(object)
    return o.T @ o


def sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and G of the fit list, added in tasks and then by cell."""
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    rows, cols = np.array(upper).T

    def add(batches) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(lo, 4096), width)
                n += len(x)
                s = s + np.array([int(v) for v in x.astype(object).sum(axis=0)], object)
                g = g + exact_products(x)
        if n:
            values = [n, *s, *g[rows, cols]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()),
                                              pa.array([str(v) for v in values])], names=["cell", "value"])

    cells = (fit.mapInArrow(add, "cell int, value string").groupBy("cell")
             .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    found = {r.cell: int(r.value) for r in cells}
    g = [[0] * width for _ in range(width)]
    for at, (i, j) in enumerate(upper):
        g[i][j] = g[j][i] = found[1 + width + at]
    return found[0], [found[1 + i] for i in range(width)], g


# ---- 1. characteristic polynomial ----

def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.2 * 10^9."""
    if n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1) or a % n == 0:
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """31-bit primes from above whose product passes ``bound``, and one more."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    while not is_prime(n):
        n -= 2
    return out + [n]


def inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p - 2) mod p, elementwise; 0 for 0."""
    out, base, e = np.ones_like(a), a % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base = base * base % p
        e = e >> 1
    return np.where(a % p == 0, 0, out)


def polynomials(a: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - a) modulo each prime, rising powers, by Hessenberg form; all primes side by side."""
    d, k = len(a), len(primes)
    p = np.array(primes, np.int64)
    whole = np.array(a, object)
    h = np.array([(whole % q).astype(np.int64) for q in primes]).reshape(k, d, d)
    p1, p2, each = p[:, None], p[:, None, None], np.arange(k)
    for m in range(d - 2):
        pivot = (h[:, m + 1:, m] != 0).argmax(axis=1) + m + 1
        row = h[each, pivot].copy()
        h[each, pivot], h[:, m + 1] = h[:, m + 1].copy(), row
        col = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, m + 1] = h[:, :, m + 1].copy(), col
        u = h[:, m + 2:, m] * inverse(h[:, m + 1, m], p)[:, None] % p1
        h[:, m + 2:] = (h[:, m + 2:] - u[:, :, None] * h[:, m + 1][:, None, :] % p2) % p2
        h[:, :, m + 1] = (h[:, :, m + 1] + (h[:, :, m + 2:] * u[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((d + 1, k, d + 1), np.int64)
    poly[0, :, 0] = 1
    for m in range(1, d + 1):
        cur = np.zeros((k, d + 1), np.int64)
        cur[:, 1:] = poly[m - 1, :, :-1]
        cur = (cur - h[:, m - 1, m - 1][:, None] * poly[m - 1] % p1) % p1
        below = np.ones(k, np.int64)
        for i in range(1, m):
            below = below * h[:, m - i, m - i - 1] % p
            cur = (cur - (h[:, m - i - 1, m - 1] * below % p)[:, None] * poly[m - i - 1] % p1) % p1
        poly[m] = cur
    return poly[d]


def characteristic(spark, a: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x - a), rising powers, for a positive semidefinite ``a``."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    # Sums of products of k eigenvalues are at most C(d, k) (trace / d)^k.
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_over(2 * bound)
    ship()

    def run(batches):
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for lo in range(0, len(mine), PRIMES_A_TASK):
                some = mine[lo:lo + PRIMES_A_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()),
                                                  pa.array(polynomials(a, some).tolist(), pa.list_(pa.int64()))],
                                                 names=["p", "c"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    listed = spark.createDataFrame([(q,) for q in primes], "p long").repartition(tasks)
    rest = {r.p: list(r.c) for r in listed.mapInArrow(run, "p long, c array<long>").collect()}
    product, check = 1, primes[-1]
    for q in primes[:-1]:
        product *= q
    parts = [(q, product // q, pow(product // q, -1, q)) for q in primes[:-1]]
    out = []
    for i in range(d + 1):
        c = sum(rest[q][i] * inv % q * m for q, m, inv in parts) % product
        out.append(c - product if 2 * c > product else c)
        if (out[-1] - rest[check][i]) % check:
            raise ArithmeticError("the check prime disagrees with the remaindered polynomial")
    return out


# ---- 2. roots ----

def above(poly: list[int], c: int) -> int:
    """Number of roots greater than ``c``, multiplicities counted, of a polynomial with real roots only."""
    q = poly[::-1]
    for end in range(len(q), 1, -1):
        for i in range(1, end):
            q[i] += c * q[i - 1]
    signs = [v > 0 for v in q if v]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def value(poly: list[int], c: int) -> int:
    out = 0
    for v in reversed(poly):
        out = out * c + v
    return out


def greatest_roots(poly: list[int], top: int, count: int) -> list[int]:
    """The integers r with a root in (r, r + 1], one for each of the greatest positive roots; ``top`` is no less than all."""
    out = []
    for k in range(1, min(count, above(poly, 0)) + 1):
        low, high, n_low, n_high = 0, top, above(poly, 0), 0  # n_low >= k > n_high
        while high - low > 1 and n_low - n_high > 1:
            mid = (low + high) // 2
            n = above(poly, mid)
            low, high, n_low, n_high = (mid, high, n, n_high) if n >= k else (low, mid, n_low, n)
        if high - low > 1:  # one root in (low, high]: p changes its sign there only
            sign = 1 if n_high % 2 == 0 else -1  # of p right of the root
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if value(poly, mid) * sign >= 0 else (mid, high)
        out.append(low)
    return out


# ---- 3. components ----

def eliminate(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors with row pivots of a matrix of Decimals; a vanishing pivot becomes a tiny one."""
    a, order, d = a.copy(), [], len(a)
    tiny = max((abs(v) for v in a.flat), default=Decimal(1)) * Decimal(10) ** (5 - DIGITS)
    for m in range(d):
        at = m + max(range(d - m), key=lambda i: abs(a[m + i, m]))
        a[[m, at]] = a[[at, m]]
        order.append(at)
        if abs(a[m, m]) < tiny:
            a[m, m] = tiny
        if m + 1 < d:
            a[m + 1:, m] = a[m + 1:, m] / a[m, m]
            a[m + 1:, m + 1:] = a[m + 1:, m + 1:] - np.outer(a[m + 1:, m], a[m, m + 1:])
    return a, order


def solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b.copy()
    for m, at in enumerate(order):
        x[[m, at]] = x[[at, m]]
    # Earlier rows of L were swapped along with the matrix, so all swaps come first.
    for m in range(len(x)):
        x[m] = x[m] - (lu[m, :m] @ x[:m] if m else 0)
    for m in reversed(range(len(x))):
        x[m] = (x[m] - (lu[m, m + 1:] @ x[m + 1:] if m + 1 < len(x) else 0)) / lu[m, m]
    return x


def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - o * (v @ o)
        v = v / (v @ v).sqrt()
    return v


def components(a: list[list[int]], roots: list[int], shift: int) -> list[list[float]]:
    """Unit eigenvectors of ``a`` for its roots (scaled by 2^shift), those of equal roots orthogonal."""
    d, out, group = len(a), [], []
    with localcontext(Context(prec=DIGITS, Emax=10 ** 9, Emin=-10 ** 9)):
        whole = np.array([[Decimal(v) for v in row] for row in a], object).reshape(d, d)
        for k, root in enumerate(roots):
            if k == 0 or roots[k - 1] - root > 1:
                group = []
                shifted = whole.copy()
                at = Decimal(2 * root + 1) / Decimal(2) / Decimal(2 ** shift)
                for i in range(d):
                    shifted[i, i] = shifted[i, i] - at
                lu, order = eliminate(shifted)
            # A start that no eigenvector is orthogonal to by chance: powers of a multiplier modulo a prime.
            v = np.array([Decimal(pow(48271 + k, i + 1, (1 << 31) - 1) - (1 << 30)) for i in range(d)], object)
            for _ in range(3):
                v = unit(solve(lu, order, unit(v, group)), group)
            group.append(v)
            most = max(range(d), key=lambda i: abs(v[i]))
            out.append([float(c) if v[most] > 0 else -float(c) for c in v])
    return out


# ---- the operator ----

@dataclass
class Whitening:
    n: int
    sums: list[int]
    width: int
    eigenvalues: list[Fraction]
    trace: Fraction
    components: list[list[float]]


def integers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the whole vectors, padded to the longest, and that length."""
    x = F.col(vector)
    rows = (vectors.where(whole_vector(x))
            .select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("x")))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat(F.col("x"), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    return rows.withColumn("x", padded), width


def fit(spark, listed: DataFrame, width: int, count: int) -> Whitening:
    """The whitening of a list of distinct integer vectors."""
    n, s, g = sums(listed, width)
    a = [[n * g[i][j] - s[i] * s[j] for j in range(width)] for i in range(width)]
    trace = sum(a[i][i] for i in range(width))
    if not trace:
        return Whitening(n, s, width, [], Fraction(0), [])
    poly = characteristic(spark, a)
    shift = max(8, ROOT_BITS - trace.bit_length())
    scaled = [c << shift * (width - i) for i, c in enumerate(poly)]
    roots = greatest_roots(scaled, trace << shift, count)
    values = [Fraction(2 * r + 1, 2 << shift) / n ** 2 for r in roots]
    return Whitening(n, s, width, values, Fraction(trace, n ** 2), components(a, roots, shift))


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Whitened values and exact deviations of integer vectors."""
    most = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    if model.width * most * most < LONG:
        centred = model.n * x - np.array(model.sums, np.int64)
        deviation = (centred * centred).sum(axis=1).tolist()
    else:
        centred = model.n * x.astype(object) - np.array(model.sums, object)
        deviation = [int(v) if v < LONG else None for v in (centred * centred).sum(axis=1)]
    scales = np.array([float(e) ** -0.5 for e in model.eigenvalues])
    return (centred / model.n).astype(np.float64) @ np.array(model.components).T * scales, deviation


def whiten(vectors: DataFrame, count: int = 4, scale: int = 256, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row per vector and component."""
    ship()
    spark = vectors.sparkSession
    rows, width = integers(vectors, vec_id, vector, scale)
    schema = (f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    if not width:
        return spark.createDataFrame([], schema)
    listed = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    model = fit(spark, listed, width, count)
    if not model.components:
        return spark.createDataFrame([], schema)
    k = len(model.components)

    def values(batches):
        for batch in batches:
            w, _ = project(matrix(batch.column(0), width), model)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    # The covariance of what the fit list is turned into: means first, then centred products.
    made = stage(listed.mapInArrow(values, ", ".join(f"w{i} double" for i in range(k))), "whitening-check")
    mean = made.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = made.agg(*[F.sum((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])) for i, j in pairs]).first()
    error = max(abs(m / model.n - (i == j)) for m, (i, j) in zip(moments, pairs))
    explained = [float(e / model.trace) for e in model.eigenvalues]

    def out(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w, deviation = project(matrix(batch.column(1), width), model)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array([model.n] * (n * k), pa.int64()),
                 pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(w.reshape(-1)),
                 pa.array(explained * n), pa.array([error] * (n * k))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
