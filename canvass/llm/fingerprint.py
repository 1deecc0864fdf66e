"""Operator 11: document fingerprints from prefix polynomial hashes.

A text is an array of code points c[0..n).  The prefix array of a base B is
P[i] = sum of (c[j] + 1) * B^j for j < i, terms modulo 2^31 - 1.  It answers
the hash of any span, (P[e] - P[s]) * B^-s, whatever place the span stands at,
so any two spans of equal length compare in constant time, and the longest
common extension of two places is found by binary search over its length.
Two bases give 62 bits a span.

A fingerprint is a string cut from these arrays, of size O(log n):

* the text's length and the hash of the whole span;
* 64 samples of the hashes of all spans of ``WIDTH`` code points: the least
  hash of each of 64 classes (a shorter text is one span);
* the hashes of the first and of the last g code points for g = 1 .. 16 and on
  in steps of a third, two bytes each.

``likeness`` compares two fingerprints: 1 if they are equal, else the greater
of two shares: twice the common part of the sampled spans over both texts'
parts (Dice), and the longest common start and end, each found by binary search
over the steps, over the longer text.  Texts that differ stay below 1.

Defined cases: a null text counts as empty; the empty text is like itself only;
equal texts have equal fingerprints; other columns pass, and a column of the
input that is named like a result gives way to it.  Texts are used whole: a
batch holds about a million code points, a longer text stands alone.

Scale: fingerprints are made in the scan, without a shuffle.  ``with_next``
pairs every document with the next by falling id: one range shuffle of the
texts, split also inside ids and equal rows, then one pass in order; only the
last document of each partition meets the first of the next one in a join.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _mix, byte_slices, ship, stage

MOD = (1 << 31) - 1
ROOTS = (1_103_515_245, 1_664_525_013)
WIDTH, SAMPLES = 12, 64
BATCH = 1 << 20


def fold(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x < 2^62, in place."""
    m, s = np.uint64(MOD), np.uint64(31)
    for _ in range(2):
        high = x >> s
        x &= m
        x += high
    x[x >= m] -= m
    return x


_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^i mod 2^31 - 1 for i < n, by doubling."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < max(n, 1 << 16):
            step = np.uint64(pow(base, len(have), MOD))
            have = np.concatenate([have, fold(have * step)])
        _TABLES[base] = have
    return have[:n]


class PrefixHashes:
    """Prefix arrays over an array of code points; spans are [start, end)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        shifted = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for root in ROOTS:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(fold(shifted * powers(root, self.n)), out=sums[1:])  # below 2^62 up to 2^31 places
            self.sums.append(sums)

    def span(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        back = powers(pow(ROOTS[which], -1, MOD), self.n + 1)
        return fold(fold(sums[end] - sums[start]) * back[start])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` at ``a`` and at ``b`` are equal."""
        same = np.ones(len(a), bool)
        for which in range(len(ROOTS)):
            same &= self.span(a, a + length, which) == self.span(b, b + length, which)
        return same

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Greatest common extension of the places ``a`` and ``b``, up to ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low


def steps(n: int) -> list[int]:
    """Lengths of the starts and ends that a text of n code points is marked at."""
    out, g = [], 1
    while g <= n:
        out.append(g)
        g = g + 1 if g < 16 else g + g // 3
    return out


class Batch:
    """Texts side by side with one pair of prefix arrays."""

    def __init__(self, texts: list[str]):
        self.hashes = PrefixHashes(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def samples(self) -> np.ndarray:
        """(texts, SAMPLES) of 16 bits, 0 where no span falls into the class."""
        k = len(self.length)
        none = np.uint64(2 ** 64 - 1)
        least = np.full(k * SAMPLES, none)
        spans = np.where(self.length >= WIDTH, self.length - WIDTH + 1, np.minimum(self.length, 1))
        total, before = int(spans.sum()), np.cumsum(spans) - spans
        for lo in range(0, total, BATCH):
            no = np.arange(lo, min(lo + BATCH, total))
            text = np.searchsorted(before, no, side="right") - 1
            # Texts without a span share their start with the next one; searchsorted takes the last of them.
            at = self.start[text] + no - before[text]
            h = _mix(self.hashes.span(at, at + np.minimum(self.length[text], WIDTH)) + np.uint64(1))
            np.minimum.at(least, text * SAMPLES + (h >> np.uint64(58)).astype(np.int64), h)
        least = least.reshape(k, SAMPLES)
        return np.where(least == none, 0, least % np.uint64(65535) + np.uint64(1)).astype(">u2")

    def marks(self) -> list[bytes]:
        """Two bytes for each marked start, then for each marked end, of every text."""
        grids = [steps(n) for n in self.length.tolist()]
        count = np.array([len(g) for g in grids], np.int64)
        g = np.array([x for grid in grids for x in grid], np.int64)
        first, last = np.repeat(self.start, count), np.repeat(self.start + self.length, count)
        both = []
        for s, e in ((first, first + g), (last - g, last)):
            h = _mix(self.hashes.span(s, e) + (self.hashes.span(s, e, 1) << np.uint64(32)))
            both.append(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :2].tobytes())
        ends = (2 * np.cumsum(count)).tolist()
        return [both[0][e - 2 * c:e] + both[1][e - 2 * c:e] for e, c in zip(ends, count.tolist())]

    def fingerprints(self) -> list[str]:
        end = self.start + self.length
        whole = [self.hashes.span(self.start, end, w).astype(">u4").tobytes() for w in range(2)]
        sampled = self.samples()
        return [base64.b64encode(int(n).to_bytes(8, "big") + whole[0][4 * i:4 * i + 4] + whole[1][4 * i:4 * i + 4]
                                 + sampled[i].tobytes() + mark).decode()
                for i, (n, mark) in enumerate(zip(self.length, self.marks()))]


def _common(a: bytes, b: bytes, count: int) -> int:
    """How many leading two-byte marks agree: agreement ends once for all, so binary search finds it."""
    low, high = 0, count
    while low < high:
        mid = (low + high + 1) // 2
        if a[2 * mid - 2:2 * mid] == b[2 * mid - 2:2 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two fingerprints, 0 to 1; null if one is missing."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    x, y = base64.b64decode(a), base64.b64decode(b)
    n, m = int.from_bytes(x[:8], "big"), int.from_bytes(y[:8], "big")
    if not n or not m:
        return 0.0
    head = 16 + 2 * SAMPLES
    u, v = np.frombuffer(x[16:head], ">u2"), np.frombuffer(y[16:head], ">u2")
    shared = np.count_nonzero((u == v) & (u > 0)) / np.count_nonzero(u | v)
    grid = steps(min(n, m))
    reach = 0
    for p, q in ((0, 0), ((len(x) - head) // 2, (len(y) - head) // 2)):
        found = _common(x[head + p:], y[head + q:], len(grid))
        reach += grid[found - 1] if found else 0
    most = max(n, m)
    return float(min(max(2 * shared / (1 + shared), min(reach, n, m) / most), most / (most + 1)))


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns."""
    ship()

    @F.pandas_udf("double")
    def compare(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([likeness(s, t) for s, t in zip(p, q)], dtype="float64")

    return compare(a, b)


def _batches(texts: list[str]):
    """Index ranges of texts that are hashed together."""
    return byte_slices(texts, BATCH)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_chars and fingerprint."""
    ship()
    kept = [c for c in docs.columns if c not in ("n_chars", "fingerprint")]
    schema = T.StructType([f for f in docs.schema if f.name in kept]
                          + [T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            prints = [p for lo, hi in _batches(texts) for p in Batch(texts[lo:hi]).fingerprints()]
            rest = [batch.column(docs_columns.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                rest + [pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())],
                names=kept + ["n_chars", "fingerprint"])

    docs_columns = docs.columns
    return docs.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points, or all, of the start of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def compare(texts: list[str], following: list[str]) -> tuple:
    """Digest, both fingerprints, likenesses and common starts of each text, its edited text and the next one."""
    digest, own, other, like, like_next, kept, common = ([] for _ in range(7))
    changed = [edited(t, f) for t, f in zip(texts, following)]
    for lo, hi in byte_slices([t + f for t, f in zip(texts, following)], BATCH // 2):
        a, b, c = texts[lo:hi], changed[lo:hi], following[lo:hi]
        k = hi - lo
        group = Batch(a + b + c)
        prints = group.fingerprints()
        own += prints[:k]
        other += prints[k:2 * k]
        like += [likeness(p, q) for p, q in zip(prints[:k], prints[k:2 * k])]
        like_next += [likeness(p, q) for p, q in zip(prints[:k], prints[2 * k:])]
        first, size = group.start, group.length
        kept += group.hashes.extension(first[:k], first[k:2 * k], np.minimum(size[:k], size[k:2 * k])).tolist()
        common += group.hashes.extension(first[:k], first[2 * k:], np.minimum(size[:k], size[2 * k:])).tolist()
        digest += [hashlib.sha256(t.encode()).hexdigest() for t in b]
    return digest, own, other, like, like_next, kept, common


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, common_edited long, common_next long")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is the one of the next smaller id, after the last the
    first; null ids come last, rows of one id follow each other by the hash
    of their text.  ``common_edited`` and ``common_next`` are the lengths of
    the common start of the text and the edited text or the next document.
    """
    ship()
    kind = docs.schema[doc_id].dataType
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("no")]
    # The row number only splits equal rows over tasks; which of them comes first changes nothing.
    ordered = (docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
               .withColumn("h", F.xxhash64("text")).withColumn("no", F.monotonically_increasing_id())
               .repartitionByRange(*order).sortWithinPartitions(*order)
               .select("doc_id", "text", F.spark_partition_id().alias("part")))
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(RESULT).fields,
                           T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()),
                           T.StructField("text", T.StringType())])
    arrow = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                       ("common_edited", pa.int64()), ("common_next", pa.int64())])

    def table_of(ids, texts, following):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64())]
            + [pa.array(c, f.type) for c, f in zip(compare(texts, following), list(arrow)[1:])],
            names=["doc_id"] + arrow.names)

    def plain(ids, texts, following, part):
        done = table_of(ids, texts, following)
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            done.columns + [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
            names=done.schema.names + ["part", "edge", "text"])

    def edge(ids, value, part, name):
        return pa.RecordBatch.from_arrays(
            [ids] + [pa.nulls(1, f.type) for f in arrow]
            + [pa.array([part], pa.int32()), pa.array([name]), pa.array([value], pa.string())],
            names=["doc_id"] + arrow.names + ["part", "edge", "text"])

    def run(batches):
        held = part = None  # the row whose next row has not been seen
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if held is None:
                part = batch.column(2)[0].as_py()
                yield edge(ids.slice(0, 1), texts[0], part, "first")
            else:
                yield plain(held[0], [held[1]], texts[:1], part)
            if len(texts) > 1:
                yield plain(ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], part)
            held = ids.slice(len(texts) - 1, 1), texts[-1]
        if held is not None:
            yield edge(held[0], held[1], part, "last")

    found = stage(ordered.mapInArrow(run, schema), "fingerprints")
    inner = found.where("edge is null").select("doc_id", *arrow.names)
    # One number per partition: which partition follows which.
    parts = sorted(r.part for r in found.where("edge = 'first'").select("part").collect())
    spark = docs.sparkSession
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    first = found.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    last = (found.where("edge = 'last'").select("doc_id", "text", "part").join(follows, "part").join(first, "following")
            .select("doc_id", "text", "next_text"))

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                yield table_of(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    return inner.unionByName(last.mapInArrow(close, T.StructType(schema.fields[:1 + len(arrow)])))
