"""Helpers shared by the operators: written intermediate tables and word hashing.

Words are ``[^\\x20\\x09-\\x0D]+``: runs of anything but space, tab, LF, VT, FF
and CR.  ``bytes.split()`` splits on exactly those six bytes and
``bytes.lower()`` lowers exactly A-Z, so both work on UTF-8 bytes directly.
"""

from __future__ import annotations

import contextlib
import os
import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the plan
    below the written table.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, limit: int):
    """What runs inside hands its rows to Python in Arrow batches of about ``limit`` bytes at most, a longer row alone.

    By default only rows are counted, 10,000 a batch, whatever their length.
    """
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, was) if was else spark.conf.unset(BATCH_BYTES)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column of the input is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship() -> None:
    """Send this package's functions to the Python workers by value: they need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def whole_vector(x: Column) -> Column:
    """Whether a vector is there and all its components are finite; never null."""
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def row_key(*cols: Column, seed: int = 0) -> Column:
    """64-bit hash of the given columns; equal rows get equal keys."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols])


# ---- vectorised hashing of words and windows (numpy, inside tasks) ----

def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n; base is odd, so both exist."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(m - 1, base, np.uint64)]))
        down = np.cumprod(np.concatenate([one, np.full(m - 1, pow(base, -1, 1 << 64), np.uint64)]))
        have = _POWERS[base] = (up, down)
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of ``values[s:e]`` for every (s, e); values are uint64."""
    up, down = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Values that ``ordered_hashes`` takes at a time; a longer span is taken whole.
BLOCK_VALUES = 1 << 16


def ordered_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, add: int = 0) -> np.ndarray:
    """``run_hashes`` of ``values + add`` for spans in ascending order (starts and ends).

    A span's hash does not depend on what lies around it, so the values are
    widened and summed block by block: what is held beside the hashes does not
    grow with ``values``, which may be bytes.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + max(BLOCK_VALUES, 2 * (ends[lo] - at)), side="right")))
        block = values[at:ends[hi - 1]].astype(np.uint64)
        block += np.uint64(add)
        out[lo:hi] = run_hashes(block, starts[lo:hi] - at, ends[lo:hi] - at, base)
        lo = hi
    return out


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words of a batch of texts as arrays: byte spans, first word per text, 64-bit hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        word = ~_SPACE[raw]
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.offsets = offsets
        #: Words of text i are those from first[i] up to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.bytes = raw

    def hashes(self, which: int = 0) -> np.ndarray:
        return ordered_hashes(self.bytes, self.start, self.end, BASES[which], add=1)

    def windows(self, hashes: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``width`` words inside one text."""
        n = np.diff(self.first) - width + 1
        keep = np.repeat(n > 0, np.maximum(n, 0))
        base = np.repeat(self.first[:-1], np.maximum(n, 0))
        step = np.arange(len(keep)) - np.repeat(np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0),
                                                np.maximum(n, 0))
        at = base + step
        return at, ordered_hashes(hashes, at, at + width, BASES[1 - which])


def byte_slices(texts: list[bytes], limit: int = 4 << 20):
    """(from, to) of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
