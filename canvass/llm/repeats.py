"""Operator 8: remove long repeated passages, with a count-min prefilter.

A window is ``width`` consecutive words of one document.  Words covered by a
window whose word sequence also starts anywhere else are removed; windows are
judged on the input.

1. Every window is counted under its minimiser, the least hash among the
   ``width - span + 1``-word runs inside it.  A minimiser's occurrences are at
   least as many as those of any window it stands for, so counting each
   selected occurrence once overestimates every window, never the reverse.
   Tasks fill count-min sketches (counters stop at 2: only "repeated" is
   asked), send them as sorted cell offsets and merge them by cell range.
2. Documents are read again.  Windows whose counters all reach 2 are
   candidates; a document without any is finished.  Each task sends the
   distinct 128-bit hashes of its batches' candidates, by hash range; every
   range is grouped exactly, and one bit per hash goes back to the batch.
3. Batches meet their answers and cut the covered words.

Defined cases: null text has no words and stays null; texts of fewer words
than ``width`` stay whole; kept words are joined by one space; repeated rows
are separate documents, so each is repeated text to the other; null ids are
ordinary values; an empty table gives an empty result; other columns pass
unchanged, and input columns named ``n_words`` or ``n_removed`` are replaced.

Scale: a hash that a third of the documents hold is sent once per batch.  The
merged sketch is broadcast; its size is bounded by ``max_cells`` bits per row
whatever the data.  Above about ``4 * max_cells`` bytes of text it gets less
selective and more windows take the exact pass, whose shuffle grows in
proportion to the text; no window is ever lost.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASES, Words, _mix, byte_slices, run_hashes, ship, stage

ROWS = 2
SLICE = 1 << 16
GROUP = 64
_TOP = np.iinfo(np.uint64).max


def _slide(values: np.ndarray, span: int, pick) -> np.ndarray:
    """pick over values[i : i + span] for a power of two ``span``; the tail is padded by repeating the last."""
    step = 1
    out = values
    while step < span:
        out = pick(out, np.concatenate([out[step:], np.repeat(out[-1:], min(step, len(out)))]))
        step *= 2
    return out


class Batch:
    """Window hashes of some texts: minimiser per window and selected minimiser positions."""

    def __init__(self, texts: list[bytes], width: int):
        self.words = Words(texts)
        self.width = width
        self.span = 1
        while self.span * 2 <= (width + 1) // 2:
            self.span *= 2
        self.h1 = self.words.hashes(0)
        self.at, _ = self._starts(width)

    def _starts(self, width: int):
        n = np.maximum(np.diff(self.words.first) - width + 1, 0)
        at = np.repeat(self.words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, n

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """(least run hash of every window, run hashes at the selected positions)."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        run = self.width - self.span + 1
        total = len(self.h1)
        least = np.full(total, _TOP, np.uint64)
        starts, _ = self._starts(run)
        least[starts] = run_hashes(self.h1, starts, starts + run, BASES[1])
        runs = least.copy()
        # All runs of a window start inside its text, so no run of another text mixes in.
        of_window = _slide(least, self.span, np.minimum)
        shown = np.zeros(total, np.uint64)
        shown[self.at] = of_window[self.at]
        back = _slide(shown[::-1], self.span, np.maximum)[::-1]
        chosen = (back == runs) & (runs != _TOP)
        return of_window[self.at], runs[chosen]

    def exact(self, starts: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of the windows at ``starts``, as an (n, 2) array."""
        h2 = self.words.hashes(1)
        return np.stack([run_hashes(self.h1, starts, starts + self.width, BASES[1]),
                         run_hashes(h2, starts, starts + self.width, BASES[0])], axis=1)


def _cells(values: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (_mix(values + np.uint64(row * 0x632BE59BD9B4E019 & (2 ** 64 - 1))) & np.uint64(cells - 1)).astype(np.int64)


def _texts(column) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.binary())]


def count_min(docs: DataFrame, text: str, width: int, cells: int) -> list[np.ndarray]:
    """Merged sketch rows as packed bits: a set bit is a counter of at least 2."""
    groups = max(1, cells // (SLICE * GROUP))
    per = min(GROUP, max(1, cells // SLICE))

    def fill(batches):
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = _texts(batch.column(0))
            for lo, hi in byte_slices(texts):
                found.append(Batch(texts[lo:hi], width).minimisers()[1])
                size += len(found[-1])
                if size > 4_000_000:
                    yield pack(np.concatenate(found))
                    found, size = [], 0
        if size:
            yield pack(np.concatenate(found))

    def pack(values):
        keys, blobs = [], []
        for row in range(ROWS):
            cell = np.sort(_cells(values, row, cells))
            if len(cell) > 2:  # a counter stops at 2
                cell = cell[np.concatenate([[True, True], cell[2:] != cell[:-2]])]
            bounds = np.searchsorted(cell, np.arange(groups + 1) * SLICE * per)
            for g in range(groups):
                part = cell[bounds[g]:bounds[g + 1]]
                if len(part):
                    count = np.bincount((part // SLICE) % per, minlength=per).astype(np.uint32)
                    keys.append(row * groups + g)
                    blobs.append(count.tobytes() + (part % SLICE).astype(np.uint16).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())],
                                          names=["part", "cells"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = np.frombuffer(blob, np.uint32, per)
                offset = np.frombuffer(blob, np.uint16, offset=4 * per).astype(np.int64)
                offset += np.repeat(np.arange(per) * SLICE, count)
                have = total.setdefault(key, np.zeros(per * SLICE, np.uint8))
                double = offset[1:][offset[1:] == offset[:-1]]
                have[offset] += 1
                have[double] += 1
                np.minimum(have, 2, out=have)
        for key, have in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), pa.array([np.packbits(have >= 2).tobytes()], pa.binary())],
                names=["part", "cells"])

    schema = "part int, cells binary"
    merged = (docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(fill, schema)
              .repartition(min(512, ROWS * groups), "part").mapInArrow(merge, schema))
    bits = [np.zeros(max(cells, SLICE) // 8, np.uint8) for _ in range(ROWS)]
    step = per * SLICE // 8
    for r in merged.toLocalIterator():
        row, g = divmod(r["part"], groups)
        bits[row][g * step:(g + 1) * step] = np.frombuffer(r["cells"], np.uint8)
    return bits


def _repeated(bits: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for row, b in enumerate(bits):
        cell = _cells(values, row, len(b) * 8)
        out &= (b[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _order(pairs: np.ndarray, shards: int):
    """Distinct hash pairs in (shard, hash) order: pairs, shard of each, place of every input, seen twice."""
    kind = np.dtype([("a", np.uint64), ("b", np.uint64)])
    flat = np.ascontiguousarray(pairs).view(kind).ravel()
    one, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    # The first hash, cut into equal ranges, names the shard: sorted order is shard order.
    shard = (((one["a"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    return one, shard, place, count > 1


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, cells_per_byte: float = 1 / 8,
                   max_cells: int = 1 << 30, shard_bytes: int = 8 << 20) -> DataFrame:
    """Documents with repeated words cut from ``text``, n_words and n_removed."""
    ship()
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c != text])
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    cells = SLICE
    while cells < min(max_cells, size * cells_per_byte):
        cells *= 2
    shards = max(1, -(-size // shard_bytes))
    bits = spark.sparkContext.broadcast(count_min(docs, text, width, cells))
    names, column = docs.columns, docs.columns.index(text)
    extra = T.StructType([T.StructField("__kind", T.IntegerType()), T.StructField("__batch", T.LongType()),
                          T.StructField("__shard", T.LongType()), T.StructField("__blob", T.BinaryType()),
                          T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema.fields], *extra.fields])

    def second(batches):
        draw = random.SystemRandom()
        for batch in batches:
            texts = _texts(batch.column(column))
            for lo, hi in byte_slices(texts):
                b = Batch(texts[lo:hi], width)
                least, _ = b.minimisers()
                starts = b.at[_repeated(bits.value, least)]
                first = b.words.first
                owner = np.searchsorted(first, starts, side="right") - 1
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
                n = np.diff(first)
                held = np.diff(bounds) > 0
                me = draw.getrandbits(63)
                kept = [None if held[i] or not batch.column(column)[lo + i].is_valid
                        else b" ".join(texts[lo + i].split()) for i in range(hi - lo)]
                blob = [(starts[bounds[i]:bounds[i + 1]] - first[i]).astype(np.int32).tobytes() if held[i] else None
                        for i in range(hi - lo)]
                old = batch.slice(lo, hi - lo)
                new_text = pa.array([texts[lo + i] if held[i] else kept[i] for i in range(hi - lo)],
                                    pa.binary()).cast(batch.schema.field(column).type)
                yield pa.RecordBatch.from_arrays(
                    [*[new_text if i == column else old.column(i) for i in range(len(names))],
                     pa.array(held.astype(np.int32)), pa.array([me] * (hi - lo), pa.int64()),
                     pa.nulls(hi - lo, pa.int64()), pa.array(blob, pa.binary()),
                     pa.array(n, pa.int64()), pa.array(np.zeros(hi - lo, np.int64))],
                    names=[*names, *extra.names])
                if len(starts):
                    one, shard, _, twice = _order(b.exact(starts), shards)
                    used, cut = np.unique(shard, return_index=True)
                    cut = np.append(cut, len(one))
                    parts = [one[p:q].tobytes() + np.packbits(twice[p:q]).tobytes() for p, q in zip(cut, cut[1:])]
                    k = len(used)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(k, batch.schema.field(i).type) for i in range(len(names))],
                         pa.array(np.full(k, 2, np.int32)), pa.array([me] * k, pa.int64()), pa.array(used, pa.int64()),
                         pa.array(parts, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                        names=[*names, *extra.names])

    passed = stage(docs.mapInArrow(second, schema), "repeats-pass", partition_by="__kind")

    def answer(batches):
        now, held = None, []
        for batch in batches:
            for s, me, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != now and held:
                    yield judge(now, held)
                    held = []
                now = s
                held.append((me, blob))
        if held:
            yield judge(now, held)

    def judge(shard, held):
        # Each blob holds n 16-byte hashes and n bits.
        sizes = [len(blob) * 8 // 129 for _, blob in held]
        kind = np.dtype([("a", np.uint64), ("b", np.uint64)])
        every = np.concatenate([np.frombuffer(blob, kind, n) for (_, blob), n in zip(held, sizes)])
        local = np.concatenate([np.unpackbits(np.frombuffer(blob, np.uint8, offset=16 * n))[:n]
                                for (_, blob), n in zip(held, sizes)]).astype(bool)
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        yes = np.bincount(place, weights=local) + count >= 2
        cut = np.cumsum([0, *sizes])
        mask = [np.packbits(yes[place[p:q]]).tobytes() for p, q in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([me for me, _ in held], pa.int64()), pa.array([shard] * len(held), pa.int64()),
             pa.array(mask, pa.binary())], names=["__batch", "__shard", "mask"])

    answers = (passed.where("__kind = 2").select("__shard", "__batch", "__blob")
               .repartition(F.col("__shard")).sortWithinPartitions("__shard")
               .mapInArrow(answer, "__batch long, __shard long, mask binary"))

    out_schema = T.StructType([*schema.fields[:len(names)], *extra.fields[-2:]])
    out_names = [*names, "n_words", "n_removed"]

    def cut(key, texts_table, answer_table):
        texts = _texts(texts_table.column(text).combine_chunks())
        blobs = texts_table.column("__blob").to_pylist()
        b = Batch(texts, width)
        first = b.words.first
        starts = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + first[i] for i, x in enumerate(blobs)])
        one, shard, place, _ = _order(b.exact(starts), shards)
        sent = dict(zip(answer_table.column("__shard").to_pylist(), answer_table.column("mask").to_pylist()))
        used, n = np.unique(shard, return_counts=True)
        yes = np.concatenate([np.unpackbits(np.frombuffer(sent[s], np.uint8))[:k] for s, k in zip(used.tolist(), n)])
        bad = starts[yes[place].astype(bool)]
        edge = np.zeros(len(b.h1) + 1, np.int64)
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = []
        for i, t in enumerate(texts):
            mine = gone[first[i]:first[i + 1]]
            kept.append(b" ".join(w for w, g in zip(t.split(), mine) if not g))
        removed = [int(gone[first[i]:first[i + 1]].sum()) for i in range(len(texts))]
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text else texts_table.column(c)
                   for c in names]
        return pa.table([*columns, texts_table.column("n_words"), pa.array(removed, pa.int64())], names=out_names)

    open_docs = passed.where("__kind = 1").select(*names, "__batch", "__blob", "n_words")
    resolved = (open_docs.groupBy("__batch").cogroup(answers.groupBy("__batch")).applyInArrow(cut, out_schema))
    return passed.where("__kind = 0").select(*out_names).unionByName(resolved)
