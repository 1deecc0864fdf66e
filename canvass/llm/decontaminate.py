"""Operator 6: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lowered) and cut into words of ASCII letters, ASCII
digits and non-ASCII characters.  A window is ``width`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.  All
windows go into one automaton, word by word, and every document is
scanned once in normalised form.  Words inside an occurrence are hit.  Word
spans are mapped back to character offsets of the original text.

A document is contaminated if words are hit and at least ``1 / max_parts`` of
its words are (5 % by default).

Defined cases: null texts have no words; items without words match nothing;
a null item id is written as the empty string, so its windows still hit;
repeated items count once by id; empty tables give zero hits or an empty
result; input columns named like an output column are replaced by it.

Scale: the automaton reads words as codes of one to four letters, so a window takes
few states whatever the length of its words.  Items of up to ``max_bytes`` of text make one
automaton, which is broadcast, and documents are scanned once and never shuffle.
The size is measured first: more items are dealt by hash into shards below the
bound, whose automata scan one after another.  A pass writes its hits only, to
the shared folder, before the next shard is read, so the driver and the
executors hold one shard at a time; the hits meet per text, and runs of words
that two shards share become one span.  The bound moves work, never results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import skew_safe_join
from .common import fresh, lower_ascii, ship, stage

#: Bytes: A-Z lowered; ASCII but letters and digits to space; the rest kept.
_NORMAL = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20
                for i in range(256))
OUTPUT = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of hit words: character offsets in the text, first and last word.
_RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "first", "last")])
_FIELDS = [("n_words", T.LongType()), ("hit_items", T.ArrayType(T.StringType())), ("hit_spans", T.ArrayType(_RUN))]
_ARROW = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(f.name, pa.int32()) for f in _RUN]))]


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(items, width: int):
    """(code of every item word, code of any other word, window in codes -> (its words, ids of the items that hold it)).

    Codes are ``d`` letters: the first out of 64, the others out of 64 more, so
    a state has at most 64 successors and a match can begin at a word only.
    """
    numbers: dict[bytes, int] = {}
    held = []
    for item_id, text in items:
        words = normal_words((text or "").encode("utf-8", "surrogatepass"))
        for w in words:
            numbers.setdefault(w, len(numbers))
        held.append(("" if item_id is None else str(item_id), words))
    d = 1
    while 64 ** d < len(numbers):
        d += 1
    codes = {w: chr(1 + n % 64) + "".join(chr(65 + n // 64 ** k % 64) for k in range(1, d)) for w, n in numbers.items()}
    found: dict[str, tuple] = {}
    for item_id, words in held:
        for at in range(max(1, len(words) - width + 1) if words else 0):
            part = words[at:at + width]
            found.setdefault("".join([codes[w] for w in part]), (len(part), set()))[1].add(item_id)
    return codes, chr(255) * d, {w: (n, tuple(sorted(ids))) for w, (n, ids) in found.items()}


def automaton(windows):
    import ahocorasick

    a = ahocorasick.Automaton()
    for window, found in windows.items():
        a.add_word(window, found)
    if windows:
        a.make_automaton()
    return a


def scan(codes, other: str, a, text: bytes):
    """(number of words, ids, runs of hit words) of one text."""
    normal = text.translate(_NORMAL)
    words = normal.split()
    found = list(a.iter("".join([codes.get(w, other) for w in words]))) if len(a) else []
    if not found:
        return len(words), [], []
    hit = np.zeros(len(words) + 1, np.int32)
    ids: set = set()
    for end, (n, items) in found:
        stop = (end + 1) // len(other)
        hit[stop - n] += 1
        hit[stop] -= 1
        ids.update(items)
    at = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    places = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
    # Byte offsets to character offsets: bytes that begin a character, counted.
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    runs = [{"start": int(begins[places[run[0]][0]]), "end": int(begins[places[run[-1]][1]]),
             "first": int(run[0]), "last": int(run[-1])} for run in np.split(at, breaks)]
    return len(words), sorted(ids), runs


def _scanner(column: int, shared):
    def run(batches):
        codes, other, windows = shared.value
        a = automaton(windows)
        for batch in batches:
            texts = batch.column(column).cast(pa.binary())
            rows = [scan(codes, other, a, t.as_py() or b"") for t in texts]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[n for n, _ in _FIELDS]])
    return run


def _pass(docs: DataFrame, text: str, items: list, width: int):
    """Documents with the output of one automaton, and what was broadcast for it."""
    ship()
    shared = docs.sparkSession.sparkContext.broadcast(windows_of(items, width))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in _FIELDS]])
    return docs.mapInArrow(_scanner(docs.columns.index(text), shared), schema), shared


def _joined_runs(runs):
    """Runs of several passes as one pass gives them: those that overlap or follow each other word on word are one."""
    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
                          last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        # No run yet gives a null condition: a new run begins.
        return F.when(x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1,
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    ordered = F.array_sort(F.transform(runs, lambda x: F.struct(x["first"], x["last"], x["start"], x["end"])))
    ordered = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                      x["first"].alias("first"), x["last"].alias("last")))
    return F.aggregate(ordered, F.array().cast(T.ArrayType(_RUN)), add)


def _by_shards(docs: DataFrame, text: str, items: DataFrame, width: int, shards: int) -> DataFrame:
    key = fresh("__key", docs.columns)
    # What a pass finds depends on the text alone, so hits are keyed by the text's hashes.
    keyed = docs.withColumn(key, F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit(1), text)))
    of = F.pmod(F.xxhash64("id", "text"), F.lit(shards))
    every = None
    for i in range(shards):
        hits, shared = _pass(keyed.select(key, text), text, items.where(of == i).collect(), width)
        hits = stage(hits.where(F.size("hit_items") > 0).select(key, "hit_items", "hit_spans").dropDuplicates([key]), "shard-hits")
        shared.destroy()   # the hits are written: nothing reads the shard again
        every = hits if every is None else every.unionByName(hits)
    merged = every.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"),
        _joined_runs(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"))
    words = F.coalesce(F.regexp_count(lower_ascii(F.col(text)), F.lit(_WORD)), F.lit(0)).cast("long")
    found = skew_safe_join(keyed, merged, [key], "left").drop(key).withColumn("n_words", words)
    return found.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in _FIELDS[1:]})


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = 13, max_parts: int = 20,
                  max_bytes: int = 1 << 20) -> DataFrame:
    """Documents with n_words, n_hit, hit_items (sorted), hit_spans and contaminated."""
    docs = docs.drop(*[c for c in OUTPUT if c != text])
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = math.ceil(size / max_bytes) or 1
    if shards == 1:
        found = _pass(docs, text, items.collect(), width)[0]
    else:
        found = _by_shards(docs, text, items, width, shards)
    # Runs are apart from each other: their words add up.
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    spans = F.transform("hit_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return (found.withColumn("n_hit", n_hit).withColumn("hit_spans", spans)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * max_parts >= F.col("n_words")))
            .select(*docs.columns, *OUTPUT))
