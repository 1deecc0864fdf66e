"""Operator 5: hidden Markov language model.

Words are emitted in two steps: a latent state emits a word class, and the
class emits the word.  Frequent words (the ``head`` most frequent) are classes
of their own; every other word, known or not, belongs to one of
``suffix_classes`` classes by a hash of its last bytes.  Emission tables are
thus bounded, while word counts, which are not, are only summed and joined:

    log P(text) = log P(classes; HMM) + sum of log P(word | class)

with P(word | class) = (count + 1) / (class total + class vocabulary + 1), the
1 being the words never seen; a head word fills its class alone.  A text ends
with one end token, a class of its own.

Baum-Welch runs over all training documents: each task runs scaled
forward-backward over its sequences, cut into segments of ``segment`` words,
and sends expected counts, which are summed by class across partitions.
Scoring is exact over whole texts: word by word, and for long texts by
segments, which are folded into state-to-state matrices, rescaled at each step,
and chained per text.

``base_score`` is the add-one unigram score with the same counts.

Defined cases: null and wordless texts consist of the end token; without
training documents all counts are 0 and every word is unknown; a word of over
64 bytes is no head word, however frequent; null ids are
ordinary values; repeated rows are separate documents; an empty table gives
an empty result; only the id and the text are carried.

Scale: texts are read twice, for the counts and to be encoded; the rounds read
the written class sequences.  A task pre-sums the words of its batches before the count shuffle, so
a frequent word arrives once per batch.  Head words, class totals and
emission tables are broadcast and bounded by parameters.  The other words of
a text meet their counts in a join of distinct (document, word) rows.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, ship, stage

HEAD_BYTES = 64


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class Classes:
    """word -> class number; the end token is class 0, head words 1..H, suffix classes above.

    Head words are known by a 64-bit hash.  The suffix class is one by the
    last three bytes of a word."""

    def __init__(self, head: list[bytes], suffix_classes: int):
        self.first_tail, self.suffix = 1 + len(head), suffix_classes
        self.size = self.first_tail + suffix_classes
        hashes = Words([b"\n".join(head)]).hashes() if head else np.zeros(0, np.uint64)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]

    def of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Class of each word."""
        out = self.first_tail + self._tail(words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            out[found] = 1 + self.number[at[found]]
        return out

    def _tail(self, words: Words) -> np.ndarray:
        h = np.zeros(len(words.start), np.uint64)
        for back in (3, 2, 1):
            at = words.end - back
            inside = at >= words.start
            h = np.where(inside, h * np.uint64(257) + words.bytes[np.maximum(at, 0)] + np.uint64(1), h)
        h = h * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
        return ((h >> np.uint64(8)) % np.uint64(self.suffix)).astype(np.int64)


class Model:
    """start (K), move (K, K) and emit (K, C) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, states: int, totals: np.ndarray, seed: int = 7) -> "Model":
        draw = np.random.default_rng(seed)
        p = (totals + 0.1) / (totals + 0.1).sum()
        emit = p * np.exp(0.5 * draw.standard_normal((states, len(p))))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
        return cls(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True),
                   emit / emit.sum(axis=1, keepdims=True))

    @property
    def arrays(self):
        return self.start, self.move, self.emit

    def update(self, start, move, emit, prior: np.ndarray) -> None:
        """M-step; every class keeps a little mass so that no text gets probability 0."""
        self.start = (start + 0.1) / (start + 0.1).sum()
        self.move = (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)
        emit = emit + prior
        self.emit = emit / emit.sum(axis=1, keepdims=True)


def _grid(sequences: list[np.ndarray], segment: int):
    """Sequences cut into segments, as a (steps, segments) array padded with -1; owner of each segment."""
    flat = np.concatenate(sequences)
    n = np.array([len(s) for s in sequences])
    per = -(-n // segment)
    owner = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(n) - n)[owner] + nth * segment
    size = np.minimum(segment, (np.cumsum(n))[owner] - begin)
    # Longest first: at every step the segments still running are a prefix.
    order = np.argsort(-size, kind="stable")
    return flat, owner[order], nth[order], begin[order], size[order]


def expected_counts(model: Model, sequences: list[np.ndarray], segment: int):
    """Expected start, move and emission counts of the sequences (scaled forward-backward), and log likelihood."""
    states, classes = model.emit.shape
    flat, _, nth, begin, size = _grid(sequences, segment)
    steps = int(size[0])
    running = np.searchsorted(-size, -np.arange(steps), side="left")
    # States along the first axis: every operation then runs over long rows.
    symbols = [flat[begin[:k] + t] for t, k in enumerate(running)]
    alphas, scales, logs = [], [], 0.0
    for t, k in enumerate(running):
        a = model.emit.take(symbols[t], axis=1)
        a *= model.start[:, None] if t == 0 else model.move.T @ alphas[-1][:, :k]
        c = a.sum(axis=0)
        a /= c
        alphas.append(a)
        scales.append(c)
        logs += float(np.log(c).sum())
    move = np.zeros((states, states))
    gammas = [None] * steps
    beta = np.ones((states, running[-1]))
    for t in range(steps - 1, -1, -1):
        k = running[t]
        if beta.shape[1] < k:
            beta = np.concatenate([beta, np.ones((states, k - beta.shape[1]))], axis=1)
        gammas[t] = alphas[t] * beta
        if t:
            onward = model.emit.take(symbols[t], axis=1)
            onward *= beta
            onward /= scales[t]
            move += alphas[t - 1][:, :k] @ onward.T
            beta = model.move @ onward
    move *= model.move
    gamma, emitted = np.concatenate(gammas, axis=1), np.concatenate(symbols)
    counts = np.stack([np.bincount(emitted, weights=g, minlength=classes) for g in gamma])
    return gammas[0].sum(axis=1), move, counts, logs


def forward_log10(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of every sequence, word by word over all sequences at once."""
    n = np.array([len(s) for s in sequences])
    order = np.argsort(-n, kind="stable")
    flat, begin = np.concatenate(sequences), (np.cumsum(n) - n)[order]
    total = np.zeros(len(n))
    state = None
    for t, k in enumerate(np.searchsorted(-n[order], -np.arange(int(n.max())), side="left")):
        a = model.emit.take(flat[begin[:k] + t], axis=1)
        a *= model.start[:, None] if t == 0 else model.move.T @ state[:, :k]
        c = a.sum(axis=0)
        a /= c
        total[:k] += np.log10(c)
        state = a
    out = np.empty(len(n))
    out[order] = total
    return out


def sequence_log10(model: Model, sequences: list[np.ndarray], segment: int) -> np.ndarray:
    """Exact log10 probability of every sequence: short ones word by word, long ones by segments."""
    long = np.array([len(s) > 16 * segment for s in sequences])
    out = np.zeros(len(sequences))
    for choose, some in ((segments_log10, long), (lambda m, s, _: forward_log10(m, s), ~long)):
        if some.any():
            out[some] = choose(model, [s for s, x in zip(sequences, some) if x], segment)
    return out


def segments_log10(model: Model, sequences: list[np.ndarray], segment: int) -> np.ndarray:
    """log10 probability of every sequence, all segments of all sequences at once."""
    states = len(model.start)
    flat, owner, nth, begin, size = _grid(sequences, segment)
    emit = np.ascontiguousarray(model.emit.T)
    running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    # fold[s] maps the state before segment s to the state at its end; a text's
    # first word has no move before it, so its segment starts from the identity.
    fold = np.broadcast_to(np.eye(states), (len(owner), states, states)).copy()
    logs = np.zeros(len(owner))
    first = nth == 0
    for t in range(len(running)):
        k = running[t]
        e = emit[flat[begin[:k] + t]]
        m = fold[:k] @ model.move
        if t == 0:
            m[first[:k]] = fold[:k][first[:k]]
        m *= e[:, None, :]
        c = m.sum(axis=(1, 2))
        fold[:k] = m / c[:, None, None]
        logs[:k] += np.log10(c)
    # Chain the segments of a text in order, all texts at once.
    total = np.zeros(len(sequences))
    state = np.broadcast_to(model.start, (len(sequences), states)).copy()
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange(int(nth.max()) + 2))
    for i in range(len(bounds) - 1):
        s = order[bounds[i]:bounds[i + 1]]
        v = np.einsum("si,sij->sj", state[owner[s]], fold[s])
        c = v.sum(axis=1)
        state[owner[s]] = v / c[:, None]
        total[owner[s]] += np.log10(c) + logs[s]
    return total


def _texts(column) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.binary())]


def _slices(sequences: list[np.ndarray], limit: int = 1 << 19):
    lo = size = 0
    for i, s in enumerate(sequences):
        if i > lo and size + len(s) > limit:
            yield sequences[lo:i]
            lo, size = i, 0
        size += len(s)
    if lo < len(sequences):
        yield sequences[lo:]


def word_counts(docs: DataFrame, text: str, flush: int = 300_000) -> DataFrame:
    """(word binary, c long) over the texts; the end token is the empty word."""
    def count(batches):
        words: Counter = Counter()
        for batch in batches:
            for t in _texts(batch.column(0)):
                words.update(tokens(t))
                words[b""] += 1
                if len(words) > flush:
                    yield pack(words)
                    words = Counter()
        if words:
            yield pack(words)

    def pack(words):
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                                          names=["word", "c"])

    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in column.to_pylist()]


def train(encoded: DataFrame, classes: Classes, totals: np.ndarray, states: int, rounds: int, segment: int) -> Model:
    """Baum-Welch over all rows of ``encoded`` (seq: class numbers as uint32 bytes).

    Expected counts are summed across partitions by class.
    """
    spark = encoded.sparkSession
    model = Model.initial(states, totals)
    prior = 0.01 * (totals + 0.1) / (totals + 0.1).sum() * max(1.0, totals.sum()) / states + 1e-3
    fields = ["c"] + [f"s{i}" for i in range(states)]
    schema = ", ".join(["c int"] + [f"s{i} double" for i in range(states)])
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model.arrays)

        def gather(batches, now=now):
            start, move, emit = 0.0, 0.0, 0.0
            current = Model(*now.value)
            for batch in batches:
                for part in _slices(_sequences(batch.column(0))):
                    a, b, c, _ = expected_counts(current, part, segment)
                    start, move, emit = start + a, move + b, emit + c
            if isinstance(emit, float):
                return
            # Rows below 0 carry the start counts (-1) and the moves out of each state (-2 - state).
            ids = np.concatenate([np.flatnonzero(emit.sum(axis=0)), [-1], -2 - np.arange(states)])
            rows = np.concatenate([emit.T[ids[:-1 - states]], start[None], move])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(rows[:, i]) for i in range(states)]],
                                             names=fields)

        sums = encoded.select("seq").mapInArrow(gather, schema).groupBy("c").agg(*[F.sum(f).alias(f) for f in fields[1:]])
        emit, move, start = np.zeros((states, classes.size)), np.zeros((states, states)), np.zeros(states)
        for r in sums.collect():
            row = np.array(r[1:])
            if r["c"] >= 0:
                emit[:, r["c"]] = row
            elif r["c"] == -1:
                start = row
            else:
                move[-2 - r["c"]] = row
        model.update(start, move, emit, prior)
        now.unpersist()
    return model


ENCODED = (pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))


def encoded_part(known: Classes, texts: list[bytes], base: np.ndarray, norm: np.ndarray, ends: int) -> list[pa.Array]:
    """The ``ENCODED`` columns of some lower-cased texts."""
    words, k = Words(texts), len(texts)
    hashes = words.hashes()
    s = known.of(words, hashes)
    n = np.diff(words.first)
    doc = np.repeat(np.arange(k), n)
    tail = s >= known.first_tail
    seq = np.zeros(len(s) + k, "<u4")  # an end token, class 0, after the words of each text
    seq[np.arange(len(s)) + doc] = s
    seq_ends = 4 * np.concatenate([[0], np.cumsum(n + 1)])
    base_sum = np.bincount(doc[~tail], weights=base[s[~tail]], minlength=k) + base[0]
    within = -np.bincount(doc[tail], weights=norm[s[tail] - known.first_tail], minlength=k)
    known_n = np.bincount(doc[~tail], minlength=k) + ends
    # Distinct words outside the head: runs of equal hashes within a text.
    at = np.flatnonzero(tail)
    at = at[np.lexsort((hashes[at], doc[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (hashes[at[1:]] != hashes[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(at)]]))
    own = at[first]
    lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=k))]), pa.int32())
    size = words.end[own] - words.start[own]
    ends_at = np.concatenate([[0], np.cumsum(size)])
    letters = words.bytes[np.arange(ends_at[-1]) + np.repeat(words.start[own] - ends_at[:-1], size)]
    return [_binary(seq_ends, seq.view(np.uint8)), pa.array(base_sum), pa.array(within), pa.array(known_n, pa.int64()),
            pa.ListArray.from_arrays(lists, _binary(ends_at, letters)),
            pa.ListArray.from_arrays(lists, pa.array(counts, pa.int32()))]


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)),
                                                              pa.py_buffer(np.ascontiguousarray(data))])


def head_words(counts: DataFrame, head: int) -> list:
    """The ``head`` most frequent words, ties to the smaller word.

    A histogram of counts first tells a count that few more than ``head`` words reach, so
    that no more are sorted; one task merges them, and the driver gets the result only.
    """
    words = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= HEAD_BYTES))
    step = F.floor(F.log2("c") * 16)
    left, least = head, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        least, left = r["step"], left - r["count"]
        if left <= 0:
            break
    some = words if least is None else words.where(step >= least)
    kept = stage(some.orderBy(F.col("c").desc(), "word").limit(head), "hmm-head").collect()
    return sorted(kept, key=lambda r: (-r["c"], bytes(r["word"])))


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", head: int = 16384,
          suffix_classes: int = 2048, states: int = 6, rounds: int = 4, segment: int = 128) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out``: a boolean column; the others train.
    """
    ship()
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = stage(word_counts(training, "text"), "hmm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tops = head_words(counts, head)
    classes = Classes([bytes(r["word"]) for r in tops], suffix_classes)
    head_counts = np.array([r["c"] for r in tops], np.int64)
    shared = spark.sparkContext.broadcast(([bytes(r["word"]) for r in tops], suffix_classes))

    def by_class(batches):
        total, words = np.zeros(suffix_classes), np.zeros(suffix_classes, np.int64)
        known = Classes(*shared.value)
        for batch in batches:
            listed = Words([b"\n".join(batch.column(0).to_pylist())])  # the empty word, the end token, is none of them
            k = known.of(listed, listed.hashes()) - known.first_tail
            c = np.asarray(batch.column(1))[np.asarray(pc.binary_length(batch.column(0))) > 0]
            total += np.bincount(k[k >= 0], weights=c[k >= 0], minlength=suffix_classes)
            words += np.bincount(k[k >= 0], minlength=suffix_classes)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64)), pa.array(words[at])],
                                         names=["k", "total", "words"])

    tail_total, tail_words = np.zeros(suffix_classes, np.int64), np.zeros(suffix_classes, np.int64)
    for r in (counts.mapInArrow(by_class, "k long, total long, words long").groupBy("k")
              .agg(F.sum("total").alias("total"), F.sum("words").alias("words")).collect()):
        tail_total[r["k"]], tail_words[r["k"]] = r["total"], r["words"]
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    totals = np.concatenate([[ends], head_counts, tail_total]).astype(float)
    base_norm = log10(n + v + 1)
    base_of_class = np.log10(totals + 1) - base_norm
    tail_norm = np.log10(tail_total + tail_words + 1)
    fixed = spark.sparkContext.broadcast((base_of_class, tail_norm))
    def encode(batches):
        """Class sequence of each document, what its score needs beside the
        model and a join, and its other words as distinct (word, n) lists."""
        base, norm = fixed.value
        known = Classes(*shared.value)
        for batch in batches:
            texts = [t.lower() for t in _texts(batch.column(1))]
            parts = [encoded_part(known, texts[lo:hi], base, norm, 1 if ends else 0) for lo, hi in byte_slices(texts)]
            columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else [pa.array([], t) for t in ENCODED]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns],
                                             names=["doc_id", "held_out", "seq", "base", "within", "known", "words", "ns"])

    kind = dict(docs.dtypes)["doc_id"]
    raw = docs.select("doc_id", F.col("text").cast("binary"), "held_out")
    done = stage(raw.mapInArrow(encode, f"doc_id {kind}, held_out boolean, seq binary, base double, within double, "
                                        "known long, words array<binary>, ns array<int>")
                 .withColumn("row", F.monotonically_increasing_id()), "hmm-documents")
    model = train(done.where(~F.col("held_out")), classes, totals, states, rounds, segment)
    trained = spark.sparkContext.broadcast(model.arrays)

    def forward(batches):
        model = Model(*trained.value)
        for batch in batches:
            parts = _slices(_sequences(batch.column(1)))
            scores = np.concatenate([sequence_log10(model, p, segment) for p in parts]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "hmm"])

    scored = done.select("row", "seq").mapInArrow(forward, "row long, hmm double")
    asked = done.select("row", F.explode(F.arrays_zip("words", "ns")).alias("e")).select(
        "row", F.col("e.words").alias("word"), F.col("e.ns").alias("n"))
    found = (asked.join(counts, "word").groupBy("row")
             .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"), F.sum("n").alias("hits")))
    tail_n = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    gain, hits = F.coalesce("gain", F.lit(0.0)), F.coalesce("hits", F.lit(0))
    rest = done.select("row", "doc_id", "held_out", F.expr("octet_length(seq) div 4").cast("long").alias("n_tokens"),
                       "base", "within", "known", tail_n.alias("tail_n"))
    return (rest.join(scored, "row").join(found, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + hits).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base") + gain - F.col("tail_n") * base_norm).alias("base_score"),
                    (F.col("hmm") + F.col("within") + gain).alias("score")))
