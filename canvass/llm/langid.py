"""Operator 9: language identification by compression.

Every language gets a raw-content zstandard dictionary of its training texts.
Texts are compared by their letters: lower-cased, with every run of other
ASCII characters as one space.  A text is cut into pieces of ``piece`` bytes,
so that the dictionary stays in reach over the whole of a long text, and each
piece is compressed with every dictionary; the language with the smallest
total wins.  A text of at most ``SHORT`` bytes is compressed ``COPIES`` times
over: alone it would be stored as it is wherever compression does not pay, with
the same size for every dictionary.  The margin is the
share of bytes that the winner saves against the runner-up.  Texts with a
margin below ``min_margin`` are rejected.

Defined cases: null texts and texts without a letter get ``und`` with score 0
and are rejected; without training rows every text is ``und``; ties go to the
language that sorts first, with score 0; null and blank training texts teach
nothing; null ids are ordinary values; input columns named like an output
column are replaced; an empty table gives an empty result.

Scale: training reads a bounded sample.  What binds is ``dict_bytes`` per
dictionary (the whole set at most ``MAX_DICT_BYTES``, which bounds the
broadcast), filled by pieces of ``take`` characters; at most ``sample_docs``
documents per language, picked by hash, are drawn for it, enough for 64 kB
unless most texts are short.  A count per language bounds the hashes that can
be drawn, so the task that ranks a language gets some 2000 rows of it, however
many there are.  Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, row_key, ship

MAX_DICT_BYTES = 64 << 20
SHORT, COPIES = 256, 8
#: Rows let through to the ranking of a language, in times of ``sample_docs``: so many that chance, or the
#: error of the estimated number of keys, never leaves fewer than ``sample_docs``.
DRAW = 4
OUTPUT = ("lang_pred", "score", "rejected")
#: Bytes of lower-cased UTF-8: a-z and non-ASCII stay, the rest become spaces.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def letters_of(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample_docs: int = 500, dict_bytes: int = 64 << 10, take: int = 256) -> dict[str, bytes]:
    """language -> dictionary content, from a bounded sample of labelled rows.

    The rows with the smallest key hash are drawn per language.  A piece of
    ``take`` characters of each drawn text, at a place picked by hash, teaches;
    in the order of the hashes until the dictionary's bytes are full.
    """
    rows = rows.where(F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0))
    order = Window.partitionBy(lang).orderBy("__h", F.col(key))
    places = F.greatest(F.length(F.col(text)) - take + 1, F.lit(1))
    start = (F.pmod(row_key(F.col(key), seed=1), places) + 1).cast("int")
    # Hashes are even, so a language's least ``sample_docs`` lie below a bound that its number of keys gives:
    # only rows below ``DRAW`` times that are dealt by language.  The draw is that of all rows.
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang"))
              .agg(F.approx_count_distinct(row_key(F.col(key))).alias("n")).collect()}
    shares = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, DRAW * sample_docs / max(1, n))))]
    share = F.create_map(*shares)[F.col(lang)] if counts else F.lit(1.0)
    place = row_key(F.col(key)).cast("double") / 2.0 ** 64 + 0.5
    drawn = (rows.where(place <= share)
             .select(F.col(lang).alias("lang"), F.col(key), row_key(F.col(key)).alias("__h"),
                     F.col(text).substr(start, F.lit(take)).alias("text"))
             .withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample_docs))
    found: dict[str, list] = {}
    for r in drawn.select("lang", "__n", "text").collect():
        found.setdefault(r["lang"], []).append((r["__n"], letters_of(r["text"])))
    each = min(dict_bytes, MAX_DICT_BYTES // max(1, len(found)))
    return {k: b" ".join(t for _, t in sorted(v))[:each] for k, v in sorted(found.items())}


def _compressors(dictionaries: dict[str, bytes], level: int):
    import zstandard as z

    out = []
    for content in dictionaries.values():
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                    write_checksum=False, write_dict_id=False))
    return list(dictionaries), out


def classify(text: str, names, compressors, piece: int, has_letter: bool):
    """(language, score, margin): margin is the winner's saving, score four times that, at most 1."""
    if not names or not has_letter:
        return "und", 0.0, 0.0
    letters = letters_of(text)
    views = [memoryview(letters)]
    if len(letters) <= SHORT:
        # With and without a space in front: two parses of a short text tie less often than one.
        copies = (letters + b" ") * COPIES
        views = [copies, b" " + copies]
    sizes = [sum(len(c.compress(v[at:at + piece])) for v in views for at in range(0, len(v), piece)) for c in compressors]
    if len(sizes) == 1:
        return names[0], 1.0, 1.0
    if not sum(sizes):
        return names[0], 0.0, 0.0
    order = np.argsort(sizes, kind="stable")
    margin = 1.0 - sizes[order[0]] / sizes[order[1]]
    return names[order[0]], min(1.0, 4.0 * margin), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 7,
             piece: int = 8192, min_margin: float = 0.002) -> DataFrame:
    """Documents with lang_pred, score (0 to 1) and rejected."""
    docs = docs.drop(*[c for c in OUTPUT if c != text])
    ship()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    column = docs.columns.index(text)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("rejected", T.BooleanType())]
    letter, mark = len(docs.columns), fresh("__letter", docs.columns)

    def run(batches):
        names, compressors = _compressors(shared.value, level)
        for batch in batches:
            texts = batch.column(column)
            letters = batch.column(letter).to_pylist()
            rows = [classify(t.as_py() or "", names, compressors, piece, bool(has)) for t, has in zip(texts, letters)]
            langs, scores, margins = ([r[i] for r in rows] for i in range(3))
            keep = [i for i in range(batch.num_columns) if i != letter]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([m < min_margin for m in margins], pa.bool_())],
                names=[*[batch.schema.names[i] for i in keep], *OUTPUT])

    marked = docs.withColumn(mark, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
