"""Staged lead pipeline: reviews -> website -> generated text, each optional.

Stages compose lazily into one plan; nothing runs until the caller writes or
collects the result.  Every stage splits its input by what a row still needs,
so a long plan would compute its upstream once per branch: ``checkpoint=True``
writes each stage's result to the shared checkpoint folder instead, and every
join and every generator call then runs once.

With a ``ledger`` folder a run can be stopped and continued.  Each stage's result
is written there under a fingerprint of the stage, its settings and its input:
rows, not file names, so a table that is computed anew is recognised.  A run
reads the stages that are there and begins with the first that is not.  A
preview notes how far it came, and ``run_rest`` goes on from there by itself.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.template import DEFAULT_TEMPLATE
from ..operators.generate import generate
from ..operators.merge import preview, resume, resume_start
from ..session import scratch_path
from ..sources import files
from .enrich import enrich_reviews
from .web import enrich_web


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order: one pass, one row a task."""
    def plain(f: T.StructField):
        nested = isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
        return F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if nested else F.col(f"`{f.name}`")

    columns = [c for f in df.schema for c in (plain(f).isNull(), plain(f))]
    hashes = df.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    seen = hashes.agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"], F.bit_xor("a"), F.bit_xor("b")).first()
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return _digest(kinds, *seen)


def _digest(*parts) -> str:
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:32]


def stages(places: DataFrame | None = None, pages: DataFrame | None = None, generator=None,
           template: str = DEFAULT_TEMPLATE, product_description: str = "",
           mode: str = "interactive", retry_errors: bool = True, checkpoint: bool = False, fuzzy: int = 0,
           journal: str | None = None, ledger: str | None = None):
    """A ``DataFrame -> DataFrame`` function applying the enabled stages."""
    steps = []  # (name, step, what its result depends on beside its input)
    if places is not None:
        steps.append(("reviews", partial(enrich_reviews, places=places, fuzzy=fuzzy), (places, fuzzy)))
    if pages is not None:
        steps.append(("website", partial(enrich_web, pages=pages, mode=mode), (pages, mode)))
    if generator is not None:
        name = getattr(generator, "__qualname__", None) or type(generator).__qualname__
        steps.append(("generate", partial(generate, fn=generator, template=template, product_description=product_description,
                                          retry_errors=retry_errors, journal=journal),
                      (name, template, product_description, retry_errors)))
    tables = {}  # fingerprints of side tables, taken once

    def settings(parts) -> list:
        return [tables.setdefault(id(p), fingerprint(p)) if isinstance(p, DataFrame) else p for p in parts]

    def apply(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        so_far = fingerprint(df) if ledger and steps else None
        for name, step, parts in steps:
            if ledger:
                so_far = _digest(so_far, name, settings(parts))
                path = f"{ledger.rstrip('/')}/{name}-{so_far}"
                if not files.exists(spark, path + "/_SUCCESS"):
                    step(df).write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
                continue
            df = step(df)
            if checkpoint:
                path = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
                df.write.parquet(path)
                df = spark.read.schema(df.schema).parquet(path)
        return df
    return apply


def run(leads: DataFrame, **kw) -> DataFrame:
    return stages(**kw)(leads)


def run_preview(leads: DataFrame, n: int = 10, **kw) -> DataFrame:
    out = preview(leads, stages(**kw), n=n)
    if kw.get("ledger"):  # the stages have run: the note is true
        files.touch(leads.sparkSession, f"{kw['ledger'].rstrip('/')}/preview-{fingerprint(leads)}-{n}")
    return out


def previewed(leads: DataFrame, ledger: str) -> int:
    """How many rows of ``leads`` the ledger's previews have come to."""
    mark = f"preview-{fingerprint(leads)}-"
    return max((int(n[len(mark):]) for n in files.names(leads.sparkSession, ledger) if n.startswith(mark)), default=0)


def run_rest(leads: DataFrame, start: int | None = None, **kw) -> DataFrame:
    """The stages on the rows from ``start`` on, the others unchanged.

    Without ``start`` the ledger tells it: the previewed rows come as the
    preview made them, and only the others run.  If no row is left, all run anew."""
    if start is not None:
        return resume(leads, stages(**kw), resume_start(leads, start))
    if not kw.get("ledger"):
        raise ValueError("give start, or the ledger of the preview")
    apply, at = stages(**kw), resume_start(leads, previewed(leads, kw["ledger"]))
    rest = apply(leads.where(~(F.col("row_id") < at)))
    return apply(leads.where(F.col("row_id") < at)).unionByName(rest, allowMissingColumns=True) if at else rest
