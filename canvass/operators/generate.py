"""Prompt rendering and text generation with a user-supplied batch function.

Rendering is a JVM-side ``concat`` (see ``functions.template``).  The
generator is the one Python stage of the library: rows that still need a
text go through ``mapInPandas`` in Arrow batches; rows that are done never
leave the JVM.  ``fn`` gets ``batch_rows`` prompts a call and no prompt twice:
a call that raises fails the rows of that call, and a call may return an
exception in place of a text to fail one row.

``fn(prompts: pandas.Series) -> sequence of str or Exception`` -- e.g. a
client for a hosted model.  Results are stripped; failures become
``'Error: LLM error: <first 100 chars of the exception>'``.

With a ``journal`` folder no answered prompt is ever sent again.  Rows are
reduced to distinct prompts; those the journal answers are joined, not called.
A task writes the answers of each call to a file of its own partition before it
makes the next call; an attempt that repeats the partition after a failure
reads them first.  When the job is done its answers are one table of the
journal, and the small files go.  A run that is stopped leaves its files, which
the next run reads.  Failures are not journaled: the next run retries them.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import DEFAULT_TEMPLATE, render_prompt
from ..functions.text import is_blank
from ..sources import files
from .columns import ensure_columns
from .skew import skew_safe_join

ERROR_PREFIX = "Error: "
LLM_ERROR = "LLM error: "


def needs_text(retry_errors: bool = False, col: str = "generated_email") -> Column:
    """Rows without a text; with ``retry_errors`` also rows whose stored text
    starts with 'Error'."""
    pending = is_blank(col)
    if retry_errors:
        pending = pending | F.coalesce(F.col(col).startswith("Error"), F.lit(False))
    return pending


def with_prompts(leads: DataFrame, template: str = DEFAULT_TEMPLATE,
                 product_description: str = "", col: str = "prompt") -> DataFrame:
    return leads.withColumn(col, render_prompt(template, product_description, leads.columns))


def _ship_by_value(module) -> None:
    """Pickle ``module``'s functions by value so Python workers need not have
    it installed (this package; a caller's own module).  Installed
    libraries and ``__main__`` are left to the normal by-reference path."""
    path = getattr(module, "__file__", None) or ""
    if module is None or not path or "site-packages" in path or "dist-packages" in path:
        return
    cloudpickle.register_pickle_by_value(module)


def _error_text(exc: BaseException) -> str:
    return ERROR_PREFIX + LLM_ERROR + str(exc)[:100]


def _call(fn, prompts: pd.Series) -> list[str]:
    try:
        out = list(fn(prompts))
        if len(out) != len(prompts):
            raise ValueError(f"generator returned {len(out)} texts for {len(prompts)} prompts")
    except Exception as e:  # a failed call never stops the job
        return [_error_text(e)] * len(prompts)
    return [_finish(v) for v in out]


def _finish(v) -> str:
    if v is None:
        v = ValueError("empty response")
    return _error_text(v) if isinstance(v, BaseException) else str(v).strip()


def _tasks(spark) -> int:
    """Tasks of a shuffle; asked for by number, they are not merged for being small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def generate(leads: DataFrame, fn, template: str = DEFAULT_TEMPLATE,
             product_description: str = "", retry_errors: bool = False,
             col: str = "generated_email", batch_rows: int = 1,
             partitions: int | None = None, journal: str | None = None) -> DataFrame:
    """``leads`` with ``col`` filled for pending rows (others unchanged).

    ``batch_rows``: prompts per call of ``fn``.  ``partitions``: spreads the
    pending rows over so many tasks, which is also the most calls in flight;
    without it over as many as a shuffle has, as the work is in the calls and
    not in the bytes that files are split by.  Lazy, and every action runs
    ``fn`` again: write the result once before sorting or reusing it.

    ``journal``: a shared folder of answers by prompt.  The calls then run at
    once, as one job over the distinct prompts the journal does not answer,
    and the result only joins answers.
    """
    render_prompt(template, product_description, leads.columns)  # fail before any row runs
    leads = ensure_columns(leads, {col: ("string", "")})
    cols = leads.columns
    pending = needs_text(retry_errors, col)
    done = leads.where(~pending)
    todo = leads.where(pending)
    if partitions or not journal:  # with a journal ``answer`` spreads the distinct prompts
        todo = todo.repartition(partitions or _tasks(leads.sparkSession))
    todo = todo.withColumn("_prompt", render_prompt(template, product_description, cols))
    schema = leads.schema
    _ship_by_value(sys.modules[__name__.split(".")[0]])
    _ship_by_value(sys.modules.get(getattr(fn, "__module__", None) or ""))
    if journal:
        keyed = todo.withColumn("_hash", F.sha2("_prompt", 256))
        answers = answer(keyed.select("_hash", "_prompt"), fn, journal, batch_rows, partitions)
        filled = skew_safe_join(keyed.drop(col, "_prompt"), answers.withColumnRenamed("_text", col), ["_hash"], "left")
        return done.unionByName(filled.select(*cols))

    def run(batches):
        for pdf in batches:
            prompts = pdf["_prompt"]
            pdf[col] = [text for at in range(0, len(prompts), batch_rows)
                        for text in _call(fn, prompts.iloc[at:at + batch_rows])]
            yield pdf[cols]

    return done.unionByName(todo.mapInPandas(run, schema))


ANSWER = "_hash string, _text string"


class Calls:
    """The answers of one partition of a job, written call by call; runs inside a task."""

    def __init__(self, folder: str, attempt: str):
        self.store, root = arrow_fs.FileSystem.from_uri(folder)
        self.root, self.attempt, self.made = root, attempt, 0
        self.store.create_dir(root, recursive=True)

    def answered(self) -> dict[str, str]:
        """What earlier attempts at this partition were told."""
        out = {}
        for info in self.store.get_file_info(arrow_fs.FileSelector(self.root)):
            if info.base_name.endswith(".json"):
                with self.store.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        entry = json.loads(line)
                        out[entry["_hash"]] = entry["_text"]
        return out

    def add(self, answers: list[tuple[str, str]]) -> None:
        """One file a call, under its name only when whole: a half-written one is never read."""
        lines = "".join(json.dumps({"_hash": h, "_text": t}) + "\n" for h, t in answers)
        name = f"{self.root}/{self.attempt}-{self.made:08}"
        self.made += 1
        with self.store.open_output_stream(name + ".part") as f:
            f.write(lines.encode())
        self.store.move(name + ".part", name + ".json")


def journaled(spark, journal: str) -> DataFrame:
    """(``_hash``, ``_text``) of every answer in the journal, one per prompt."""
    tables = [n for n in files.names(spark, journal) if n.startswith("answers-")]
    found = spark.createDataFrame([], ANSWER)
    for n in tables:
        found = found.unionByName(spark.read.schema(ANSWER).parquet(f"{journal}/{n}"))
    if any(n.startswith("calls-") for n in files.names(spark, journal)):
        calls = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        found = found.unionByName(calls.json(f"{journal}/calls-*"))
    return found.groupBy("_hash").agg(F.min("_text").alias("_text"))


def answer(prompts: DataFrame, fn, journal: str, batch_rows: int = 1, partitions: int | None = None) -> DataFrame:
    """(``_hash``, ``_text``) of every prompt of (``_hash``, ``_prompt``), calling ``fn`` for those not journaled."""
    spark = prompts.sparkSession
    journal = files.qualified(spark, journal.rstrip("/"))
    run = uuid.uuid4().hex
    arrow_fs.FileSystem.from_uri(journal)  # tasks write there themselves: fail before any call if they cannot
    files.make_dir(spark, journal)
    known = journaled(spark, journal)
    wanted = prompts.groupBy("_hash").agg(F.min("_prompt").alias("_prompt"))
    missing = skew_safe_join(wanted, known.select("_hash"), ["_hash"], "left_anti")
    missing = missing.repartition(partitions or _tasks(spark), "_hash")
    # A partition must hold the same prompts again when it is repeated, so their order is fixed.
    missing = missing.sortWithinPartitions("_hash")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        calls = earlier = None
        for pdf in batches:
            if calls is None:
                calls = Calls(f"{journal}/calls-{run}/{context.partitionId()}", str(context.taskAttemptId()))
                earlier = calls.answered()
            texts = {h: earlier[h] for h in pdf["_hash"] if h in earlier}
            rest = pdf[~pdf["_hash"].isin(texts)]
            for at in range(0, len(rest), batch_rows):
                some = rest.iloc[at:at + batch_rows]
                got = list(zip(some["_hash"], _call(fn, some["_prompt"])))
                texts.update(got)
                told = [(h, t) for h, t in got if not t.startswith(ERROR_PREFIX + LLM_ERROR)]
                if told:
                    calls.add(told)
            yield pd.DataFrame({"_hash": pdf["_hash"], "_text": [texts[h] for h in pdf["_hash"]]})

    staged = f"{journal}/run-{run}"
    missing.mapInPandas(ask, ANSWER).write.parquet(staged)
    fresh = spark.read.schema(ANSWER).parquet(staged)
    failed = F.col("_text").startswith(ERROR_PREFIX + LLM_ERROR)
    if files.exists(spark, f"{journal}/calls-{run}"):
        # All answers of the job are in its table now; the files of its calls can go.
        fresh.where(~failed).write.parquet(f"{journal}/answers-{run}")
        files.delete(spark, f"{journal}/calls-{run}")
    return journaled(spark, journal).unionByName(fresh.where(failed))


def upper_generator(prompts: pd.Series) -> list[str]:
    """Deterministic stand-in generator (upper-cases the prompt).  Rows whose
    prompt has no company name fail, to exercise per-row error handling."""
    texts = prompts.tolist()  # a call has few prompts: pandas' own string methods cost more than the work
    if any(isinstance(t, str) and "Business name: N/A" in t for t in texts):
        raise ValueError("no company name")
    return [t.upper() if isinstance(t, str) else None for t in texts]
