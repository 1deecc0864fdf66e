"""A training corpus from ``documents`` in five stages.

Language ID -> line dedup -> n-gram Jaccard join -> benchmark decontamination
-> mixing to target weights.  Every stage works on all rows that the stage
before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import stage, table
from canvass.llm.decontaminate import decontaminate
from canvass.llm.langid import identify, train
from canvass.llm.lines import line_dedup
from canvass.llm.mixing import mix
from canvass.llm.setjoin import jaccard_components, key_of


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; a missing ``lang`` gets the prediction."""
    found = identify(docs, train(docs)).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten sources or more share."""
    cut = line_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    first = (jaccard_components(docs, width=5, percent=80).where(F.col("row_key") == F.col("first_key"))
             .select("row_key").distinct())
    keyed = docs.withColumn("row_key", key_of(F.col("doc_id"), F.col("text")))
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken."""
    return mix(docs).where("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", lines), ("jaccard_join", near_duplicates),
          ("decontaminate", without_benchmark), ("mix_sources", mixed)]

#: Compression and the join's shuffled order have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
