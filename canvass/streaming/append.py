"""Incremental append as a stream: new lead batches land in a lead table
without re-adding leads it already holds, each batch exactly once.

*Which rows are new* is kept in the state store, one entry per key seen: a row
passes if no earlier batch and not the table at the first start held its key
(rows of one batch are not deduplicated against each other, as in a batch
append).  The keys run through ``dropDuplicates``, which lets a key pass in the
batch that meets it first, and the rows run beside them; a batch is written as
it comes, and its rows are joined with its new keys.  The table's own keys enter
the state once, from a snapshot written beside the checkpoint, so a batch costs
what its own rows cost and the table is never read again.  In the first batch
the snapshot's keys come together with the stream's and are taken off by a join.
RocksDB holds the state, so it may outgrow memory.

*That a batch lands once* is kept in a ledger inside the table's folder.  A batch
is written to a hidden staging folder, its files are then moved into the table
under their unique names, and a marker records the batch.  A batch that Spark
replays after a failure is skipped if its marker is there, and resumes the
moves if its staging is whole, so nothing is added twice: not rows with blank
keys, which have no entry of their own, nor any row under the rule 'none'.

Blank keys (no URL; no name and address) can be many, so they stay out of the
keyed shuffle: they pass until a batch that held one has been appended, which
a marker in the ledger records.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import match_key, strip
from ..operators.append import NAME_ALIASES, dedup_rule
from ..operators.columns import resolve_columns
from ..operators.skew import skew_safe_join
from ..session import scratch_path
from ..sources import files
from ..sources.leads_io import read_dataset

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ledger:
    """Batches of one streaming query that a table has taken in, and those on their way."""

    def __init__(self, spark: SparkSession, target: str, query: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.home = f"{self.target}/_appends/{hashlib.sha1(query.encode()).hexdigest()[:16]}"

    def _marks(self, kind: str) -> list[int]:
        return [int(n.split(".")[1]) for n in files.names(self.spark, self.home) if n.startswith(kind + ".")]

    def staging(self, batch: int) -> str:
        return f"{self.home}/batch.{batch}"

    def arrived(self, batch: int) -> str:
        """Where a batch is written as it comes, its keys beside its rows."""
        return f"{self.home}/arrived.{batch}"

    def taken(self, batch: int) -> bool:
        return max(self._marks("done"), default=-1) >= batch

    def staged(self, batch: int) -> bool:
        """Spark writes _SUCCESS when all tasks of the write are committed."""
        return files.exists(self.spark, self.staging(batch) + "/_SUCCESS")

    def blank_before(self, batch: int) -> bool:
        """Whether the table held a blank key before ``batch`` (-1: before the first)."""
        return min(self._marks("blank"), default=batch) < batch

    def note_blank(self, batch: int) -> None:
        if not self._marks("blank"):
            files.touch(self.spark, f"{self.home}/blank.{batch}")

    def publish(self, batch: int) -> None:
        """Move what is staged into the table; safe to repeat from any point."""
        folder = self.staging(batch)
        for name in files.names(self.spark, folder):
            if not name.startswith(("_", ".")):
                files.move(self.spark, f"{folder}/{name}", f"{self.target}/{name}")
        older = [n for n in files.names(self.spark, self.home) if n.startswith("done.")]
        files.touch(self.spark, f"{self.home}/done.{batch}")
        for n in older:
            if n != f"done.{batch}":
                files.delete(self.spark, f"{self.home}/{n}")
        files.delete(self.spark, folder)
        files.delete(self.spark, self.arrived(batch))


def _keys(columns: list[str], rule: str) -> tuple[Column, Column]:
    """(key, whether a row with a blank key counts as holding one once it is in the table)."""
    if rule == "url":
        return strip(F.coalesce(F.col("maps_url").cast("string"), F.lit(""))), F.col("maps_url").isNotNull()
    found = resolve_columns(columns, NAME_ALIASES)
    name, addr = match_key(found["company_name"]), match_key(found["company_address"])
    return F.when((name == "") & (addr == ""), F.lit("")).otherwise(F.concat(name, F.lit("\x00"), addr)), F.lit(True)


def _snapshot(spark: SparkSession, ledger: Ledger, target: str, columns: list[str], by: str, checkpoint: str) -> tuple[str, str]:
    """(rule, folder of the keys the table held at the first start); written once, read at every restart."""
    seed = checkpoint.rstrip("/") + "-seed"
    if not files.exists(spark, seed + "/_SUCCESS"):
        current = read_dataset(spark, target)
        rule = by if by != "auto" else dedup_rule(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
                                                  if current is None else current)
        keys = spark.createDataFrame([], "_k string")
        if current is not None and rule != "none":
            key, holds = _keys(current.columns, rule)
            keyed = current.select(key.alias("_k"), holds.alias("_holds"))
            if keyed.where((F.col("_k") == "") & F.col("_holds")).limit(1).count():
                ledger.note_blank(-1)
            keys = keyed.where(F.col("_k") != "").select("_k").distinct()
        # One more row names the rule, so that a restart does not decide it anew from a table that has grown.
        marker = spark.createDataFrame([(None, rule)], "_k string, _rule string")
        (keys.withColumn("_rule", F.lit(None).cast("string")).unionByName(marker)
         .write.mode("overwrite").parquet(seed))
    rule = spark.read.parquet(seed).where("_rule is not null").first()["_rule"]
    return rule, seed


def met_keys(stream: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows of ``stream`` (with ``_k``), and beside them a row (``_met``, no other value than ``_k``) for each key
    that no earlier batch held; those of ``seed`` are among them in the batch that they come in."""
    keys = stream.select("_k").unionByName(seed.where("_k is not null").select("_k")).dropDuplicates(["_k"])
    return stream.withColumn("_met", F.lit(False)).unionByName(keys.withColumn("_met", F.lit(True)), allowMissingColumns=True)


def new_rows(arrived: DataFrame, seed: DataFrame | None) -> DataFrame:
    """The rows of a batch whose key is new or blank, with ``_k``; ``seed``: keys that came in the same batch."""
    rows, keys = arrived.where(~F.col("_met")).drop("_met"), arrived.where("_met").select("_k")
    if seed is not None:
        keys = keys.join(seed, "_k", "left_anti")
    blank = F.col("_k") == ""
    return skew_safe_join(rows.where(~blank), keys, ["_k"], "left_semi").select(*rows.columns).unionByName(rows.where(blank))


def stream_append(stream: DataFrame, target_path: str, by: str = "auto",
                  checkpoint: str | None = None, available_now: bool = False,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start the streaming append; returns the running query.

    ``by``: 'url', 'name_address', 'none', or 'auto', which the table's (else the
    stream's) columns decide at the first start.  To go on after a stop, pass
    the same ``checkpoint``.  Nothing else may append keys meanwhile: the state
    would not know of them."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"stream-append-{uuid.uuid4().hex}")
    ledger = Ledger(spark, target_path, files.qualified(spark, checkpoint))
    files.make_dir(spark, ledger.home)
    rule, seed = _snapshot(spark, ledger, target_path, stream.columns, by, checkpoint)
    columns, schema = stream.columns, stream.schema
    if rule == "none":
        rows = stream.withColumn("_k", F.lit("-"))
    else:
        keyed = stream.withColumn("_k", _keys(columns, rule)[0])
        seen = spark.readStream.schema("_k string, _rule string").parquet(seed)
        rows = met_keys(keyed.where(F.col("_k") != ""), seen).unionByName(
            keyed.where(F.col("_k") == "").withColumn("_met", F.lit(False)))

    def of_new_keys(batch: DataFrame, epoch_id: int) -> DataFrame:
        if rule == "none":
            return batch
        # Written first: a batch that is read twice would run its state twice.
        batch.write.mode("overwrite").parquet(ledger.arrived(epoch_id))
        known = spark.read.schema("_k string").parquet(seed).where("_k is not null") if epoch_id == 0 else None
        kept = new_rows(spark.read.schema(batch.schema).parquet(ledger.arrived(epoch_id)), known)
        return kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # even files, a hot key or not

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        folder = ledger.staging(epoch_id)
        if ledger.taken(epoch_id) or ledger.staged(epoch_id):
            # A replay: its rows are in the table or on their way, but the state has still to move past it.
            batch.write.format("noop").mode("overwrite").save()
        if ledger.taken(epoch_id):
            return
        if not ledger.staged(epoch_id):
            kept = of_new_keys(batch, epoch_id)
            if ledger.blank_before(epoch_id):
                kept = kept.where(F.col("_k") != "")
            kept.drop("_k").write.mode("overwrite").parquet(folder)
        if rule != "none" and not ledger.blank_before(epoch_id):
            # From the staged rows, before any file moves: a replay after a failure here finds them again.
            key, holds = _keys(columns, rule)
            if spark.read.schema(schema).parquet(folder).where((key == "") & holds).limit(1).count():
                ledger.note_blank(epoch_id)
        ledger.publish(epoch_id)

    w = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    provider = spark.conf.get(PROVIDER, None)
    if provider and provider != HEAP:
        return w.start()
    spark.conf.set(PROVIDER, ROCKSDB)  # a running query keeps the settings it was started with
    try:
        return w.start()
    finally:
        spark.conf.set(PROVIDER, provider) if provider else spark.conf.unset(PROVIDER)
