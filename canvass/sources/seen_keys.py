"""Which keys does a parquet dataset hold?  A persisted index of Bloom filters and key files.

An append asks this of a table that may be a million times its size.  The index
lives in the dataset's folder, under ``_keys/<rule>``, as entries that are
written once.  An entry covers some data files and has

* ``files``: path, length and modification time of the files it covers;
* ``keys``: their distinct keys, dealt into parts by the top bits of a hash;
* ``bits``: a blocked Bloom filter of the keys, one row (block, 64 bits) for
  about four keys, made by ``bit_or``.

``sync`` brings the index in line with the folder: data files that no entry
covers are read (the key columns only) and get an entry, and an entry of which
a file is gone or was replaced is dropped and its other files are read again.
The index is thus never trusted beyond the files it names: appends by other
programs, a first use on an old table, deleted files and a driver that dies
between two steps all end in the same, whole index.

``known`` joins the distinct keys of a batch with the filter rows on (size,
block), an equi-join of short rows.  Only keys that the filter flags are looked
up, and only in the parts they fall into; the comparison there is of the keys
themselves, so a false alarm costs a read and never a row.  The driver sees
names of entries, parts and newly written files.

Entries of about one size are merged once there are ``fan`` of them, so their
number grows with the logarithm of the table and a key is rewritten as often.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.append import KEYS, existing_keys
from ..session import scratch_path
from . import files

#: Keys a 64-bit block holds on average at most, and bits set for each key.
KEYS_A_BLOCK, BITS_A_KEY = 4, 5


def _hash(on: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in on])


def _mask(on: list[str]) -> Column:
    """A word with up to ``BITS_A_KEY`` bits set, by a hash of its own."""
    h = _hash(on, 1)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(BITS_A_KEY)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(on: list[str], level: Column) -> Column:
    """The lowest ``level`` bits of the key's hash."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - F.lit(1).cast("long")
    return _hash(on, 0).bitwiseAND(mask)


def _part(on: list[str], bits: Column) -> Column:
    """The highest ``bits`` bits of the key's hash."""
    shifted = F.call_function("shiftrightunsigned", _hash(on, 0), F.lit(64) - bits)
    return F.when(bits > 0, shifted).otherwise(F.lit(0).cast("long"))


class SeenKeys:
    """The key index of the dataset at ``path`` under one dedup rule.

    ``part_keys``: keys a part holds on average at most; ``fan``: entries of
    about one size that are merged.  Both move work, never results.
    """

    def __init__(self, spark: SparkSession, path: str, rule: str, part_keys: int = 2_000_000, fan: int = 8):
        self.spark, self.path, self.rule = spark, files.qualified(spark, path).rstrip("/"), rule
        self.home, self.on = f"{self.path}/_keys/{rule}", KEYS[rule]
        self.part_keys, self.fan = part_keys, fan

    # ---- entries ----

    def entries(self) -> list[str]:
        """Names of the whole entries; a name is ``entry-<level>-<part bits>-<id>``."""
        return [n for n in files.names(self.spark, self.home)
                if n.startswith("entry-") and files.exists(self.spark, f"{self.home}/{n}/_whole")]

    def _read(self, entries: list[str], what: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.home}/{e}/{what}" for e in entries])

    def _drop(self, entries: list[str]) -> None:
        for e in entries:
            files.delete(self.spark, f"{self.home}/{e}")

    def _data_files(self) -> DataFrame:
        """Data files of the dataset, listed by Spark; no content is read."""
        return (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet").load(self.path)
                .select("path", "length", F.col("modificationTime").alias("modified")))

    def _add(self, keys: DataFrame, covered: DataFrame) -> None:
        """A new entry; without its last file it does not count."""
        scratch = scratch_path(self.spark, f"seen-keys-{uuid.uuid4().hex}")
        keys.distinct().write.parquet(scratch)
        keys = self.spark.read.schema(keys.schema).parquet(scratch)
        n = keys.count()   # from the footers of the written files
        level = max(0, (max(1, -(-n // KEYS_A_BLOCK)) - 1).bit_length())
        bits = max(0, (max(1, -(-n // self.part_keys)) - 1).bit_length())
        name = f"entry-{level}-{bits}-{uuid.uuid4().hex}"
        at = f"{self.home}/{name}"
        covered.select("path", "length", "modified", F.lit(name).alias("entry")).write.parquet(f"{at}/files")
        (keys.withColumn("part", _part(self.on, F.lit(bits))).repartition(1 << bits, "part")
         .write.partitionBy("part").parquet(f"{at}/keys"))
        (keys.select(_block(self.on, F.lit(level)).alias("block"), _mask(self.on).alias("bits"))
         .groupBy("block").agg(F.bit_or("bits").alias("bits"))
         .select(F.lit(name).alias("entry"), F.lit(level).alias("level"), F.lit(bits).alias("part_bits"), "block", "bits")
         .write.parquet(f"{at}/bits"))
        files.touch(self.spark, f"{at}/_whole")
        files.delete(self.spark, scratch)

    # ---- upkeep ----

    def sync(self, current: DataFrame) -> None:
        """Bring the index in line with the data files; ``current`` gives the dataset's columns."""
        now = self._data_files()   # listed before the files are read: a later file is not covered
        identity = ["path", "length", "modified"]
        entries = self.entries()
        if entries:
            covered = self._read(entries, "files")
            gone = {r["entry"] for r in covered.join(now, identity, "left_anti").select("entry").distinct().collect()}
            self._drop(sorted(gone))
            entries = [e for e in entries if e not in gone]
        if entries:
            now = now.join(self._read(entries, "files"), identity, "left_anti")
            paths = [r["path"] for r in now.select("path").collect()]
            if not paths:
                return
            fresh = (self.spark.read.schema(current.schema).option("basePath", self.path).parquet(*paths))
        else:
            fresh = current
        self._add(existing_keys(fresh, self.rule), now)
        self._merge()

    def _merge(self) -> None:
        by_size: dict[int, list[str]] = {}
        for e in self.entries():
            by_size.setdefault(int(e.split("-")[1]) // 3, []).append(e)
        for same in by_size.values():
            if len(same) >= self.fan:
                self._add(self._read_keys(same), self._read(same, "files").drop("entry").distinct())
                self._drop(same)

    def _read_keys(self, entries: list[str], parts: dict[str, list[int]] | None = None) -> DataFrame:
        """Keys of the entries, or of some of their parts."""
        paths = []
        for e in entries:
            held = [n for n in files.names(self.spark, f"{self.home}/{e}/keys") if n.startswith("part=")]
            paths += [f"{self.home}/{e}/keys/{n}" for n in held
                      if parts is None or int(n.split("=")[1]) in parts[e]]
        schema = ", ".join(f"{c} string" for c in self.on)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # ---- lookup ----

    def flagged(self, keys: DataFrame) -> DataFrame:
        """(key columns, entry, part): the distinct ``keys`` that a filter flags, with where to look."""
        entries = self.entries()
        levels = sorted({int(e.split("-")[1]) for e in entries})
        probe = (keys.select(*self.on).distinct()
                 .withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
                 .select("*", _block(self.on, F.col("level")).alias("block"), _mask(self.on).alias("mask")))
        hit = probe.join(self._read(entries, "bits"), ["level", "block"])
        return (hit.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
                .select(*self.on, "entry", _part(self.on, F.col("part_bits")).alias("part")))

    def known(self, keys: DataFrame) -> DataFrame:
        """The distinct ones of ``keys`` that the dataset holds."""
        staged = scratch_path(self.spark, f"flagged-{uuid.uuid4().hex}")
        self.flagged(keys).write.parquet(staged)
        flagged = self.spark.read.parquet(staged)
        where: dict[str, list[int]] = {}
        for r in flagged.select("entry", "part").distinct().collect():   # at most one row per part file
            where.setdefault(r["entry"], []).append(r["part"])
        return flagged.select(*self.on).distinct().join(self._read_keys(sorted(where), where), self.on, "left_semi")
