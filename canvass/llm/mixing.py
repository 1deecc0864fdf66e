"""Operator 2: mix sources to target weights by a low-discrepancy schedule.

Every source is shuffled by a hash and cut into blocks of equal numbers of
words.  The schedule has M slots; slot i gets the golden-ratio lattice point
``(i * g) mod M`` (g next to M / phi and coprime to M, so the points are a
permutation of 0..M-1), and the point's place among the cumulative slot
quotas names the source.  A slot's rank among its source's slots names the
block, modulo the source's number of blocks: the second round through a
source is its second epoch.

Targets share all words by weight.  A source's target stops at
``max_epochs`` times its size, and the excess goes to the others by weight.

Defined cases: null or wordless text has size 0 and is never taken; a null
source is a source of its own, sorted last; a null doc_id is an ordinary
value; repeated rows are separate documents; an empty table gives an empty
result; input columns named like an output column are replaced by it.

Scale: one pass writes (source, hash, size) per document.  Totals per
(source, hash bucket) give every bucket its offset in the source's stream, so
a source of any share of the rows is spread over all buckets.  The documents
are shuffled once, by (source, bucket).  Single-task steps hold one row per
source, or per stretch of 65536 slots of one.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stage

GOLDEN = (5 ** 0.5 - 1) / 2
OUTPUT = ("size", "source_size", "target", "taken")


def lattice_step(m: int) -> int:
    """The step next to m / phi that is coprime to m."""
    g = max(1, int(m * GOLDEN))
    while gcd(g, m) != 1:
        g += 1
    return g


def _source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def source_targets(totals: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Add weight and target to one row per source (__src, source, source_size).

    Level filling: with the sources sorted by cap / weight, those before some
    place get their cap and the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("__rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    w = (w.withColumn("weight", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
         .withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size")))
    order = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("__total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
         .withColumn("__free", F.col("__level") * F.col("weight") <= F.col("__cap")))
    level = F.max(F.when(F.col("__free"), F.col("__level"))).over(everything)
    return (w.withColumn("target", F.when(F.col("__free"), level * F.col("weight"))
                         .otherwise(F.col("__cap")))
            .select("__src", "source", "source_size", "weight", "target"))


def schedule(sources: DataFrame, block_words: int, min_blocks: int, max_epochs: int) -> DataFrame:
    """(slot, __src, epoch, block) for every slot, from one row per source."""
    return _schedule(_blocks(sources, block_words, min_blocks, max_epochs))


def _blocks(sources: DataFrame, block_words: int, min_blocks: int, max_epochs: int) -> DataFrame:
    """Block size, number of blocks, slot quota and cumulative quota per source.

    A small source gets smaller blocks, ``min_blocks`` of them, so that half a
    block, the rounding of its quota, is next to nothing.
    """
    size = F.col("source_size")
    per = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {min_blocks}")))
    s = sources.where(size > 0).withColumn("__per", per.cast("long"))
    s = s.withColumn("__n", F.expr("(source_size + __per - 1) div __per"))
    rounds = F.floor(F.col("target") / size).cast("long")
    quota = rounds * F.col("__n") + F.round((F.col("target") - rounds * size) / F.col("__per")).cast("long")
    s = s.withColumn("__quota", F.least(quota, F.lit(max_epochs) * F.col("__n")))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("__low", F.coalesce(F.sum("__quota").over(upto), F.lit(0)))


def _schedule(blocks: DataFrame, chunk: int = 1 << 16, slots_per_task: int = 1 << 20) -> DataFrame:
    m = blocks.agg(F.sum("__quota")).first()[0] or 0
    g = lattice_step(m) if m else 1
    back = pow(g, -1, m) if m > 1 else 0
    # Point p belongs to the slot i with i * g = p (mod M), so i = p * g^-1; the
    # product is exact in decimal(38).  The few rows of a source come from one
    # file, so its stretches are dealt out before they become slots; a given
    # number of parts is never coalesced by the size of these tiny rows.
    points = (blocks.where("__quota > 0")
              .withColumn("__part", F.explode(F.expr(f"sequence(0, (__quota - 1) div {chunk})")))
              .repartition(1 + m // slots_per_task, "__src", "__part")
              .withColumn("__in", F.explode(F.expr(
                  f"sequence(__part * {chunk}, least(__quota, (__part + 1) * {chunk}) - 1)"))))
    slot = F.expr(f"cast(cast((__low + __in) as decimal(19,0)) * cast({back} as decimal(19,0)) "
                  f"% cast({max(m, 1)} as decimal(19,0)) as long)")
    slots = points.select("__src", "__n", slot.alias("slot"))
    # Rank of a slot within its source in two steps: slots of the source in
    # earlier stretches of the schedule, then the place inside the stretch.
    slots = slots.withColumn("__stretch", F.expr(f"slot div {chunk}"))
    counts = slots.groupBy("__src", "__stretch").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy("__src").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__src", "__stretch", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__prior"))
    inside = Window.partitionBy("__src", "__stretch").orderBy("slot")
    ranked = (slots.withColumn("__r", F.row_number().over(inside) - 1)
              .join(counts, ["__src", "__stretch"])
              .withColumn("__r", F.col("__r") + F.col("__prior")))
    return ranked.select("slot", "__src", F.expr("__r div __n").alias("epoch"),
                         F.expr("__r % __n").alias("block"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id", "text"),
        size: str | None = None, weights=(1, 2, 3), max_epochs: int = 3, block_words: int = 8192,
        min_blocks: int = 4096, blocks_per_bucket: int = 32) -> DataFrame:
    """Documents with size, source_size, target and taken (words that the mix takes).

    ``key``: the columns whose hash shuffles a source.  ``size``: a column
    holding the number of words, counted from ``text`` if not given.
    ``blocks_per_bucket``: how many blocks one task-sized bucket holds.
    """
    words = F.col(size) if size else F.regexp_count(F.col(text), F.lit(WORD))
    d = docs.select("*", F.coalesce(words, F.lit(0)).cast("long").alias("__size"),
                    row_key(*[F.col(c) for c in key]).alias("__h"),
                    _source_key(F.col(source)).alias("__src"))
    light = stage(d.select("__src", F.col(source).alias("source"), "__h", "__size"), "mix-sizes")
    totals = light.groupBy("__src", "source").agg(F.sum("__size").alias("source_size"))
    targets = stage(source_targets(totals, weights, max_epochs), "mix-targets")
    sources = stage(_blocks(targets, block_words, min_blocks, max_epochs)
                    .unionByName(targets.where("source_size = 0"), allowMissingColumns=True), "mix-sources")
    filled = sources.where("source_size > 0")
    most = filled.agg(F.max("__n")).first()[0] or 1
    buckets = max(16, 1 << (most // blocks_per_bucket).bit_length())
    bucket = F.pmod(F.shiftrightunsigned(F.col("__h"), 8), F.lit(buckets))

    times = _schedule(filled).groupBy("__src", "block").agg(F.count("*").alias("__times"))
    sums = (light.where("__size > 0").groupBy("__src", bucket.alias("__b"))
            .agg(F.sum("__size").alias("__sum")))
    upto = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    spans = (sums.withColumn("__at", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
             .join(filled.select("__src", "__per"), "__src")
             .withColumn("__first", F.expr("__at div __per"))
             .withColumn("block", F.explode(F.expr("sequence(__first, (__at + __sum - 1) div __per)"))))
    taken_blocks = (spans.join(times, ["__src", "block"], "left")
                    .groupBy("__src", "__b", "__at", "__per", "__first")
                    .agg(F.sort_array(F.collect_list(F.struct(
                        "block", F.coalesce("__times", F.lit(0)).alias("t")))).alias("__ts"))
                    .withColumn("__ts", F.expr("transform(__ts, x -> x.t)")))
    plan = stage(taken_blocks, "mix-blocks")

    own = [c for c in docs.columns if c not in OUTPUT]
    run = (Window.partitionBy("__src", "__b").orderBy("__h", "__size")
           .rowsBetween(Window.unboundedPreceding, -1))
    placed = (d.select(*own, "__size", "__h", "__src", bucket.alias("__b"))
              .join(plan, ["__src", "__b"], "left")
              .withColumn("__s", F.col("__at") + F.coalesce(F.sum("__size").over(run), F.lit(0))))
    taken = F.expr("""aggregate(
        sequence(__s div __per, (__s + __size - 1) div __per), 0L,
        (acc, b) -> acc + element_at(__ts, cast(b - __first + 1 as int))
                   * (least(__s + __size, (b + 1) * __per) - greatest(__s, b * __per)))""")
    return (placed.withColumn("taken", F.when(F.col("__size") > 0, taken).otherwise(F.lit(0)).cast("long"))
            .join(sources.select("__src", "source_size", "target"), "__src")
            .select(*own, F.col("__size").alias("size"), "source_size", "target", "taken"))
