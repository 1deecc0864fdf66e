"""Spelling-tolerant place lookup: the nearest name within ``k`` edits at the same address.

Candidates come from a *segment index*.  A catalogue name is cut into k + 1
segments; for any name within k edits of it there is a segment i that the
edits leave whole, with at most i edits before it and k - i after it (the
first i at which the edits of the segments up to i number at most i).  So a
lead name, for each length that k edits can lead to, probes the few substrings
that can be that segment, and an equi-join on (address, length, i, segment)
finds every pair within k edits.  ``levenshtein`` then decides each pair.

Names of one address often share a segment ('dental', or 'customer#' in a
generated table; a blank address holds names of everywhere).  Addresses of more
than ``crowd`` names are therefore searched in memory (``spelling``): the names
and leads of an address are cut into parts of about ``CELL`` characters, and a
task takes the cell of one part of each.  So a name is shuffled once for each part of the leads
of its address, a lead once for each part of the names, and never for a variant
of its spelling.  ``crowd`` and ``CELL`` move work, never results.

``candidates`` alone serves addresses of any size: it refines a segment that more
than its own ``crowd`` names share.  The key then also takes the text before
the segment with up to i characters deleted and the text after it with up to
k - i deleted.  Two texts within d edits share such a variant, so the refined join
is exact too, and the names it brings together are at most 2k edits apart.  As
variants are many (up to 1,350 of an 18-letter name at k = 3), what is shuffled for one
is a hash of the key and the name; keys of equal hash only make a pair more to be decided.

Each distinct (name, address) is looked up once, and only if the catalogue
does not hold it.  The best candidate per key is a partial-aggregating
``min(struct)``; leads then meet their key's answer in one skew-safe join.
"""

from __future__ import annotations

import sys
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generate import _ship_by_value, _tasks
from .lookup import KEY_COLS, PLACE_PAYLOAD, with_key
from .skew import skew_safe_join
from .spelling import searcher

MAX_EDITS = 3
CELL = 1 << 22  # characters of an address's names, and of its leads, that one task searches


def deletion_variants(c: Column, d: int) -> Column:
    """Distinct texts that ``c`` becomes by deleting up to ``d`` characters."""
    out = F.array(c)
    for _ in range(d):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda v: F.when(
            F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(
                v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))))).otherwise(F.array().cast("array<string>"))))))
    return out


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """0-based start and length of segment i of k + 1: the last ``length mod (k + 1)`` are longer by one."""
    base, short = F.floor(length / (k + 1)).cast("int"), F.lit(k + 1) - length % (k + 1)
    return base * i + F.greatest(F.lit(0), F.lit(i) - short), base + (F.lit(i) >= short).cast("int")


def _piece(name: Column, length: Column, i: int, size: Column, start: Column) -> Column:
    """Segment i of a name of ``length``, as it stands at ``start``: a hash of what it must share, and where it is."""
    shared = F.xxhash64(F.col("_ka"), length, F.lit(i), name.substr(start + 1, size))
    return F.struct(shared.alias("_b"), F.lit(i).alias("_i"), start.alias("_at"), size.alias("_size"))


def index_segments(names: DataFrame, k: int) -> DataFrame:
    """A row per name and segment: ``_b`` (hash of address, length, i, segment), the segment's place, the name."""
    name, length = F.col("_kn"), F.length("_kn")
    pieces = []
    for i in range(k + 1):
        start, size = _segment(length, i, k)
        pieces.append(_piece(name, length, i, size, start))
    return names.select(F.explode(F.array(*pieces)).alias("_p"), F.col("_kn").alias("_ckn")).select("_p.*", "_ckn")


def probe_segments(leads: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """A row per name, length of a name within k edits that its address has, and place that a segment of it can stand at."""
    held = names.groupBy("_ka").agg(F.collect_set(F.length("_kn")).alias("_lens"))
    leads = skew_safe_join(leads, held, ["_ka"], "inner")
    name, length = F.col("_kn"), F.col("_len")
    own = F.length(name)
    none = F.array().cast("array<struct<_b:bigint,_i:int,_at:int,_size:int>>")
    pieces = []
    for i in range(k + 1):
        start, size = _segment(length, i, k)
        longer = own - length
        low = F.greatest(start - i, start + longer - (k - i), F.lit(0))
        high = F.least(start + i, start + longer + (k - i), own - size)
        pieces.append(F.when(low <= high, F.transform(F.sequence(low, high), partial(_piece, name, length, i, size))).otherwise(none))
    lengths = F.filter("_lens", lambda n: (n > 0) & (F.abs(n - own) <= k))
    return (leads.select("_kn", "_ka", F.explode(lengths).alias("_len"))
            .select("_kn", "_ka", F.explode(F.flatten(F.array(*pieces))).alias("_p"))
            .select("_kn", "_ka", "_p.*"))


def _keyed(segments: DataFrame, crowded: DataFrame | None, k: int, col: str) -> DataFrame:
    """``segments`` with their join key ``_h``; those of a crowded segment once for each pair of variants of the texts around it."""
    if crowded is None:
        return segments.withColumnRenamed("_b", "_h").drop("_i", "_at", "_size")
    name = F.col(col)

    def variants(text: Column, edits) -> Column:
        out = F.when(F.col("_crowded").isNull(), F.array(F.lit("")))
        for i in range(k + 1):
            out = out.when(F.col("_i") == i, deletion_variants(text, edits(i)))
        return out

    marked = skew_safe_join(segments, crowded.withColumn("_crowded", F.lit(True)), ["_b"], "left")
    return (marked.withColumn("_lv", F.explode(variants(name.substr(F.lit(1), F.col("_at")), lambda i: i)))
            .withColumn("_rv", F.explode(variants(name.substr(F.col("_at") + F.col("_size") + 1, F.length(name)), lambda i: k - i)))
            .withColumn("_h", F.when(F.col("_crowded"), F.xxhash64("_b", "_lv", "_rv")).otherwise(F.col("_b")))
            .drop("_b", "_i", "_at", "_size", "_crowded", "_lv", "_rv"))


def candidates(leads: DataFrame, names: DataFrame, k: int, crowd: int | None = 64) -> DataFrame:
    """(``_kn``, ``_ka``, ``_ckn``) pairs, repeats included: all within k edits at one address are among them.

    ``crowd`` None refines no segment: for addresses of few names."""
    index = index_segments(names, k)
    # A merge join by hint: planned from the few rows that they are made of, the variants of one side would be broadcast.
    # Counts leave the map tasks as partial sums: a crowded segment is a row per task.
    crowded = None if crowd is None else index.groupBy("_b").count().where(F.col("count") > crowd).select("_b")
    return (_keyed(probe_segments(leads, names, k), crowded, k, "_kn")
            .join(_keyed(index, crowded, k, "_ckn").hint("merge"), "_h").select("_kn", "_ka", "_ckn"))


def nearest(keys: DataFrame, catalogue: DataFrame, max_distance: int, payload=PLACE_PAYLOAD,
            crowd: int = 64) -> DataFrame:
    """One row per (``_kn``, ``_ka``) of ``keys`` that has a place within
    ``max_distance`` edits: the payload of the best one (fewest edits, most
    reviews, least place id), ``matched_name`` and ``distance``.

    ``catalogue`` must be one row per key (``lookup.catalogue_by_key``).  A
    blank name is not looked up and never found; addresses must be equal.
    """
    if not 0 <= max_distance <= MAX_EDITS:
        raise ValueError(f"max_distance must be 0 to {MAX_EDITS}")
    payload = list(payload)
    wanted = keys.where(F.col("_kn") != "").select(*KEY_COLS).distinct()
    cat = catalogue.where(F.col("_kn") != "").select(*KEY_COLS, *payload)
    exact = wanted.join(cat, KEY_COLS).select(
        *KEY_COLS, *payload, F.col("_kn").alias("matched_name"), F.lit(0).alias("distance"))
    if not max_distance:
        return exact
    parts = F.ceil(F.sum(F.length("_kn") + 1) / CELL)
    held = (cat.groupBy("_ka").agg(F.count("*").alias("_names"), parts.alias("_nparts"))
            .join(wanted.groupBy("_ka").agg(parts.alias("_lparts")), "_ka"))
    left = skew_safe_join(wanted.join(cat.select(*KEY_COLS), KEY_COLS, "left_anti"), held, ["_ka"], "inner")
    names = skew_safe_join(cat.select(*KEY_COLS, *_rank()), held, ["_ka"], "inner")
    few = F.col("_names") <= crowd
    near = (_near_by_segments(left.where(few).select(*KEY_COLS), names.where(few).select(*KEY_COLS), max_distance)
            .unionByName(_near_in_memory(left.where(~few), names.where(~few), max_distance)))
    return exact.unionByName(_best(near, cat, payload))


def _rank() -> list[Column]:
    """Of equally near places the one least in these is the best."""
    return [F.col("review_count").isNull().alias("_rn"), (-F.col("review_count")).alias("_rc"), F.col("place_id").alias("_pid")]


def _near_by_segments(leads: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(``_kn``, ``_ka``, ``_ckn``, ``distance``) of all names within ``k`` edits, for addresses of few names."""
    pairs = (candidates(leads, names, k, None)
             .withColumn("distance", F.levenshtein("_kn", "_ckn", k))
             .where(F.col("distance") >= 0))
    return pairs.groupBy(*KEY_COLS, "_ckn").agg(F.min("distance").alias("distance"))


def _near_in_memory(leads: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(``_kn``, ``_ka``, ``_ckn``, ``distance``) of the best name of each cell that has one within ``k`` edits of the lead."""
    part = F.xxhash64("_kn")

    def cells(df: DataFrame, own: Column, others: Column, of_lead: bool) -> DataFrame:
        every = df.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
        at = [F.pmod(part, own), F.col("_other")]
        return every.withColumns({"_cell": F.xxhash64("_ka", *(at if of_lead else at[::-1])), "_lead": F.lit(of_lead)})

    rows = cells(names, F.col("_nparts"), F.col("_lparts"), False).unionByName(
        cells(leads, F.col("_lparts"), F.col("_nparts"), True), allowMissingColumns=True)
    # A cell's names come first, the better places before the others.  Asked for by number, the tasks are not merged: the work is not in the bytes.
    ordered = (rows.repartition(_tasks(leads.sparkSession), "_cell").sortWithinPartitions("_cell", "_lead", "_ka", "_rn", "_rc", "_pid")
               .select("_cell", "_lead", F.col("_ka").cast("binary").alias("_ka"), F.col("_kn").cast("binary").alias("_kn")))
    _ship_by_value(sys.modules[__name__.split(".")[0]])
    texts = ["_kn", "_ka", "_ckn"]
    return (ordered.mapInArrow(searcher(k), "_kn binary, _ka binary, _ckn binary, distance int")
            .select(*[F.col(c).cast("string").alias(c) for c in texts], "distance"))


def _best(near: DataFrame, cat: DataFrame, payload: list[str]) -> DataFrame:
    """The best place of each key among the names ``near`` it."""
    # Names first, places after: of equally near names all meet their place.
    places = cat.withColumnRenamed("_kn", "_ckn")
    return (near.join(places, ["_ckn", "_ka"]).groupBy(*KEY_COLS)
            .agg(F.min(F.struct("distance", *_rank(), *payload, "_ckn")).alias("_b"))
            .select(*KEY_COLS, *[F.col("_b." + p).alias(p) for p in payload],
                    F.col("_b._ckn").alias("matched_name"), F.col("_b.distance").alias("distance")))


def fuzzy_lookup(leads: DataFrame, catalogue: DataFrame, max_distance: int = 1,
                 name_col: str = "company_name", addr_col: str = "company_address",
                 payload=("place_id", "rating", "review_count", "maps_url"), crowd: int = 64) -> DataFrame:
    """Every lead with the payload, ``matched_name`` and ``distance`` of its
    ``nearest`` place, null where there is none."""
    keyed = with_key(leads, name_col, addr_col)
    best = nearest(keyed, catalogue, max_distance, payload, crowd)
    found = ["distance", "matched_name", *payload]
    joined = skew_safe_join(keyed.drop(*found), best.select(*KEY_COLS, *found), KEY_COLS, "left")
    return joined.drop(*KEY_COLS)
