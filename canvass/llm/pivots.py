"""Operator 3: exact top-k by inner product over a pivot-distance index.

Vectors are quantised to integers (floor of ``scale`` times each component).
One extra coordinate, sqrt(R^2 - |x|^2) with R the greatest norm, turns the
largest inner product into the least Euclidean distance:
|q|^2 + R^2 - 2 q.x, with 0 as the query's extra coordinate.

Index: every vector is keyed by its nearest pivot and the distance to it, and
the keys are range-partitioned and cut into annuli of up to ``block`` vectors,
one written row each.  Search: a query's own annulus gives its first k scores
and with them a radius.  By the triangle inequality a vector at distance r
from a pivot lies at least |d(q, pivot) - r| from the query, so only annuli
that meet [d - radius, d + radius] of their pivot are paired with the block of
queries.  A task takes the annuli of a query block by rising lower bound and
stops a query where the bound passes its k-th best.  Scores are exact
integers; only bounds are floating, and they carry a margin.

Defined cases: null vectors and those with null, infinite or NaN components
take no part, nor do rows with a null id; rows of one id count as one, the
least vector; vectors of unequal length are compared as if padded with zeros;
ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives an empty result; other columns are not carried.

Scale: pivots are fitted on a bounded sample (``sample`` rows by id hash);
every row is indexed.  Equal vectors share a pivot and a distance, and the
range partitioning goes on by id, so they fill many annuli.  Queries meet
annuli in blocks, as rows of bounded size, never vector by vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

EXACT = 2 ** 53


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that take part, one row per id."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & F.coalesce(whole, F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(column, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    n = np.asarray(column.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(n), width), np.int64)
    if n.sum():
        out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(column.flatten())
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: by floating point where every sum stays below 2^53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lift(x: np.ndarray, r2: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0.0, r2 - (f * f).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d2))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
          scale: int = 1024, pivots: int = 32, sample: int = 4096, block: int = 512, queries_per_block: int = 256,
          slices: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score for every row with ``is_query`` (a column over ``id``), among all others."""
    ship()
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, vec_id, vector, scale), "pivot-vectors")
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    width, r2 = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    if drawn:
        some = np.zeros((len(drawn), width), np.int64)
        for i, r in enumerate(drawn):
            some[i, :len(r["v"])] = r["v"]
        fitted = choose_pivots(lift(some, r2), pivots)
    else:
        fitted = np.zeros((1, width + 1))
    shared = spark.sparkContext.broadcast(fitted)
    # Rounding of bounds: far above what double sums of these sizes lose.
    slack = 1e-6 * (1.0 + np.sqrt(r2))

    def key(batches):
        for batch in batches:
            d = distances(lift(_matrix(batch.column(1), width), r2), shared.value)
            at = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at], pa.float64())],
                names=["id", "v", "q", "pivot", "dist"])

    keyed = (rows.select("id", "v", F.coalesce(is_query, F.lit(False)).alias("q"))
             .mapInArrow(key, "id long, v array<long>, q boolean, pivot int, dist double")
             .repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id"))

    def pack(batches):
        """Annuli: runs of up to ``block`` rows of one pivot, with the queries' first k-th scores."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows > block:
                size, held = cut(held)
                yield size
        while held is not None and held.num_rows:
            size, held = cut(held)
            yield size

    def cut(table):
        table = table.combine_chunks()
        pivot = np.asarray(table.column("pivot"))
        size = min(block, int(np.searchsorted(pivot, pivot[0], side="right")))
        t = table.slice(0, size).combine_chunks()
        ids, q = np.asarray(t.column("id")), np.asarray(t.column("q").combine_chunks().to_numpy(zero_copy_only=False), bool)
        x = _matrix(t.column("v").combine_chunks(), width)
        dist = np.asarray(t.column("dist"))
        at = np.flatnonzero(q)
        s = products(x[at], x)
        floor = np.full(len(at), np.iinfo(np.int64).min)
        for i, row in enumerate(at):
            others = np.delete(s[i], row)
            if len(others) >= k:
                floor[i] = np.partition(others, len(others) - k)[len(others) - k]
        out = pa.RecordBatch.from_arrays(
            [pa.array([int(pivot[0])], pa.int32()), pa.array([dist[0]]), pa.array([dist[-1]]),
             pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
             pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([floor.tobytes()], pa.binary())],
            names=["pivot", "r0", "r1", "ids", "x", "at", "floor"])
        return out, table.slice(size)

    index = stage(keyed.mapInArrow(pack, "pivot int, r0 double, r1 double, ids binary, x binary, at binary, floor binary")
                  .withColumn("annulus", F.monotonically_increasing_id()), "pivot-index")

    def gather(batches):
        """Query blocks: queries of neighbouring annuli, with their intervals around every pivot."""
        ids, xs, floors, n = [], [], [], 0
        for batch in batches:
            for i, x, at, floor in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "at", "floor"))):
                at = np.frombuffer(at, np.int32)
                if len(at):
                    ids.append(np.frombuffer(i, np.int64)[at])
                    xs.append(np.frombuffer(x, np.int64).reshape(-1, width)[at] if width else np.zeros((len(at), 0), np.int64))
                    floors.append(np.frombuffer(floor, np.int64))
                    n += len(at)
                    if n >= queries_per_block:
                        yield put(ids, xs, floors)
                        ids, xs, floors, n = [], [], [], 0
        if n:
            yield put(ids, xs, floors)

    def radius(x, floor):
        """Distance within which the k best must lie, given a k-th score."""
        q2 = (x.astype(np.float64) ** 2).sum(axis=1)
        none = floor == np.iinfo(np.int64).min
        return np.where(none, np.inf, np.sqrt(np.maximum(0.0, q2 + r2 - 2.0 * floor)) + slack)

    def query_lift(x):
        return np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)

    def put(ids, xs, floors):
        ids, x, floor = np.concatenate(ids), np.concatenate(xs), np.concatenate(floors)
        d = distances(query_lift(x), shared.value)
        far = radius(x, floor)[:, None]
        low, high = (d - far).min(axis=0), (d + far).max(axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
             pa.array([floor.tobytes()], pa.binary()), pa.array([low.tolist()]), pa.array([high.tolist()]),
             pa.array([d.min(axis=0).tolist()]), pa.array([d.max(axis=0).tolist()])],
            names=["qids", "qx", "floor", "low", "high", "d0", "d1"])

    blocks = stage(index.select("ids", "x", "at", "floor").mapInArrow(
        gather, "qids binary, qx binary, floor binary, low array<double>, high array<double>, "
                "d0 array<double>, d1 array<double>")
        .withColumn("qblock", F.monotonically_increasing_id()), "pivot-queries")
    wanted = blocks.select("qblock", F.posexplode(F.arrays_zip("low", "high", "d0", "d1")).alias("pivot", "w")).select(
        "qblock", "pivot", "w.*")
    rings = index.select("annulus", "pivot", "r0", "r1")
    pairs = stage(rings.join(wanted, "pivot").where((F.col("r0") <= F.col("high")) & (F.col("r1") >= F.col("low")))
                  .select("annulus", "qblock", "r0", "r1", "pivot",
                          F.greatest(F.lit(0.0), F.col("r0") - F.col("d1"), F.col("d0") - F.col("r1")).alias("bound")),
                  "pivot-pairs")
    # Each (query block, slice) is one run of annuli by rising lower bound.
    work = (pairs.join(blocks.select("qblock", "qids", "qx", "floor"), "qblock")
            .join(index.select("annulus", F.col("ids").alias("aids"), F.col("x").alias("ax")), "annulus"))
    by = [F.col("qblock"), F.pmod(F.xxhash64("annulus"), F.lit(slices))]
    work = (work.select("qblock", by[1].alias("slice"), "bound", "pivot", "r0", "r1", "qids", "qx", "floor", "aids", "ax")
            .repartition(F.col("qblock"), F.col("slice")).sortWithinPartitions("qblock", "slice", "bound"))

    def search(batches):
        now, best = None, None
        for batch in batches:
            for qb, sl, _, pivot, r0, r1, qids, qx, floor, aids, ax in zip(*(c.to_pylist() for c in batch.columns)):
                if (qb, sl) != now:
                    if best is not None:
                        yield best.rows()
                    now, best = (qb, sl), Found(qids, qx, floor)
                best.take(pivot, r0, r1, aids, ax)
        if best is not None:
            yield best.rows()

    class Found:
        """The k best so far of one block of queries in one slice of the annuli."""

        def __init__(self, qids, qx, floor):
            self.ids = np.frombuffer(qids, np.int64)
            self.x = np.frombuffer(qx, np.int64).reshape(len(self.ids), width)
            self.floor = np.frombuffer(floor, np.int64).copy()
            self.d = distances(query_lift(self.x), shared.value)
            self.top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

        def take(self, pivot, r0, r1, aids, ax):
            d = self.d[:, pivot]
            bound = np.maximum(0.0, np.maximum(r0 - d, d - r1))
            open_ = np.flatnonzero(bound <= radius(self.x, self.floor))
            if not len(open_):
                return
            ids = np.frombuffer(aids, np.int64)
            s = products(self.x[open_], np.frombuffer(ax, np.int64).reshape(len(ids), width))
            for i, row in zip(open_, s):
                good = np.flatnonzero((row >= self.floor[i]) & (ids != self.ids[i]))
                if len(good):
                    scores = np.concatenate([self.top[i][0], row[good]])
                    names = np.concatenate([self.top[i][1], ids[good]])
                    at = _best(scores, names, k)
                    self.top[i] = scores[at], names[at]
                    if len(at) == k:
                        self.floor[i] = max(self.floor[i], scores[at[-1]])

        def rows(self):
            n = [len(t[0]) for t in self.top]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([t[1] for t in self.top])),
                 pa.array(np.concatenate([t[0] for t in self.top]))], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
