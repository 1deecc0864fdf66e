"""Operator 13: centroid clustering in integers, by DataFrame expressions alone.

Components become floor(``scale`` * c).  A vector's squared distance to a
centroid is ``aggregate(zip_with(x, centroid, ...))`` against a literal array,
the least of the structs (distance, cluster) chooses the cluster, and one sum a
component and cluster, a partial aggregate, gives the next centroids as exact
floors of sum over count.  All numbers are longs: reruns agree to the digit.

Defined cases: vectors that are null, hold null, NaN or infinite components or
have another number of components are dropped; rows of one id are vectors of
their own; a null id counts as the text '' in the seed's hash; ties of the hash
go by the vector's components, ties of the distance to the smaller cluster; an
empty cluster keeps its centroid; with fewer vectors than clusters every vector
seeds one; an empty table gives an empty result; other columns are not carried.
A component of 2^27 or more after scaling raises: distances would leave a long.

Scale: the vectors are written once as integers; each round reads them and
shuffles one row per cluster and task.  Centroids are a few numbers, whatever
the input.  A round that changes nothing ends the loop, as all later ones would
be equal to it.  No Python code runs on rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, whole_vector

LARGEST = 1 << 27


def literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in centroid)})")


def distance(x: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance to a literal centroid."""
    squares = F.zip_with(x, literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s)


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, ties to the smaller number."""
    return F.array_min(F.array(*[F.struct(distance(x, c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def seeds(vectors: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors of the smallest sha256 of ``salt`` and id, in order."""
    text = F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r.x) for r in vectors.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()]


def step(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one assignment of all vectors."""
    width = len(centroids[0])
    sums = (vectors.select("x", nearest(F.col("x"), centroids).alias("best")).groupBy(F.col("best.cluster").alias("cluster"))
            .agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).collect())
    out = list(centroids)
    for r in sums:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024,
            salt: str = "3:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every kept vector."""
    x = F.col(vector)
    kept = stage(vectors.where(whole_vector(x) & (F.size(x) == width))
                 .select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("x")),
                 "centroid-vectors")
    largest = kept.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    if largest is not None and largest >= LARGEST:
        raise ValueError(f"a component of {largest} after scaling; squared distances need less than {LARGEST}")
    centroids = seeds(kept, clusters, salt)
    schema = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema.format(vectors.schema[vec_id].dataType.simpleString()))
    for _ in range(rounds):
        moved = step(kept, centroids)
        if moved == centroids:
            break
        centroids = moved
    best = kept.select("vec_id", nearest(F.col("x"), centroids).alias("best")).select("vec_id", "best.cluster", "best.distance")
    inertia = {r.cluster: r.d for r in best.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}

    def of_cluster(values: list[Column]) -> Column:
        return F.array(*values)[F.col("cluster")]

    n = range(len(centroids))
    return best.select(
        "vec_id", "cluster", "distance",
        of_cluster([F.lit(inertia.get(i, 0)).cast("long") for i in n]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster([F.lit(hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i in n]).alias("centroid_sha256"),
        of_cluster([literal(centroids[i]) for i in n]).alias("centroid"))
