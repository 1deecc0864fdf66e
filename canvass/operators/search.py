"""Place search: text match with top-N, and radius filters.

Text score = number of distinct query tokens found in the place's name,
address and category.  Results are ordered by score, then review count
(nulls last), then place id, and cut at ``max_results``.

Radius: a hard great-circle filter (haversine).  One centre -> bounding-box
predicates (pushed into the parquet scan) plus the exact distance.  Many
centres -> each centre is expanded to the grid cells its bounding box
touches, places are keyed by their own cell, and the equi-join on cell is
followed by the exact distance test: no cross join, and only places in
nearby cells are ever compared.  Cells are cut by how many places they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .skew import skew_safe_join
from .topn import order_cols, top_n

EARTH_RADIUS_M = 6371000.0  # fixed value
MAX_LEVEL = 10  # a cell is cut into at most 4^10 quads
RESULT_ORDER = [("score", "desc"), ("review_count", "desc"), ("place_id", "asc")]


def place_tokens(places: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "address", "category")
             if c in places.columns]
    return F.array_distinct(tokens(F.concat_ws(" ", *parts)))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    r = F.radians
    dlat = r(lat2) - r(lat1)
    dlng = r(lng2) - r(lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _lat_span(radius_m: float) -> float:
    return math.degrees(radius_m / EARTH_RADIUS_M)


def within_radius(places: DataFrame, lat: float, lng: float, radius_m: float,
                  dist_col: str = "distance_m") -> DataFrame:
    """Places within ``radius_m`` metres of (lat, lng), with the distance."""
    if radius_m is None or radius_m <= 0:
        raise ValueError("radius must be > 0")
    dlat = _lat_span(radius_m)
    cond = (F.col("lat") >= lat - dlat) & (F.col("lat") <= lat + dlat)
    polar = abs(lat) + dlat >= 90.0
    if not polar:
        dlng = math.degrees(math.asin(min(1.0, math.sin(radius_m / EARTH_RADIUS_M)
                                          / math.cos(math.radians(lat)))))
        lo, hi = lng - dlng, lng + dlng
        if lo >= -180 and hi <= 180:
            cond = cond & (F.col("lng") >= lo) & (F.col("lng") <= hi)
    d = haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return places.where(cond).withColumn(dist_col, d).where(F.col(dist_col) <= radius_m)


def search_places(places: DataFrame, query: str, max_results: int = 20,
                  location: tuple[float, float] | None = None,
                  radius_m: float | None = None) -> DataFrame:
    """One query -> at most ``max_results`` places (TakeOrderedAndProject)."""
    if max_results <= 0:
        raise ValueError("max_results must be > 0")
    q = F.array_distinct(tokens(F.lit(query)))
    df = places
    if location is not None and radius_m:
        df = within_radius(df, location[0], location[1], radius_m)
    df = df.withColumn("score", F.size(F.array_intersect(q, place_tokens(places))))
    return df.where(F.col("score") > 0).orderBy(*order_cols(RESULT_ORDER)).limit(max_results)


def candidates(places: DataFrame, sets: DataFrame, n: int, crowd: int) -> DataFrame:
    """(``_q``, place_id, review_count, score): among them the ``n`` best places of every token set ``_q``.

    Tokens that at most ``crowd`` places hold lead to all their places.  The
    places of a crowded token are never listed: a place that matches crowded
    tokens only ranks by how many it matches, so of all places with the same
    crowded tokens (their *signature*) the first ``n`` in result order are
    enough, and of all signatures a set meets, the ``n`` best ones, each
    judged by its count and its first place.  No unlisted place can rank
    better: n listed ones with as high a score stand before it.
    """
    asked = sets.select("_q", F.explode("_q").alias("token"))
    held = (places.where(F.col("place_id").isNotNull())
            .select("place_id", "review_count", F.explode(place_tokens(places)).alias("token"))
            .join(asked.select("token").distinct(), "token", "left_semi"))
    crowded = held.groupBy("token").count().where(F.col("count") > crowd).select("token")
    signed = (skew_safe_join(held, crowded, ["token"], "left_semi").groupBy("place_id")
              .agg(F.max("review_count").alias("review_count"), F.sort_array(F.collect_set("token")).alias("_sig")))
    # Places with a token that is not crowded, with their full score.
    rare = (skew_safe_join(held, crowded, ["token"], "left_anti").join(asked, "token")
            .groupBy("_q", "place_id").agg(F.count_distinct("token").alias("_n"), F.max("review_count").alias("review_count")))
    more = F.size(F.array_intersect("_q", F.coalesce("_sig", F.array().cast("array<string>"))))
    rare = (rare.join(signed.select("place_id", "_sig"), "place_id", "left")
            .select("_q", "place_id", "review_count", (F.col("_n") + more).alias("score")))
    # Places with crowded tokens only.
    first = top_n(signed, ["_sig"], RESULT_ORDER[1:], n)
    signatures = first.where("rank = 1").select("_sig", F.col("review_count").alias("_rc"), F.col("place_id").alias("_pid"))
    met = (signatures.select("*", F.explode("_sig").alias("token")).join(asked, "token")
           .groupBy("_q", "_sig").agg(F.count("*").alias("score"), F.max("_rc").alias("_rc"), F.max("_pid").alias("_pid")))
    met = top_n(met, ["_q"], [("score", "desc"), ("_rc", "desc"), ("_pid", "asc")], n)
    plenty = met.select("_q", "_sig", "score").join(first.drop("rank"), "_sig").select("_q", "place_id", "review_count", "score")
    # A place of a signature can hold rare tokens too; its full score is the greater one.
    return (rare.unionByName(plenty).groupBy("_q", "place_id")
            .agg(F.max("review_count").alias("review_count"), F.max("score").alias("score")))


def search_many(places: DataFrame, queries: DataFrame, max_results: int = 20,
                payload=("name", "address", "phone", "website", "rating", "maps_url"), crowd: int = 10_000) -> DataFrame:
    """Many ``(query_id, query)`` rows -> top ``max_results`` places each.

    Queries of equal token sets are searched once.  A token that more than
    ``crowd`` places hold is searched by signatures (see ``candidates``), so
    it does not pair all its places with all queries that hold it; ``crowd``
    moves work, never results.  The place payload is joined to the ranked
    result only.
    """
    asked = queries.select("query_id", F.sort_array(F.array_distinct(tokens(F.col("query")))).alias("_q"))
    sets = asked.where(F.size("_q") > 0).select("_q").distinct()
    best = top_n(candidates(places, sets, max_results, crowd), ["_q"], RESULT_ORDER, max_results)
    ranked = skew_safe_join(asked, best, ["_q"], "inner").select("query_id", "rank", "place_id", "score", "review_count")
    info = places.select("place_id", *[c for c in payload if c in places.columns])
    # Inner join: every ranked place_id comes from the catalogue, so this is
    # the same as a left join, but either side may be the broadcast side --
    # AQE broadcasts the small ranked result instead of shuffling the catalogue.
    return ranked.join(info, "place_id", "inner")


def _cells(lat: Column, lng: Column, cell_deg: float):
    return (F.floor(lat / cell_deg).cast("int"), F.floor(lng / cell_deg).cast("int"))


CELL = ["cell_lat", "cell_lng"]


def _ancestor(level: str) -> list[Column]:
    """The quad of ``level`` that a quad of the finest level lies in."""
    return [F.expr(f"shiftright(_fy, {MAX_LEVEL} - {level})").alias("_py"), F.expr(f"shiftright(_fx, {MAX_LEVEL} - {level})").alias("_px")]


def place_cells(places: DataFrame, cell_deg: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """``places`` with the leaf of a quadtree they lie in (cell, ``_level``, ``_py``, ``_px``), and the
    leaves of the cells that are cut.

    A cell, and each of its quads, that holds more than ``crowd`` places is cut
    in four, down to ``MAX_LEVEL``, so that a city is many keys.  Counts are
    taken once, by quads of the finest level, and summed up the tree.
    """
    n_lng, fine = int(round(360.0 / cell_deg)), float(1 << MAX_LEVEL)
    clat, clng = _cells(F.col("lat"), F.col("lng"), cell_deg)

    def finest(c: str, cell: Column) -> Column:
        return F.least(F.floor((F.col(c) / cell_deg - cell) * fine), F.lit(fine - 1)).cast("int")

    keyed = places.withColumns({"cell_lat": clat, "cell_lng": F.pmod(clng + n_lng // 2, F.lit(n_lng)) - n_lng // 2,
                                "_fy": finest("lat", clat), "_fx": finest("lng", clng)})
    dense = keyed.groupBy(*CELL).count().where(F.col("count") > crowd).select(*CELL)
    quads = skew_safe_join(keyed.select(*CELL, "_fy", "_fx"), dense, CELL, "left_semi").groupBy(*CELL, "_fy", "_fx").count()
    above = (quads.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL - 1))))
             .select(*CELL, "_fy", "_fx", "_level", *_ancestor("_level"), "count"))
    quad = [*CELL, "_level", "_py", "_px"]
    cut = above.groupBy(*quad).agg(F.sum("count").alias("n")).where(F.col("n") > crowd).select(*quad)
    leaf_of = above.join(cut, quad).groupBy(*CELL, "_fy", "_fx").agg((F.max("_level") + 1).alias("_level"))
    leaves = leaf_of.select(*CELL, "_level", *_ancestor("_level")).distinct()
    placed = skew_safe_join(keyed, leaf_of, [*CELL, "_fy", "_fx"], "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    return placed.select("*", *_ancestor("_level")).drop("_fy", "_fx"), leaves


def within_radius_many(places: DataFrame, centres: DataFrame, radius_m: float,
                       cell_deg: float | None = None, crowd: int = 10_000) -> DataFrame:
    """``centres(centre_id, lat, lng)`` x places within ``radius_m``.

    Grid equi-join on (lat cell, lng cell, quad of the cell): every centre
    lists all cells its bounding box touches (longitude span widened by
    1/cos(latitude), whole ring near the poles, wrapped at the antimeridian),
    and of a crowded cell the quads it touches; then the exact haversine test.
    Pairs are only formed between neighbours, and ``crowd`` (places that a
    quad holds undivided) moves work, never results.
    """
    if radius_m is None or radius_m <= 0:
        raise ValueError("radius must be > 0")
    dlat = _lat_span(radius_m) + 1e-9  # rounding never loses a place on the rim
    if cell_deg is None:
        # Cells about one radius wide: a centre touches ~3x3 cells away from
        # the poles, and the candidate pairs are a small constant multiple of
        # the true matches.  360 must divide into whole cells.
        cell_deg = 360.0 / max(1, min(36000, int(360.0 / max(dlat, 0.01))))
    n_lng_cells = int(round(360.0 / cell_deg))
    lat = F.col("c_lat")
    lat_lo, lat_hi = F.greatest(lat - dlat, F.lit(-90.0)), F.least(lat + dlat, F.lit(90.0))
    max_abs = F.greatest(F.abs(lat_lo), F.abs(lat_hi))
    polar = max_abs >= F.lit(89.999)
    dlng = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(radius_m / EARTH_RADIUS_M))
                                    / F.cos(F.radians(max_abs))))) + 1e-9
    lng_lo = F.when(polar | (dlng >= 180), F.lit(-180.0)).otherwise(F.col("c_lng") - dlng)
    lng_hi = F.when(polar | (dlng >= 180), F.lit(180.0)).otherwise(F.col("c_lng") + dlng)
    # Rows without coordinates can never be within a radius; dropping them
    # first keeps null cell keys (one hash partition) out of the join.
    centres = centres.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    places = places.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    p, leaves = place_cells(places, cell_deg, crowd)
    c = (centres.select("centre_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
         .withColumns({"_lat_lo": lat_lo / cell_deg, "_lat_hi": lat_hi / cell_deg,
                       "_lng_lo": lng_lo / cell_deg, "_lng_hi": lng_hi / cell_deg})
         .withColumn("cell_lat", F.explode(F.sequence(F.floor("_lat_lo").cast("int"), F.floor("_lat_hi").cast("int"))))
         .withColumn("_lc", F.explode(F.sequence(
             F.floor("_lng_lo").cast("int"),
             F.least(F.floor("_lng_hi").cast("int"), F.floor("_lng_lo").cast("int") + n_lng_cells - 1))))
         .withColumn("cell_lng", F.pmod(F.col("_lc") + n_lng_cells // 2, F.lit(n_lng_cells))
                     - n_lng_cells // 2))
    # Of a cell that is cut, the leaves that the box overlaps; a box round the globe ends in the cell it begins in.
    whole = F.col("_lng_hi") >= F.floor("_lng_lo") + n_lng_cells
    size = F.pow(F.lit(0.5), "_level")

    def overlaps(part: str, cell: str, low: str, high: str) -> Column:
        at = F.col(cell) + F.col(part) * size
        return (at <= F.col(high)) & (at + size >= F.col(low))

    near = overlaps("_py", "cell_lat", "_lat_lo", "_lat_hi") & (whole | overlaps("_px", "_lc", "_lng_lo", "_lng_hi"))
    leaf = ["_level", "_py", "_px"]
    c = (skew_safe_join(c, leaves, CELL, "left").where(F.col("_level").isNull() | near)
         .select("centre_id", "c_lat", "c_lng", *CELL, *[F.coalesce(x, F.lit(0)).alias(x) for x in leaf]))
    j = p.join(c, [*CELL, *leaf])
    d = haversine_m(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng"))
    return (j.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
            .drop(*CELL, *leaf, "c_lat", "c_lng"))
