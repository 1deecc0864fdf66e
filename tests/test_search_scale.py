"""Ranked and radius search over crowded tokens and cells: the same rows as brute force, in small groups."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from canvass.operators.search import EARTH_RADIUS_M, candidates, place_cells, search_many, within_radius_many

PLACES = "place_id string, name string, address string, category string, review_count bigint, lat double, lng double"


def words(text):
    return set(re.findall(r"\w+", (text or "").lower()))


def ranked(places, queries, n):
    out = set()
    for qid, text in queries:
        hits = []
        for p in places:
            score = len(words(text) & words(" ".join(x or "" for x in p[1:4])))
            if score:
                hits.append((-score, p[4] is None, -(p[4] or 0), p[0]))
        out |= {(qid, i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits)[:n])}
    return out


def catalogue(r, n):
    """'shop' in nine of ten places, some tokens common, some rare."""
    out = []
    for i in range(n):
        name = " ".join((["shop"] if r.random() < 0.9 else []) + [r.choice(["north", "south", "east"])] * (r.random() < 0.5)
                        + [f"rare{r.randrange(40)}"] * (r.random() < 0.4))
        out.append((f"p{i:04}", name, r.choice(["austin", "dallas", None]), r.choice(["dentist", "bakery"]),
                    r.choice([None, 1, 5, 5, 9]), 0.0, 0.0))
    return out


@pytest.mark.parametrize("crowd", [0, 12, 60, 10 ** 9])
def test_ranking_by_brute_force(spark, crowd):
    r = random.Random(1)
    places = catalogue(r, 300)
    queries = [(i, q) for i, q in enumerate([
        "shop", "shop austin", "dentist shop north austin", "rare3", "rare3 shop", "rare7 rare8 south bakery", "nothing here",
        "Shop SHOP", "austin shop", "", None, "east west", "dallas rare1 dentist shop"])]
    got = search_many(spark.createDataFrame(places, PLACES), spark.createDataFrame(queries, "query_id long, query string"), 7,
                      payload=("name",), crowd=crowd).collect()
    assert {(x.query_id, x.rank, x.place_id, x.score) for x in got} == ranked(places, queries, 7)
    assert len(got) == len(ranked(places, queries, 7))


def test_a_token_of_most_places_does_not_pair_them(spark):
    places = spark.createDataFrame(catalogue(random.Random(2), 3000), PLACES)
    queries = [(["shop"],), (["austin", "shop"],), (["dentist", "rare5", "shop"],)]
    n = 5
    pairs = candidates(places, spark.createDataFrame(queries, "_q array<string>"), n, crowd=100).count()
    assert pairs <= len(queries) * n * n + 60  # n places of n signatures, and the places of rare5
    assert candidates(places, spark.createDataFrame(queries, "_q array<string>"), n, crowd=10 ** 9).count() > 5000


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("crowd", [1, 20, 10 ** 9])
@pytest.mark.parametrize("radius", [30_000, 900_000, 15_000_000])
def test_radius_by_brute_force(spark, crowd, radius):
    r = random.Random(3)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(150)]
    spots += [(30.27 + r.gauss(0, 0.3), -97.74 + r.gauss(0, 0.3)) for _ in range(200)]  # a city
    spots += [(r.uniform(-2, 2), r.choice([-1, 1]) * r.uniform(178, 180)) for _ in range(60)]  # the antimeridian
    spots += [(89.9, r.uniform(-180, 180)) for _ in range(20)] + [(-90.0, 0.0), (90.0, 180.0), (0.0, -180.0), (0.0, 180.0)]
    spots += [(30.27, -97.74)] * 40
    places = [(f"p{i}", "n", "a", "c", 1, *s) for i, s in enumerate(spots)] + [("none", "n", "a", "c", 1, None, 1.0)]
    centres = [(0, 30.27, -97.74), (1, 0.0, 179.9), (2, 0.0, -180.0), (3, 89.5, 10.0), (4, -90.0, 0.0), (5, 31.0, -97.0), (6, None, 1.0)]
    got = within_radius_many(spark.createDataFrame(places, PLACES), spark.createDataFrame(centres, "centre_id long, lat double, lng double"),
                             radius, crowd=crowd).select("centre_id", "place_id").collect()
    want = {(c[0], p[0]) for c in centres for p in places if c[1] is not None and p[5] is not None
            and metres(c[1], c[2], p[5], p[6]) <= radius}
    edge = {(c[0], p[0]) for c in centres for p in places if c[1] is not None and p[5] is not None
            and abs(metres(c[1], c[2], p[5], p[6]) - radius) < 1e-3}
    assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} ^ want <= edge


def test_a_dense_cell_is_many_keys(spark):
    r = random.Random(4)
    places = [(f"p{i}", "n", "a", "c", 1, 30.0 + r.random(), -97.0 + r.random()) for i in range(4000)]
    places += [(f"q{i}", "n", "a", "c", 1, r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(4000)]
    keyed, leaves = place_cells(spark.createDataFrame(places, PLACES), 5.0, crowd=100)
    sizes = keyed.groupBy("cell_lat", "cell_lng", "_level", "_py", "_px").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 100 and sizes[1] == 8000 and 40 <= leaves.count() <= 400
