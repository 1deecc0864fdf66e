"""Segment index and nearest lookup against plain edit distance over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.operators import fuzzy, spelling
from canvass.operators.fuzzy import candidates, deletion_variants, fuzzy_lookup
from canvass.operators.lookup import catalogue_by_key
from canvass.plans.enrich import enrich_leads, enrich_reviews

LEADS = "row_id bigint, company_name string, company_address string"
PLACES = "place_id string, name string, address string, rating double, review_count bigint, maps_url string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def words(r, n, letters="abé\U0001F600", most=9):
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, most))) for _ in range(n)]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd", [0, 5])
def test_all_pairs_within_k_are_candidates(spark, k, crowd):
    r = random.Random(k)
    names = sorted(set(words(r, 60) + [w * 3 for w in words(r, 30, most=6)]))
    pairs = [(n, a) for n in names for a in ("", "x")]
    df = spark.createDataFrame(pairs, "_kn string, _ka string").repartition(3)
    found = {tuple(x) for x in candidates(df, df, k, crowd).distinct().collect()}
    want = {(a, x, b) for a, x in pairs for b, y in pairs if x == y and edits(a, b) <= k}
    assert want <= found
    if crowd == 0:  # refined keys bring names at most 2k edits apart together
        assert all(edits(a, b) <= 2 * k for a, _, b in found)


@settings(max_examples=60, deadline=None)
@given(st.text("ab#", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 14), st.sampled_from(["", "a", "b", "#c"])), max_size=3))
def test_some_segment_stays_whole(name, changes):
    """The lemma in plain Python: i segments before, at most i edits there, at most k - i after."""
    k, other = 3, name
    for at, new in changes:
        at = min(at, len(other))
        other = other[:at] + new[:1] + other[at + (0 if len(new) > 1 else 1):]
    if not other:
        return
    n, m = len(name), len(other)
    base, short = n // (k + 1), k + 1 - n % (k + 1)
    ok = False
    for i in range(k + 1):
        start, size = base * i + max(0, i - short), base + (i >= short)
        for q in range(max(start - i, start + m - n - (k - i), 0), min(start + i, start + m - n + k - i, m - size) + 1):
            ok |= (other[q:q + size] == name[start:start + size] and edits(name[:start], other[:q]) <= i
                   and edits(name[start + size:], other[q + size:]) <= k - i)
    assert ok


def test_deletion_variants(spark):
    df = spark.createDataFrame([("abc",), ("a",), ("",)], "s string")
    got = {r.s: set(r.v) for r in df.select("s", deletion_variants(F.col("s"), 2).alias("v")).collect()}
    assert got == {"abc": {"abc", "ab", "ac", "bc", "a", "b", "c"}, "a": {"a", ""}, "": {""}}


def best(lead, places, k):
    name, addr = lead[1] or "", lead[2] or ""
    near = sorted((edits(name, p[1]), p[4] is None, -(p[4] or 0), p[0]) for p in places
                  if name and p[1] and p[2] == addr and edits(name, p[1]) <= k)
    return (near[0][3], near[0][0]) if near else (None, None)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_nearest_by_brute_force(spark, k):
    r = random.Random(10 + k)
    names = sorted(set(words(r, 80, "abc", 8)))
    places = [(f"p{i:03}", n, r.choice(["", "x"]), 1.0, r.choice([None, 3, 5]), "u") for i, n in enumerate(names)]
    places.append(("p999", "", "x", 1.0, 9, "u"))  # a blank name is never found
    leads = [(i, n, r.choice(["", "x", None])) for i, n in enumerate(words(r, 120, "abc", 8) + [None, "", " "] + ["abca"] * 60)]
    got = {x.row_id: (x.place_id, x.distance) for x in fuzzy_lookup(
        spark.createDataFrame(leads, LEADS), catalogue_by_key(spark.createDataFrame(places, PLACES)), k, crowd=4).collect()}
    assert got == {i: best((i, (n or "").strip(), a), places, k) for i, n, a in leads}


def test_more_edits_than_supported_raise(spark):
    with pytest.raises(ValueError, match="0 to 3"):
        fuzzy_lookup(spark.createDataFrame([], LEADS), catalogue_by_key(spark.createDataFrame([], PLACES)), 4)


def test_a_shared_address_is_no_hot_key(spark):
    """2000 names of one blank address that share a long prefix: refined keys meet in small groups."""
    names = [f"customer#{i * 7919 % 10 ** 9:09}" for i in range(2000)]
    df = spark.createDataFrame([(n, "") for n in names], "_kn string, _ka string")
    pairs = candidates(df, df, 1, crowd=64).count()
    assert pairs < 40 * len(names)
    plan = candidates(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop", plan)


def test_enrichment_falls_back_to_the_nearest_name(spark):
    places = spark.createDataFrame([("p1", "Alpha Dental", "Main St", 4.5, 7, "u1"), ("p2", "Alpha Dentol", "Main St", 3.0, 9, "u2")], PLACES)
    leads = spark.createDataFrame([(1, "Alpha Dental", "Main St"), (2, "Alfa Dental", "Main St"), (3, "Alha Dntal", "Main St"),
                                   (4, "Alfa Dental", "Oak St"), (5, None, "Main St")], LEADS)
    full = {r.row_id: (r.maps_url, r.error) for r in enrich_leads(leads, places, fuzzy=2).collect()}
    lost = "Business not found on Google Maps"
    assert full == {1: ("u1", None), 2: ("u1", None), 3: ("u1", None), 4: (None, lost), 5: (None, "Missing business name or address")}
    assert {r.row_id: r.review_count for r in enrich_reviews(leads, places, fuzzy=2).collect()} == {1: 7, 2: 7, 3: 7, 4: None, 5: None}
    assert [r.error for r in enrich_leads(leads.where("row_id = 2"), places).collect()] == [lost]


def test_variants_are_never_broadcast(spark):
    """Names of a small table make few bytes, their variants many: no join of these may be planned from the former."""
    df = spark.createDataFrame([(f"customer#{i * 7919 % 10 ** 9:09}", "") for i in range(500)], "_kn string, _ka string")
    out = candidates(df, df, 2, crowd=8).repartition(1)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert not re.search(r"BroadcastHashJoin \[[^\]]*(_h|_lv)#", plan)
    assert re.search(r"SortMergeJoin[^\[]*\[[^\]]*(_h|_lv)#", plan)


@pytest.mark.parametrize("letters", ["ab", "0123456789", "abé\U0001F600"])
@pytest.mark.parametrize("rows", [1, 1 << 18])
def test_search_in_memory_by_brute_force(monkeypatch, letters, rows):
    """The first of the nearest names of the lead's own group, however few places are looked at together."""
    monkeypatch.setattr(spelling, "ROWS", rows)
    r = random.Random(rows)
    for most in (4, 8, 14):
        names, leads = list(dict.fromkeys(words(r, 40, letters, most))), words(r, 30, letters, most)
        groups, own = [r.randrange(2) for _ in names], [r.randrange(3) for _ in leads]
        for k in (1, 2, 3):
            at, distance = spelling.nearest_names(names, np.array(groups), leads, np.array(own), k)
            for i, lead in enumerate(leads):
                near = [(edits(lead, n), j) for j, n in enumerate(names) if groups[j] == own[i] and edits(lead, n) <= k]
                assert (distance[i], at[i]) == min(near, default=(-1, -1))


def test_cells_stay_whole_over_batches(monkeypatch):
    monkeypatch.setattr(spelling, "TOGETHER", 4)
    cells = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 4, 5]
    for size in range(1, 14):
        batches = [pa.RecordBatch.from_pydict({"_cell": cells[i:i + size]}) for i in range(0, len(cells), size)]
        tables = [t["_cell"].to_pylist() for t in spelling._whole_groups([pa.RecordBatch.from_pydict({"_cell": pa.array([], pa.int64())}), *batches])]
        assert sum(tables, []) == cells
        assert all(not set(a) & set(b) for a, b in zip(tables, tables[1:]))


@pytest.mark.parametrize("cell", [40, 1 << 22])
def test_crowded_addresses_by_brute_force(spark, monkeypatch, cell):
    """Names and leads of an address in one cell or in many: the same places, the best of equally near ones."""
    monkeypatch.setattr(fuzzy, "CELL", cell)
    r = random.Random(5)
    names = sorted({f"shop #{r.randrange(3000):04}" for _ in range(60)})
    places = [(f"p{i:03}", n, a, 1.0, r.choice([None, 3, 5]), "u") for i, n in enumerate(names) for a in r.sample(["", "x", "y"], 2)]
    leads = [(i, n + r.choice(["", "x"]), r.choice(["", "x", "y", "z"])) for i, n in enumerate(f"shop #{r.randrange(3000):04}" for _ in range(80))]
    got = {x.row_id: (x.place_id, x.distance) for x in fuzzy_lookup(
        spark.createDataFrame(leads, LEADS), catalogue_by_key(spark.createDataFrame(places, PLACES)), 3, crowd=20).collect()}
    assert got == {i: best((i, n, a), places, 3) for i, n, a in leads}


def records_shuffled(plan):
    """Rows that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return records_shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return records_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(records_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_variants_are_never_shuffled(spark):
    """Names of one address that differ in a few digits: each is shuffled a few times, not for each of its variants."""
    places = [(f"p{i}", f"customer#{i * 7919 % 10 ** 9:09}", "x", 1.0, i, "u") for i in range(300)]
    leads = [(i, f"kuzdomer#{i * 7919 % 10 ** 9:09}", "x") for i in range(300)]
    out = fuzzy_lookup(spark.createDataFrame(leads, LEADS), catalogue_by_key(spark.createDataFrame(places, PLACES)), 3)
    assert {(x.place_id, x.distance) for x in out.collect()} == {(f"p{i}", 3) for i in range(300)}
    assert 0 < records_shuffled(out._jdf.queryExecution().executedPlan()) < 40 * 600
