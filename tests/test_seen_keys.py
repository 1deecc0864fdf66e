"""The persisted key index: equal to the plain append, whatever happened to the files."""

import glob
import os
import random

import pytest

from canvass.operators.append import keyed
from canvass.sources.leads_io import append_dataset, read_dataset
from canvass.sources.seen_keys import SeenKeys

from conftest import rows

SCHEMA = "company_name string, company_address string, maps_url string"


def batch(spark, numbers, blanks=0):
    return spark.createDataFrame([(f"N{i}", f"street {i % 7}", f" u{i} ") for i in numbers]
                                 + [("B", "b", None)] * blanks, SCHEMA)


def names(spark, path):
    return sorted(r.company_name for r in read_dataset(spark, path).collect())


@pytest.mark.parametrize("by", ["url", "name_address", "none"])
def test_indexed_appends_equal_plain_ones(spark, tmp_path, by):
    plain, indexed = str(tmp_path / "plain"), str(tmp_path / "indexed")
    draw = random.Random(by)
    for step in range(4):
        new = batch(spark, [draw.randrange(60) for _ in range(25)], blanks=step % 2)
        assert append_dataset(spark, plain, new, by=by) == append_dataset(spark, indexed, new, by=by, indexed=True)
    assert rows(read_dataset(spark, plain)) == rows(read_dataset(spark, indexed))


def test_files_of_others_are_indexed_and_deleted_ones_forgotten(spark, tmp_path):
    path = str(tmp_path / "t")
    batch(spark, range(20)).coalesce(1).write.parquet(path)
    assert append_dataset(spark, path, batch(spark, range(15, 25)), indexed=True) == 5
    batch(spark, range(30, 40)).coalesce(1).write.mode("append").parquet(path)
    assert append_dataset(spark, path, batch(spark, range(30, 41)), indexed=True) == 1
    # The file of rows 0 to 19 goes; they may be added again, the others not.
    first = [f for f in glob.glob(f"{path}/part-*.parquet") if spark.read.parquet(f).where("company_name = 'N0'").count()]
    os.remove(first[0])
    assert append_dataset(spark, path, batch(spark, range(45)), indexed=True) == 20 + 9
    assert names(spark, path) == sorted(f"N{i}" for i in range(45))


def test_an_entry_that_was_not_finished_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    batch(spark, range(10)).write.parquet(path)
    append_dataset(spark, path, batch(spark, [3]), indexed=True)
    index = SeenKeys(spark, path, "url")
    [entry] = index.entries()
    os.remove(f"{path}/_keys/url/{entry}/_whole")
    assert index.entries() == []
    assert append_dataset(spark, path, batch(spark, range(12)), indexed=True) == 2


def test_only_parts_of_flagged_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    batch(spark, range(4000)).write.parquet(path)
    index = SeenKeys(spark, path, "url", part_keys=100)
    index.sync(read_dataset(spark, path))
    parts = glob.glob(f"{path}/_keys/url/entry-*/keys/part=*/*.parquet")
    assert len(parts) == 64

    new = keyed(batch(spark, [7, 8, *range(9000, 9100)]), "url")
    flagged = index.flagged(new)
    # Filter rows, no key and no data file; hardly more keys than the two repeats.
    assert all("/bits/" in f for f in flagged.inputFiles() if path in f)
    assert 2 <= flagged.count() <= 2 + 10
    known = index.known(new)
    read = [f for f in known.inputFiles() if path in f]
    assert 1 <= len(read) <= 12 and all("/keys/part=" in f for f in read)
    assert rows(known) == [("u7",), ("u8",)]
    assert index.known(keyed(batch(spark, [10 ** 6]), "url")).count() == 0


def test_a_second_sync_reads_nothing_and_entries_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    index = SeenKeys(spark, path, "url", part_keys=50, fan=3)
    for step in range(7):
        batch(spark, range(step * 10, step * 10 + 15)).coalesce(1).write.mode("append").parquet(path)
        index.sync(read_dataset(spark, path))
        before = index.entries()
        index.sync(read_dataset(spark, path))
        assert index.entries() == before and len(before) <= 3
    got = index.known(keyed(batch(spark, range(0, 200, 5), blanks=2), "url"))
    assert rows(got) == sorted((f"u{i}",) for i in range(0, 75, 5))


def test_blank_keys_and_a_column_that_older_files_lack(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("Old", "x")], "company_name string, company_address string").write.parquet(path)
    batch(spark, [1]).write.mode("append").parquet(path)
    spark.createDataFrame([("Blank", "x", " ")], SCHEMA).write.mode("append").parquet(path)
    assert append_dataset(spark, path, batch(spark, [1, 2], blanks=3), indexed=True) == 1
    assert names(spark, path) == ["Blank", "N1", "N2", "Old"]
