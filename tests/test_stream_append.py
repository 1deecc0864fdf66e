"""The streaming append: every batch lands once, whatever is replayed, and the table is read at the first start only."""

import glob
import os
import shutil

import pytest
from pyspark.sql.streaming.state import GroupState  # noqa: F401  (the state API must be there)

from canvass.sources import files
from canvass.streaming import append
from canvass.streaming.append import stream_append

SCHEMA = "row_id bigint, company_name string, company_address string, maps_url string, rating double, opened timestamp"
BIG = 2 ** 60 + 1  # would not survive a double


def rows(*items):
    return [(i, name, addr, url, None, None) for i, name, addr, url in items]


class Flow:
    def __init__(self, spark, tmp_path, by="auto"):
        self.spark, self.by = spark, by
        self.target, self.incoming, self.checkpoint = (str(tmp_path / n) for n in ("target", "incoming", "checkpoint"))
        os.makedirs(self.incoming)

    def table(self, items):
        self.spark.createDataFrame(items, SCHEMA).write.mode("append").parquet(self.target)

    def arrive(self, name, items):
        self.spark.createDataFrame(items, SCHEMA).coalesce(1).write.parquet(f"{self.incoming}/{name}")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.incoming + "/*")
        q = stream_append(stream, self.target, by=self.by, checkpoint=self.checkpoint, available_now=True)
        q.awaitTermination()
        return q

    def ids(self):
        return sorted(r.row_id for r in self.spark.read.parquet(self.target).collect())

    def forget_last_commit(self):
        """What a driver that dies between the sink's work and Spark's own commit leaves behind."""
        commits = sorted((int(os.path.basename(p)) for p in glob.glob(self.checkpoint + "/commits/[0-9]*")))
        for name in (str(commits[-1]), f".{commits[-1]}.crc"):
            path = f"{self.checkpoint}/commits/{name}"
            if os.path.exists(path):
                shutil.move(path, f"{self.checkpoint}/{name}.lost")
        return commits[-1]


def test_keys_of_the_table_and_of_earlier_batches_are_known(spark, tmp_path):
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "u0")))
    f.arrive("b1", rows((1, "A", "x", " u0 "), (2, "B", "y", "u2"), (3, "B", "y", "u2"), (BIG, "C", "z", "u3")))
    f.run()
    assert f.ids() == [0, 2, 3, BIG]  # rows of one batch are not deduplicated against each other
    f.arrive("b2", rows((4, "B", "y", "u2"), (5, "D", "z", "u5"), (6, "A", "x", "u0")))
    f.run()
    f.run()  # nothing has come
    assert f.ids() == [0, 2, 3, 5, BIG]


def test_blank_keys_pass_until_one_is_in_the_table(spark, tmp_path):
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "u0"), (9, "N", "x", None)))  # a null URL is no blank key of the table
    f.arrive("b1", rows((1, "B", "y", ""), (2, "B", "y", " "), (3, "C", "y", None)))
    f.run()
    f.arrive("b2", rows((4, "D", "y", ""), (5, "E", "y", None), (6, "F", "y", "u6")))
    f.run()
    assert f.ids() == [0, 1, 2, 3, 6, 9]


def test_a_table_with_a_blank_key_takes_no_more(spark, tmp_path):
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "")))
    f.arrive("b1", rows((1, "B", "y", ""), (2, "B", "y", None), (3, "C", "y", "u3")))
    f.run()
    assert f.ids() == [0, 3]


@pytest.mark.parametrize("by", ["url", "name_address", "none"])
def test_a_replayed_batch_adds_nothing(spark, tmp_path, by):
    f = Flow(spark, tmp_path, by)
    f.table(rows((0, "A", "x", "u0")))
    f.arrive("b1", rows((1, "B", "y", "u1"), (2, "", None, ""), (3, None, " ", "")))
    f.run()
    before = f.ids()
    last = f.forget_last_commit()
    f.run()
    assert f.ids() == before == [0, 1, 2, 3]
    assert os.path.exists(f"{f.checkpoint}/commits/{last}")  # it was replayed
    f.arrive("b2", rows((4, "b ", "Y", "u1"), (5, "", "", ""), (6, "G", "g", "u6")))
    f.run()
    assert f.ids() == ([0, 1, 2, 3, 4, 5, 6] if by == "none" else [0, 1, 2, 3, 6])


@pytest.mark.parametrize("survived", [0, 1, 2])
def test_a_batch_cut_off_while_its_files_move_is_completed(spark, tmp_path, monkeypatch, survived):
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "u0")))
    f.arrive("b1", rows(*[(i, f"N{i}", "y", f"u{i}") for i in range(1, 40)], (50, "blank", "y", "")))
    moved, real = [], files.move

    def failing(session, old, new):
        if len(moved) == survived:
            raise OSError("the driver is gone")
        moved.append(new)
        real(session, old, new)

    monkeypatch.setattr(append.files, "move", failing)
    with pytest.raises(Exception):
        f.run()
    monkeypatch.setattr(append.files, "move", real)
    f.run()
    assert f.ids() == [0, *range(1, 40), 50]
    f.arrive("b2", rows((60, "blank", "y", ""), (61, "N1", "y", "u1")))
    f.run()
    assert f.ids() == [0, *range(1, 40), 50]


def test_the_table_is_read_at_the_first_start_only(spark, tmp_path, monkeypatch):
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "u0")))
    reads, real = [], append.read_dataset
    monkeypatch.setattr(append, "read_dataset", lambda *a: reads.append(a) or real(*a))
    for n in range(3):
        f.arrive(f"b{n}", rows((10 + n, "B", "y", f"v{n}"), (20 + n, "A", "x", "u0")))
    f.run()
    f.arrive("b9", rows((30, "B", "y", "v1")))
    f.run()
    assert len(reads) == 1 and f.ids() == [0, 10, 11, 12]


def test_a_missing_table_is_created_under_the_streams_rule(spark, tmp_path):
    f = Flow(spark, tmp_path)
    f.arrive("b1", rows((1, "A", "x", "u1"), (2, "A", "x", "u1")))
    f.run()
    f.arrive("b2", rows((3, "A", "x", "u1"), (4, "A", "x", "u4")))
    f.run()
    assert f.ids() == [1, 2, 4]


def test_values_cross_the_state_unchanged(spark, tmp_path):
    import datetime
    f = Flow(spark, tmp_path)
    when = datetime.datetime(2024, 2, 29, 12, 30, 15, 123457)
    item = (BIG, 'q"\n,é', None, "u", 0.1, when)
    f.arrive("b1", [item, (-1, None, "", "v", float("inf"), None)])
    f.run()
    got = {r.row_id: tuple(r) for r in spark.read.parquet(f.target).select("row_id", "company_name", "company_address", "maps_url", "rating", "opened").collect()}
    assert got == {BIG: item, -1: (-1, None, "", "v", float("inf"), None)}


def test_rows_stay_in_the_jvm_and_all_rows_of_a_key_meet(spark, tmp_path):
    """No Python call a key; a key of half the batch passes whole, or not at all once it is known."""
    f = Flow(spark, tmp_path)
    f.table(rows((0, "A", "x", "u0")))
    f.arrive("b1", rows(*[(i, "N", "y", "hot" if i % 2 else f"v{i}") for i in range(1, 101)], (200, "A", "x", "u0")))
    q = f.run()
    assert f.ids() == list(range(101))
    assert "Pandas" not in q._jsq.explainInternal(True)
    f.arrive("b2", rows(*[(300 + i, "N", "y", "hot") for i in range(50)], (400, "D", "z", "w")))
    f.run()
    assert f.ids() == [*range(101), 400]
    left = [n for n in files.names(spark, f.target + "/_appends") if n]
    assert not any(n.startswith(("batch", "arrived")) for h in left for n in files.names(spark, f"{f.target}/_appends/{h}"))
