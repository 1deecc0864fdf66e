"""Generated texts through a journal: an answered prompt is never sent again."""

import os

import pytest
from pyspark.sql import functions as F

from canvass.operators.generate import generate, journaled
from canvass.sources import files

LEADS = "row_id bigint, company_name string, generated_email string"
TEMPLATE = "{company_name}"


class Model:
    """Answers in upper case and notes every prompt in a file, as tasks run in other processes."""

    def __init__(self, log, fail_at=None, refuse=()):
        self.log, self.fail_at, self.refuse = str(log), fail_at, refuse

    def sent(self):
        if not os.path.exists(self.log):
            return []
        with open(self.log, encoding="utf-8") as f:
            return f.read().splitlines()

    def __call__(self, prompts):
        out = []
        for p in prompts:
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(p + "\n")
            out.append(ValueError("refused") if p in self.refuse else p.upper())
        if self.fail_at is not None and len(self.sent()) == self.fail_at:
            # The task's process dies here; its answers so far are with the journal.
            self.log += ".killed"
            os._exit(1)
        return out


def leads(spark, names, parts=3):
    return spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], LEADS).repartition(parts)


def texts(df):
    return {r.row_id: r.generated_email for r in df.collect()}


def test_each_prompt_is_sent_once(spark, tmp_path):
    model, journal = Model(tmp_path / "log"), str(tmp_path / "journal")
    names = [f"shop {i % 20}" for i in range(60)]
    out = generate(leads(spark, names), model, TEMPLATE, journal=journal)
    want = {i: n.upper() for i, n in enumerate(names)}
    assert texts(out) == want and texts(out) == want  # an action more calls nothing
    assert sorted(model.sent()) == sorted(set(names))
    more = [*names, "new one"]
    assert texts(generate(leads(spark, more), model, TEMPLATE, journal=journal)) == {i: n.upper() for i, n in enumerate(more)}
    assert sorted(model.sent()) == sorted({*more})
    left = files.names(spark, journal)
    assert not [n for n in left if n.startswith("calls-")]


def test_rows_with_a_text_are_left_alone(spark, tmp_path):
    model = Model(tmp_path / "log")
    df = spark.createDataFrame([(1, "a", "kept"), (2, "b", " "), (3, "c", None), (4, "d", "Error: LLM error: x")], LEADS)
    run = lambda **kw: texts(generate(df, model, TEMPLATE, journal=str(tmp_path / "j"), **kw))
    assert run() == {1: "kept", 2: "B", 3: "C", 4: "Error: LLM error: x"} and sorted(model.sent()) == ["b", "c"]
    assert run(retry_errors=True) == {1: "kept", 2: "B", 3: "C", 4: "D"} and sorted(model.sent()) == ["b", "c", "d"]


def test_failures_are_not_journaled(spark, tmp_path):
    journal, names = str(tmp_path / "journal"), ["good", "bad", "fine"]
    first = Model(tmp_path / "log", refuse=("bad",))
    assert texts(generate(leads(spark, names), first, TEMPLATE, journal=journal)) == {0: "GOOD", 1: "Error: LLM error: refused", 2: "FINE"}
    second = Model(tmp_path / "log2")
    assert texts(generate(leads(spark, names), second, TEMPLATE, journal=journal)) == {0: "GOOD", 1: "BAD", 2: "FINE"}
    assert second.sent() == ["bad"]


@pytest.mark.parametrize("batch_rows", [1, 3])
def test_a_killed_run_is_continued_without_repeats(spark, tmp_path, batch_rows):
    """local mode gives a task one attempt, so the job fails; the answers of finished calls survive it."""
    journal, names = str(tmp_path / "journal"), [f"shop {i}" for i in range(30)]
    dying = Model(tmp_path / "log", fail_at=12)
    with pytest.raises(Exception):
        texts(generate(leads(spark, names), dying, TEMPLATE, journal=journal, batch_rows=batch_rows, partitions=1))
    sent = dying.sent()
    told = journaled(spark, files.qualified(spark, journal)).count()
    assert len(sent) == 12 and told == 12 - batch_rows  # all but the call that died
    after = Model(tmp_path / "log2")
    assert texts(generate(leads(spark, names), after, TEMPLATE, journal=journal, batch_rows=batch_rows)) == {i: n.upper() for i, n in enumerate(names)}
    assert len(set(sent) & set(after.sent())) == batch_rows and len(after.sent()) == 30 - told


def test_a_repeated_task_reads_what_its_first_attempt_was_told(tmp_path):
    from canvass.operators.generate import Calls

    folder = (tmp_path / "calls-1" / "0").as_uri()
    first = Calls(folder, "7")
    first.add([("h1", "A"), ("h2", 'quote " and\nline')])
    first.add([("h3", "é")])
    (tmp_path / "calls-1" / "0" / "7-00000002.part").write_text('{"_hash": "h4"')  # cut off while written
    assert Calls(folder, "8").answered() == {"h1": "A", "h2": 'quote " and\nline', "h3": "é"}


def test_no_pending_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "kept")], LEADS)
    model = Model(tmp_path / "log")
    assert texts(generate(df, model, TEMPLATE, journal=str(tmp_path / "j"))) == {1: "kept"} and model.sent() == []
    assert generate(df.where(F.lit(False)), model, TEMPLATE, journal=str(tmp_path / "j")).collect() == []
