"""Staged runs that are stopped and continued: finished stages are read, not run again."""

import os

import pytest

from canvass.plans import run as plan
from canvass.plans.run import fingerprint, previewed, run, run_preview, run_rest
from canvass.sources import files

LEADS = "row_id bigint, company_name string, company_address string, website string, rating double, review_count bigint"
PLACES = "place_id string, name string, address string, rating double, review_count bigint, maps_url string"


class Model:
    def __init__(self, log, fail=False):
        self.log, self.fail = str(log), fail

    def __call__(self, prompts):
        with open(self.log, "a", encoding="utf-8") as f:
            f.writelines(p + "\n" for p in prompts)
        if self.fail:
            os._exit(1)
        return [p.upper() for p in prompts]

    def sent(self):
        return sorted(open(self.log, encoding="utf-8").read().split()) if os.path.exists(self.log) else []


@pytest.fixture
def tables(spark):
    leads = spark.createDataFrame([(i, f"Shop{i}", "Main St", f"s{i}.example", None, None) for i in range(25)], LEADS)
    places = spark.createDataFrame([(f"p{i}", f"Shop{i}", "Main St", 4.0, i, "u") for i in range(25)], PLACES)
    pages = spark.createDataFrame([(f"https://s{i}.example", f"<title>T{i}</title><p>Text {i}</p>") for i in range(25)],
                                  "url string, html string")
    return leads, dict(places=places, pages=pages, template="{company_name}:{rating}:{research_brief}"[:24])


def counted(monkeypatch):
    calls = []
    for name in ("enrich_reviews", "enrich_web"):
        real = getattr(plan, name)
        monkeypatch.setattr(plan, name, lambda *a, real=real, name=name, **kw: calls.append(name) or real(*a, **kw))
    return calls


def test_fingerprints_follow_rows_not_order(spark):
    rows = [(i, f"n{i}", None if i % 3 else [i], {"a": i}) for i in range(50)]
    schema = "a long, b string, c array<int>, d map<string,int>"
    base = fingerprint(spark.createDataFrame(rows, schema).repartition(3))
    assert base == fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(5))
    for other in (rows[1:], [*rows, rows[0]], [*rows[1:], (0, None, [0], {"a": 0})]):
        assert fingerprint(spark.createDataFrame(other, schema)) != base
    two = spark.createDataFrame([("x", None)], "a string, b string"), spark.createDataFrame([(None, "x")], "a string, b string")
    assert fingerprint(two[0]) != fingerprint(two[1])


def test_a_run_stopped_in_the_third_stage_reuses_the_others(spark, tables, tmp_path, monkeypatch):
    leads, settings = tables
    ledger, calls = str(tmp_path / "ledger"), counted(monkeypatch)
    with pytest.raises(Exception):
        run(leads, generator=Model(tmp_path / "l1", fail=True), ledger=ledger, **settings).collect()
    assert calls == ["enrich_reviews", "enrich_web"]
    model = Model(tmp_path / "l2")
    out = run(leads, generator=model, ledger=ledger, **settings)
    assert calls == ["enrich_reviews", "enrich_web"] and len(model.sent()) == 25
    assert {r.generated_email.split(":")[1] for r in out.collect()} == {"4.0"}
    run(leads, generator=model, ledger=ledger, **settings).collect()
    assert len(model.sent()) == 25  # the third stage is in the ledger too
    changed = leads.where("row_id > 0")
    run(changed, generator=model, ledger=ledger, **settings).collect()
    assert len(calls) == 4 and len(model.sent()) == 49  # other rows are another run


def test_the_rest_finds_where_the_preview_stopped(spark, tables, tmp_path, monkeypatch):
    leads, settings = tables
    ledger, model = str(tmp_path / "ledger"), Model(tmp_path / "log")
    first = run_preview(leads, n=10, generator=model, ledger=ledger, **settings).collect()
    assert sum(r.generated_email is not None for r in first) == 10 and previewed(leads, ledger) == 10
    done = {r.row_id: r.generated_email for r in run_rest(leads, generator=model, ledger=ledger, **settings).collect()}
    assert len(done) == 25 and None not in done.values() and len(model.sent()) == 25  # no prompt twice
    assert {r.row_id: r.generated_email for r in first if r.generated_email} == {i: done[i] for i in range(10)}
    assert previewed(leads.where("row_id < 5"), ledger) == 0
    with pytest.raises(ValueError, match="ledger"):
        run_rest(leads, **settings)


def test_a_preview_of_all_rows_is_followed_by_a_whole_run(spark, tables, tmp_path):
    leads, settings = tables
    ledger = str(tmp_path / "ledger")
    run_preview(leads, n=100, ledger=ledger, **settings)
    assert sorted(r.row_id for r in run_rest(leads, ledger=ledger, **settings).collect()) == list(range(25))
    assert [n for n in files.names(spark, ledger) if n.startswith("preview-")]
