"""Surrogates where values are many, long, masked or short of room; odd tables."""

import re

import pytest

from canvass.llm.surrogates import pseudonymise

SCHEMA = "doc_id long, text string"


def run(spark, texts, schema=SCHEMA):
    df = spark.createDataFrame(list(enumerate(texts)), schema)
    return {r.doc_id: r.text for r in pseudonymise(df, "k").collect()}


def test_every_address_of_a_private_network(spark):
    texts = [" ".join(f"192.168.{a}.{b}" for b in range(256)) for a in range(256)]
    new = run(spark, texts)
    found = {r: re.findall(r"192\.168\.\d+\.\d+", new[r]) for r in new}
    old = [x for t in texts for x in t.split()]
    out = [x for r in range(256) for x in found[r]]
    assert len(out) == len(set(out)) == 65536 and all(a != b for a, b in zip(old, out))


def test_most_short_addresses_of_a_form(spark):
    old = [f"{a:x}::{b:x}" for a in range(16) for b in range(9)]
    new = run(spark, [" ".join(old)])[0].split()
    assert len(set(new)) == len(old) and all(re.fullmatch("[0-9a-f]::[0-9a-f]", x) for x in new)
    assert all(a != b for a, b in zip(old, new))


def test_masked_passwords_end(spark):
    new = run(spark, ["password: ******", "password: ########", "token=!!!!!!"])
    assert re.fullmatch(r"password: \*{6}[a-z]", new[0]) and re.fullmatch("password: #{8}[a-z]", new[1]) and re.fullmatch("token=!{6}[a-z]", new[2])


def test_long_values_are_replaced_whole(spark):
    secret, box = "aB3" * 67, "x" * 90
    host = ".".join(["h"] * 40) + ".example.org"
    got = run(spark, [f"secret={secret} end", f"mail {box}@q.org end", f"mail me@{host} end"])
    new = re.fullmatch(r"secret=(\S+) end", got[0])[1]
    assert len(new) == len(secret) and sum(a != b for a, b in zip(new, secret)) > 150
    assert "xxxx" not in got[1] and re.fullmatch(r"mail \S+@\S+\.org end", got[1])
    assert host not in got[2]


@pytest.mark.parametrize("number, code, other", [
    ("+33 1 23 45 67 89", "+33 ", "01 23 45 67 89"), ("+1 (456) 555-2186", "+1 (", "456-555-2186"),
    ("+49 30 1234 5678", "+49 ", None), ("+353 1 234 5678", "+353 ", None)])
def test_the_country_code_stays(spark, number, code, other):
    new = run(spark, [f"call {number} now"])[0][5:-4]
    assert new.startswith(code) and new != number and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", number)
    if other and re.fullmatch(r"[\d-]+", other):
        same = run(spark, [f"call {number} now", f"call {other} now"])
        assert re.sub(r"\D", "", same[1]) == re.sub(r"\D", "", same[0])[1:]


def test_odd_tables(spark):
    assert run(spark, []) == {}
    rows = [(None, "a@b.org", 1, "x"), (None, "a@b.org", 1, "x"), (1, None, 2, "y"), (2, "", 3, "z"), (3, "no entity " * 200_000, 4, "w"),
            (4, "word " * 100_000 + "a@b.org", 5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, __key string")
    got = pseudonymise(df, "k")
    assert sorted(got.columns) == ["__key", "doc_id", "n_entities", "text"]
    out = [tuple(r) for r in got.select("doc_id", "text", "n_entities", "__key").collect()]
    new = next(t for d, t, _, _ in out if d is None)
    assert new != "a@b.org" and sorted(out, key=repr) == sorted(
        [(None, new, 1, "x")] * 2 + [(1, None, 0, "y"), (2, "", 0, "z"), (3, rows[4][1], 0, "w"), (4, "word " * 100_000 + new, 1, "v")], key=repr)


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(i, f"10.0.{i}.1 a@b.org") for i in range(50)], SCHEMA)
    assert not re.search("Python|Pandas|Arrow", pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString())
