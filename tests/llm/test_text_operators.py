"""Operators on documents against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from canvass.llm import hmm
from canvass.llm.common import crc_remainder
from canvass.llm.components import components
from canvass.llm.decontaminate import decontaminate
from canvass.llm.langid import identify, train
from canvass.llm.lines import line_dedup
from canvass.llm.mixing import mix
from canvass.llm.repeats import remove_repeats
from canvass.llm.setjoin import jaccard_components
from canvass.llm.surrogates import pseudonymise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, row_key string"


def make(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, None, sources[i] if sources else f"s{i % 3}", 0, 1, "x", "y")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def babble(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = babble(1, 120)
    words = base.split()
    near = words[:]
    near[5] = "other"
    shared = babble(2, 60)
    return [
        base, base, " ".join(near), None, "", " \t\n", "one", "One", "one two three", "ONE two\tthree",
        babble(3, 50) + " " + shared + " " + babble(4, 10), shared + " x " + babble(5, 20),
        "Ünïcödé 　 ideographic space stays inside a word " * 3, "x " * 90, babble(6, 3000) + "\r\n" + shared,
        babble(7, 34), babble(8, 35), babble(8, 35), "\x1f\x00 control " + babble(9, 40),
    ]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_substring_dedup(spark, texts):
    width, starts = 35, defaultdict(list)
    ws = [words_of(t) for t in texts]
    for i, w in enumerate(ws):
        for at in range(len(w) - width + 1):
            starts[tuple(w[at:at + width])].append((i, at))
    gone = [set() for _ in ws]
    for places in starts.values():
        if len(places) > 1:
            for i, at in places:
                gone[i].update(range(at, at + width))
    want = sorted((i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g))
                  for i, (w, g) in enumerate(zip(ws, gone)))
    got = remove_repeats(make(spark, texts), shard_bytes=4096).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got) == want
    assert next(r for r in got if r.doc_id == 3).text is None
    assert {r.row_key for r in got} == {"y"}


def test_substring_dedup_with_a_full_sketch(spark, texts):
    """A sketch far too small flags nearly every window and changes nothing."""
    some = remove_repeats(make(spark, texts), max_cells=1 << 16, cells_per_byte=1 / 8)
    tiny = remove_repeats(make(spark, texts * 2).where("doc_id < 19"), max_cells=1, cells_per_byte=1)
    assert sorted(map(str, some.collect())) == sorted(map(str, tiny.collect()))


def test_substring_dedup_empty(spark):
    assert remove_repeats(make(spark, ["a"]).limit(0)).collect() == []


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = [lower(x) for x in words_of(t)]
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted(((ids[i], len(sets[i]), least.get(find(i))) for i in range(len(sets))), key=str)


def test_jaccard_components(spark, texts):
    ids = [None if i == 7 else 3 if i == 9 else i for i in range(len(texts))]
    got = jaccard_components(make(spark, texts, ids))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(texts, ids)


def test_jaccard_chains_of_near_copies(spark):
    """Groups of near copies at all similarities, where components hang on single links."""
    r = random.Random(5)
    out = []
    for g in range(6):
        base = babble(g, 90, 3000).split()
        for _ in range(14):
            w = base[:]
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
            out.append(" ".join(w[: len(w) - r.randrange(0, 12)]))
            if r.random() < 0.3:
                base = w
    ids = list(range(len(out)))
    got = jaccard_components(make(spark, out))
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()), key=str) == brute_components(out, ids)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_decontaminate(spark, texts):
    items = [(1, texts[14][40:200]), (10, "one"), (2, babble(2, 60)), (None, babble(3, 13)), (4, None), (5, " ., "),
             (2, babble(2, 60)), (6, "TWO, three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = norm(t)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[at:at + 13])].add("" if i is None else str(i))
    want = []
    for d, t in enumerate(texts):
        w, hit, ids = norm(t), set(), set()
        for win, found in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at:at + len(win)]) == win:
                    hit.update(range(at, at + len(win)))
                    ids |= found
        want.append((d, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    spans = []
    for bound in (1 << 20, 400, 150):  # one automaton, then several
        docs = make(spark, texts).withColumn("__key", F.lit(1)).withColumn("extra", F.create_map("doc_id", F.lit("m")))
        got = decontaminate(docs, bench, max_bytes=bound).collect()
        assert all(r["__key"] == 1 and (r.doc_id is None or r.extra == {r.doc_id: "m"}) for r in got)
        spans.append(sorted((r.doc_id, [tuple(s) for s in r.hit_spans]) for r in got))
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in got) == want
    assert spans[0] == spans[1] == spans[2] and any(len(x) for _, x in spans[0])
    for r in got:
        covered = [w for s in r.hit_spans for w in norm(r.text[s.start:s.end])]
        assert len(set(covered)) <= r.n_hit <= len(covered) + r.n_words
    assert decontaminate(make(spark, ["a"]).limit(0), bench).collect() == []
    assert decontaminate(make(spark, ["a"]), bench.limit(0)).first().n_hit == 0


def test_shards_join_spans_that_overlap_or_touch(spark):
    """Each item is a shard of its own; one automaton and many give one span, and copies keep their own columns."""
    bench = spark.createDataFrame([(1, "aa bb cc dd"), (2, "cc dd ee ff"), (3, "gg hh"), (4, "zz")], "item_id long, text string")
    docs = make(spark, ["x aa bb cc dd ee ff gg hh y zz zz", "gg hh gg hh", "ee ff", "gg hh gg hh", None, ""])
    whole, parts = ([tuple(map(str, r)) for r in decontaminate(docs, bench, max_bytes=b).orderBy("doc_id").collect()] for b in (1 << 20, 3))
    assert whole == parts
    r = decontaminate(docs, bench, max_bytes=3).orderBy("doc_id").first()
    assert [tuple(x) for x in r.hit_spans] == [(2, 25), (28, 33)] and (r.n_words, r.n_hit, r.hit_items) == (12, 10, ["1", "2", "3", "4"])


def test_spans_name_the_original_characters(spark):
    bench = spark.createDataFrame([(1, "crème brûlée")], "item_id long, text string")
    r = decontaminate(make(spark, ["Ünd CRèME, brûlée!"]), bench).first()
    assert [r.text[s.start:s.end] for s in r.hit_spans] == ["CRèME, brûlée"]


def test_line_dedup(spark):
    lines = ["Shared footer", "mid", "own"]
    texts = [f"{lines[0]}\n text {i}\n\n{lines[1] if i % 2 else ''}" for i in range(24)] + ["Shared footer", None, "", "\n"]
    sources = [f"s{i % 12}" for i in range(24)] + [None, "s1", None, None]
    got = {r.doc_id: r for r in line_dedup(make(spark, texts, sources=sources), min_sites=10).collect()}
    for i in range(24):
        # 'mid' is on six sites only.
        assert got[i].text == f" text {i}\n\n{lines[1] if i % 2 else ''}" and got[i].n_lines_removed == 1
    assert got[24].text == "Shared footer" and got[24].n_lines_removed == 0
    assert (got[25].text, got[26].text, got[27].text) == (None, "", "\n")


def test_line_dedup_counts_exactly_at_the_threshold(spark):
    for sites, gone in ((9, 0), (10, 1), (11, 1)):
        docs = make(spark, [f"same\nrow {i}" for i in range(sites)], sources=[f"s{i}" for i in range(sites)])
        assert {r.n_lines_removed for r in line_dedup(docs, min_sites=10).collect()} == {gone}


def test_mix(spark):
    texts = [babble(i, 1 + i * 7 % 90) for i in range(300)] + [None, "", babble(3, 5000)]
    sources = [["a", "b", "c", "ä", None][i % 5] if i % 4 else "a" for i in range(302)] + ["c"]
    docs = make(spark, texts, sources=sources)
    got = mix(docs, block_words=64).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted((r.doc_id, r.size, r.taken) for r in mix(docs, block_words=64).collect())
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(words_of(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.size == len(words_of(r.text)) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 64
    assert mix(docs.limit(0)).collect() == []


def test_language_id(spark):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(200)] for lang in ("xx", "yy", "zz")}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "", "xx"), (902, "12 !?", "xx"), (903, "x" * 50_000, None)],
                                 "doc_id long, text string, lang string")
    held = crc_remainder(F.col("doc_id"), 3) == 1
    got = {x.doc_id: x for x in identify(docs, train(docs.where(~held))).withColumn("held", held).collect()}
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    out = [got[i].lang_pred == lang for i, _, lang in rows if got[i].held]
    assert sum(out) / len(out) > 0.98 and not any(got[i].rejected for i, _, _ in rows)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert {x.lang_pred for x in identify(docs, {}).collect()} == {"und"}
    assert identify(docs.limit(0), train(docs.limit(0))).collect() == []


def test_short_clean_texts_pass_the_language_stage(spark):
    import corpus_pipeline as c

    r = random.Random(4)
    sound = {"de": "bcdfg", "en": "hjklm", "es": "npqrs", "fr": "tvwxz"}
    words = {lang: ["".join(r.choice(s) + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(150)]
             for lang, s in sound.items()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n)).capitalize() + "."
    rows = [(i, text(lang, 80), lang) for i, lang in enumerate(list(words) * 100)]
    short = [(1000 + i, text(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in words for n in range(1, 11) for _ in range(4))]
    docs = spark.createDataFrame(rows + short, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in c.language_id(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows + short}
    got = {x.doc_id: x for x in identify(docs, train(docs.where("doc_id < 1000"))).where("doc_id >= 1000").collect()}
    assert [got[i].lang_pred for i, _, _ in short] == [lang for _, _, lang in short]


def test_training_pieces_come_from_the_whole_text(spark):
    rows = [(i, "head " * 60 + "middle " * 60 + "tail " * 60, "xx") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = train(docs)["xx"]
    assert all(content.count(w) > 50 for w in (b"head", b"middle", b"tail"))
    assert len(train(docs, dict_bytes=1000)["xx"]) == 1000


def brute_forward(model, s):
    a = model.start * model.emit[:, s[0]]
    total = 0.0
    for c in s[1:]:
        total += math.log10(a.sum())
        a = (a / a.sum()) @ model.move * model.emit[:, c]
    return total + math.log10(a.sum())


def test_scaled_forward_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    model = hmm.Model.initial(4, r.random(30))
    sequences = [r.integers(0, 30, n).astype(np.int32) for n in (1, 2, 7, 64, 65, 300, 1000)]
    got = hmm.sequence_log10(model, sequences, 16)
    for s, g in zip(sequences, got):
        assert math.isclose(g, brute_forward(model, s), rel_tol=1e-10)


def test_expected_counts_by_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(4)
    model = hmm.Model.initial(2, r.random(3))
    s = np.array([0, 2, 1, 1, 0], np.int32)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    total = 0.0
    for path in itertools.product(range(2), repeat=len(s)):
        p = model.start[path[0]] * np.prod([model.emit[z, c] for z, c in zip(path, s)])
        p *= np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        start[path[0]] += p
        for z, c in zip(path, s):
            emit[z, c] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
    got = hmm.expected_counts(model, [s], 16)
    for a, b in zip(got, (start / total, move / total, emit / total)):
        assert np.allclose(a, b)
    assert math.isclose(got[3], math.log(total))


def test_hidden_markov_scores(spark):
    texts = [babble(i, 5 + i % 40, 60) + (" Ünknown X%d" % i if i % 9 == 0 else "") for i in range(150)] + [None, "", "new words only"]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in hmm.score(docs, crc_remainder(F.col("doc_id"), 7) == 2, head=30, suffix_classes=8,
                                          states=3, rounds=2, segment=8).collect()}
    tok = [[lower(w) for w in words_of(t)] + [""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tok):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    none = hmm.score(docs, F.lit(True), head=5, suffix_classes=4, states=2, rounds=1).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 for r in none)
    assert hmm.score(docs.limit(0), F.lit(False), head=5, suffix_classes=4, rounds=1).collect() == []


def test_surrogates(spark):
    texts = [
        "Mail BOB.Smith@Mail6.Example.com or bob.smith@mail6.example.com, ann@mail6.example.com.",
        "Call +1 (456) 555-2186, 456-555-2186; card 4524132264652876 = 4524 1322 6465 2876, not 4524132264652877.",
        "From 10.0.3.7 to 42.144.35.254; SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00.",
        "Mr. John Smith met Mrs. Smith and Mary Brown. Екатерина Иванова.",
        "Licensed under CC BY-NC 4.0, 2024-01-02, 1234567890123.", None, "",
    ]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in pseudonymise(docs, "k").collect()}
    assert [got[i].text for i in (4, 5, 6)] == texts[4:] and [got[i].n_entities for i in range(7)] == [3, 4, 4, 4, 0, 0, 0]
    a, b, c = re.findall(r"[\w.]+@[\w.]+\.com", got[0].text)
    assert a.lower() == b and c.split("@")[1] == b.split("@")[1] and c.split("@")[0] != b.split("@")[0]
    assert re.fullmatch(r"[A-Z]{3}\.[A-Z][a-z]{4}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", a) and "smith" not in b
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4}); card (\d{16}) = ([\d ]{19}), not 4524132264652877\.", got[1].text)
    assert m and m.groups()[:3] == m.groups()[3:6] and m[7] == m[8].replace(" ", "") != "4524132264652876"
    digits = [int(x) for x in reversed(m[7])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    m = re.fullmatch(r"From (10\.\d+\.\d+\.\d+) to (\d+\.\d+\.\d+\.\d+); SSN (9\d\d-\d\d-\d{4}); IBAN (DE\d\d [\d ]{22})\.?", got[2].text)
    assert m and m[1] != "10.0.3.7"
    iban = m[4].replace(" ", "")
    assert int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1
    from canvass.llm.surrogates import GIVEN, SURNAMES
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and (\w+) (\w+)\. (\w+) (\w+)\.", got[3].text)
    assert m[1] in GIVEN["m", "latin"] and m[4] in GIVEN["f", "latin"] and m[2] == m[3] != m[5] and m[2] in SURNAMES["latin"]
    assert m[6] in GIVEN["f", "cyrillic"] and m[7].endswith("а")
    assert got[0].text != {r.doc_id: r for r in pseudonymise(docs, "other").collect()}[0].text


def test_surrogates_stay_distinct_when_the_space_is_small(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = make(spark, [f"{x}@q.de and again {x.upper()}@q.de" for x in letters])
    got = {r.doc_id: re.findall(r"(\w+)@", r.text) for r in pseudonymise(docs, "k").collect()}
    assert all(a == b.lower() for a, b in got.values())
    assert len({a for a, _ in got.values()}) == 26
    assert not {a for a, _ in got.values()} & set(letters)


def test_digest_of_no_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_slots_of_one_source_are_made_by_many_tasks(spark):
    from canvass.llm.mixing import _schedule, lattice_step

    quotas = [("sa", 900, 7), ("sb", 90, 40), ("n", 10, 3)]
    low, rows, want = 0, [], []
    m = sum(q for _, q, _ in quotas)
    slot_of = {i * lattice_step(m) % m: i for i in range(m)}
    for src, quota, n in quotas:
        rows.append((src, quota, low, n))
        want += [(slot, src, r // n, r % n) for r, slot in enumerate(sorted(slot_of[low + j] for j in range(quota)))]
        low += quota
    blocks = spark.createDataFrame(rows, "__src string, __quota long, __low long, __n long").coalesce(1)
    for chunk, slots_per_task in ((16, 50), (1 << 16, 1 << 20)):
        got = _schedule(blocks, chunk, slots_per_task)
        assert sorted((r["slot"], r["__src"], r["epoch"], r["block"]) for r in got.collect()) == sorted(want)
    plan = _schedule(blocks, 16, 50)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and ", 21" in plan
