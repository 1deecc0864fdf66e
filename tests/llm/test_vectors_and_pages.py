"""Top-k search and page extraction against brute force; the pipeline's stages."""

import math
import random

from canvass.llm.mainhtml import blocks, covering, enough, extract, window_spread
from canvass.llm.pivots import top_k
from pyspark.sql import functions as F


def brute(rows, k, scale, queries):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            q = [math.floor(scale * c) for c in x]
            v[i] = min(v.get(i, q), q)
    out = []
    for q in sorted(v):
        if queries(q):
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -m) for r, (m, c) in enumerate(s)]
    return out


def search(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)
    got = top_k(df, F.col("id") % 10 == 0, **kw)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_top_k(spark):
    import numpy as np

    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * (1 + i % 3))) for _ in range(6)], "c") for i in range(400)]
    rows += [(400 + i, rows[7][1], "c") for i in range(120)]  # a crowd of equal vectors
    rows += [(900, None, "c"), (901, [1.0, None], "c"), (902, [float("nan")] * 6, "c"), (903, [float("inf")] * 6, "c"),
             (None, [1.0] * 6, "c"), (910, [], "c"), (920, [0.5, 2.0], "c"), (30, rows[31][1], "c"), (10, rows[10][1], "c")]
    want = brute([(a, b) for a, b, _ in rows], 10, 1024, lambda q: q % 10 == 0)
    assert search(spark, rows, block=32, queries_per_block=8, pivots=6, slices=3) == want


def test_top_k_few_and_none(spark):
    rows = [(0, [1.0, 2.0], "c"), (10, [3.0, -1.0], "c"), (3, [1.0, 1.0], "c")]
    assert search(spark, rows) == brute([(a, b) for a, b, _ in rows], 10, 1024, lambda q: q % 10 == 0)
    assert search(spark, [(5, None, "c")]) == []


def test_huge_components_stay_exact(spark):
    rows = [(i, [float((-1) ** i * (1 + i) * 2.0 ** 13), 3.0], "c") for i in range(30)]
    assert search(spark, rows) == brute([(a, b) for a, b, _ in rows], 10, 1024, lambda q: q % 10 == 0)


def test_spread_of_runs_by_brute_force():
    import numpy as np

    r = np.random.default_rng(1)
    page = np.sort(r.integers(0, 9, 300))
    tokens = r.integers(0, 3, 300)
    got = np.maximum(covering(window_spread(tokens, page, 4), 4), 1)
    for i in range(300):
        best = 1
        for at in range(max(0, i - 3), min(i, 296) + 1):
            if page[at] == page[at + 3]:
                run = tuple(tokens[at:at + 4])
                best = max(best, len({page[j] for j in range(297) if page[j] == page[j + 3] and tuple(tokens[j:j + 4]) == run}))
        assert got[i] == best


def page_of(main, host=1, i=0):
    return (f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu {i}</li></ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div>{main}<aside>Side</aside><form><label>Mail</label><input></form>"
            f"<section id=comments><article class=comment><p>First!</p></article></section><footer>&copy; {host}</footer></body></html>")


def test_main_text_by_markup(spark):
    article = "<article><header><h1>A &amp;\n title</h1></header><p>One<b> two</b><br><p>Th&#233;\t ree &lt;x&gt;<div class=ad>Buy</div><p>4</article>"
    rows = [(1, "https://a.example/x", page_of(article)), (2, None, page_of(article)), (3, "https://a.example/y", None),
            (4, "https://a.example/z", ""), (None, "nonsense", "just text"), (6, "https://a.example/q", page_of("<main><p>m</p></main>")),
            (7, "https://a.example/r", "<p>a < b <3 <i>c<!-- x --> d"), (1, "https://a.example/x", page_of(article))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(df).collect())
    main = "A & title\nOne two\nThé ree <x>\n4"
    want = [("1", main), ("1", main), ("2", main), ("3", ""), ("4", ""), ("None", "just text"), ("6", "m"), ("7", "a < b <3 c d")]
    assert got == sorted((a, b, len(b)) for a, b in want)
    assert extract(df.limit(0)).collect() == []


def test_unmarked_template_is_found_by_repetition(spark):
    r = random.Random(3)
    own = [" ".join(f"w{r.randrange(5000)}" for _ in range(30)) for _ in range(60)]
    note = "This site is brought to you by the friends of the old town library"
    rows = [(i, f"https://h.example/{i}", f"<body><div>{note}</div><div>{t}</div><div>{t[:9]} {note}</div></body>") for i, t in enumerate(own)]
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string"),
                                              pages_per_group=40).collect()}
    assert got == {i: f"{t}\n{t[:9]}" for i, t in enumerate(own)}


def test_copied_articles_are_no_template(spark):
    text = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"https://h.example/{i}", f"<article><p>{text if i < 15 else f'own {i}'}</p></article>") for i in range(60)]
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text if i < 15 else f"own {i}" for i in range(60)}


def test_a_host_of_mostly_copies_keeps_its_articles(spark):
    text = " ".join(f"c{i}" for i in range(40))
    shared = "This section stands in every article of the host and belongs to it"
    rows, want = [], {}

    def host(name, n, page, main):
        for i in range(n):
            k = len(rows)
            rows.append((k, f"https://{name}.example/{i}", f"<body><nav>Menu {i}</nav>{page(i)}</body>"))
            want[k] = main(i)

    body = lambda i: text if i < 10 else f"own {i}"
    for tag in ("article", "main", "div"):
        host(tag, 12, lambda i: f"<{tag}><p>{body(i)}</p></{tag}>", body)
    host("article-near", 12, lambda i: f"<article><p>{text} session {i}</p></article>", lambda i: f"{text} session {i}")
    host("main-near", 12, lambda i: f"<main><p>{text} session {i}</p></main>", lambda i: f"{text} session {i}")
    host("section", 30, lambda i: f"<article><p>own text {i}</p><p>{shared}</p></article>", lambda i: f"own text {i}\n{shared}")
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == want
    # Kept in an article, but told: the shared section has thirteen words.
    assert all(x.n_repeated == 13 for x in got if "/section." in x.url) and sum("/section." in x.url for x in got) == 30


def test_blocks_of_broken_markup():
    assert blocks("<div><p class=ad>x<p>y</div>z</b></span>") == [("x", 0), ("y", 1), ("z", 1)]
    assert blocks("<script>never closed <p>x") == []


def test_sections_named_like_furniture_stay_in_an_article():
    article = ("<article id=discussion-paper aria-label='Reply to a critic'><section id=discussion><p>one</p></section>"
               "<h2 id=related-work>two</h2><h2 id=search-results>three</h2><section id=comments class=social-policy>four</section>"
               "<p class=ad-hoc>five</p><figure aria-label='Share of exports'>six</figure><p data-id=ad>seven</p>"
               "<p>so <math><mi>x</mi><mo>&lt;</mo><mn>8</mn><annotation encoding=tex>x < 8</annotation></math></p>"
               "<xmp>nine <b>&amp;</xmp></article>")
    kept = ["one", "two", "three", "four", "five", "six", "seven", "so x<8", "nine <b>&amp;"]
    assert blocks(article) == [(t, 3) for t in kept]
    for furniture in ("<div class=ad>f</div>", "<div class='x ad-slot'>f</div>", "<div id=share-bar>f</div>", "<ul class='social-links'><li>f</ul>",
                      "<div id=comments>f</div>", "<ol class=comment-list><li>f</ol>", "<div role=navigation>f</div>",
                      "<article class='comment even'>f</article>", "<xmp class=ad>f</xmp>"):
        assert [t for t, kind in blocks(f"<article>a{furniture}<p>b</article>") if kind] == ["a", "b"]
    assert blocks("<div id=related-links>f</div><div class=site-search>g</div>") == [("f", 0), ("g", 0)]


def test_hostile_markup_takes_linear_time():
    import time

    for piece in ("<a ", '<a x="', '<a x=">" ', "<div>", "<svg>", "<!--", "<!", "<script>", "</x>", "<p><span>", "&#", "class='"):
        page = piece * (1_000_000 // len(piece))
        for tail in ("", ">"):
            start = time.time()
            blocks(page + tail)
            assert time.time() - start < 10, piece  # a quadratic scan takes hours
    blocks("<div>" * 100_000 + "</x>" * 100_000)
    blocks("<span>" * 50_000 + "<br>" * 50_000)


def test_blocks_of_odd_tags():
    assert blocks('<article>a <svg class="i"/>b<p>c</article>') == [("a b", 3), ("c", 3)]
    assert blocks("<p>a <svg>b</p><p>c") == [("a b", 1), ("c", 1)] and blocks("<p>c <SVG><text>d</text></SVG> e") == [("c e", 1)]
    assert blocks("<p>a <noscript>b</p><p>c") == [("a b", 1), ("c", 1)]
    assert blocks('<p title="class=ad">x</p><p title="a>b">y</p><p it\'s>z\'s</p><p a="q>v') == [(c, 1) for c in ("x", "y", "z's", "v")]
    assert blocks("<p>a <b c='d") == [("a <b c='d", 1)]
    assert blocks("İİ<script>x</SCRIPT >ok<textarea><p>n</textarea>") == [("İİok", 1)]
    assert blocks(f"&#{'9' * 6000}; &#{'0' * 6000}65; &#x{'F' * 6000} &#x0041;&#65 &#;") == [("� A � AA &#;", 1)]


def test_main_beside_an_article(spark):
    text = "The text of the page itself, which is longer than what it announces"
    rows = [f"<main><h1>Head</h1><p>{text}</p><article>Teaser</article></main>",
            f"<main><h1>Head</h1><article>{text}</article><section class=related>More</section></main>",
            f"<main id=app>x</main><article>{text}</article>", f"<article>t</article><main>{text}</main>",
            f"<article><main>{text}</main><p>after</p></article>", f"<div role=main>{text}<div class=related>r</div></div>"]
    df = spark.createDataFrame([(i, f"https://h{i}.example/", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    rows = extract(df).collect()
    got = {x.page_id: x.text for x in rows}
    assert all(x.n_repeated == 0 and x.n_chars == len(x.text) for x in rows)
    assert got == {0: f"Head\n{text}\nTeaser", 1: f"Head\n{text}", 2: text, 3: text, 4: text, 5: f"{text}\nr"}


def brute_force_extract(pages, min_tokens=8, min_pages=10, share=0.1):
    """Texts of pages of plain blocks: every run of a host counted over its distinct texts."""
    hosts, out = {}, {}
    for _, host, lines in pages:
        hosts.setdefault(host, set()).add("\n".join(lines))
    for host, texts in hosts.items():
        counts = {}
        for t in texts:
            w = t.split()
            for run in {tuple(w[i:i + min_tokens]) for i in range(len(w) - min_tokens + 1)}:
                counts[run] = counts.get(run, 0) + 1
        limit = enough(len(texts), share, min_pages)
        for i, own, lines in pages:
            if own == host:
                w = " ".join(lines).split()
                gone = {k for j in range(len(w) - min_tokens + 1) if counts[tuple(w[j:j + min_tokens])] >= limit for k in range(j, j + min_tokens)}
                kept, at = [], 0
                for line in lines:
                    n = len(line.split())
                    kept.append(" ".join(w[k] for k in range(at, at + n) if k not in gone))
                    at += n
                out[i] = "\n".join(k for k in kept if k)
    return out


def test_repetition_by_brute_force_on_hosts_of_any_size(spark):
    r = random.Random(9)
    pages = []
    for host, n in (("two", 2), ("three", 3), ("nine", 9), ("some", 40), ("large", 1500)):
        notes = [" ".join(f"{host}{k}n{j}" for j in range(r.randrange(6, 15))) for k in range(4)]
        for i in range(n):
            own = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 30))) for _ in range(3)]
            # The notes stand on all, about every sixth, every tenth and every twentieth page; some pages are copies.
            lines = [note for note, every in zip(notes, (1, 6, 10, 20)) if r.randrange(every) == 0] + own
            r.shuffle(lines)
            pages.append((len(pages), host, lines))
            if r.randrange(5) == 0:
                pages += [(len(pages) + k, host, lines) for k in range(r.randrange(1, 4))]
    df = spark.createDataFrame([(i, f"https://{h}.example/{i}", "".join(f"<p>{x}</p>" for x in lines)) for i, h, lines in pages],
                               "page_id long, url string, html string").repartition(3)
    want = brute_force_extract(pages)
    assert any(want[i] != "\n".join(lines) for i, _, lines in pages)
    for size in (5, 256, 100000):
        assert {x.page_id: x.text for x in extract(df, pages_per_group=size).collect()} == want


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for name, apply in c.STAGES:
        before, docs = docs, apply(spark, docs, sf).cache()
        n.append(docs.count())
        assert n[-1] <= n[-2]
        if name != c.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert n[2] == n[1] and n[3] < n[2] and n[4] < n[3]
    assert docs.where("taken = 0 or taken > 3 * size").count() == 0
    run = c.run(spark, sf).select("doc_id", "taken").collect()
    assert sorted(run) == sorted(docs.select("doc_id", "taken").collect())


def test_pipeline_joins_near_copies_over_five_words_at_80_percent(spark):
    import corpus_pipeline as c

    words = [f"w{i}" for i in range(104)]
    with_passage = lambda name, n: " ".join(words[:50] + [f"{name}{i}" for i in range(n)] + words[50:])
    # 96 of 117 shingles of five words are shared (0.82), 98 of 117 of four (0.84); 96 of 124 of five (0.77).
    rows = [(1, " ".join(words)), (2, with_passage("a", 13)), (3, with_passage("b", 20)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
