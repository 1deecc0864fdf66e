"""Operator 7: main text of web pages, with a suffix array per host.

Each page is cut into blocks by its markup: blocks in menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are marked as furniture by element name, role, class and id.  Inside
an article or ``main``, only whole class, id or role names of adverts, share
bars, comments and menus mark, and no id of a heading or section and no label:
there they are words of the article.  If the
page names its ``main``, the blocks inside it are the candidates, articles
in it included (beside an article, not those under a name that marks furniture
elsewhere); else, or if they hold more text, those inside ``article``; else
all that is not furniture.

Furniture that carries no such mark is found by repetition.  The token streams
of the candidate texts of a host are concatenated, a suffix array of the stream
brings equal runs together, and runs of at least ``min_tokens`` tokens that
occur in enough distinct texts of the host are covered.  Pages with the same
candidate text count once: copies of an article are no template.  Covered runs
are cut from candidate blocks and the unique runs stay.  "Enough" is
``open_share`` of the host's distinct texts for pages that name no article and
``named_share`` for those with a ``main``, but at least ``min_pages``, or half
of the texts where there are fewer than twice as many, and three in any case.
The text of an ``article`` stays whole, as does that of a ``main``
of which more than half would go (a near copy).

Text: character references decoded, white space in a block one space, blocks
in page order joined by newlines.

Defined cases: null or empty html gives an empty text; broken markup is read
leniently and in linear time (an unclosed element ends with its parent, an
unclosed comment, script or style with the page, a ``<`` without ``>`` is text,
an unclosed quote hides nothing); numeric references beyond Unicode are U+FFFD;
a url without host, or
null, belongs to the host ''; repeated rows are separate pages; null ids are
ordinary values; an empty table gives an empty result; other columns are not
carried.

Scale: pages are parsed where they are read, once, and their candidate texts
written compressed.  The distinct texts of a host, of any size, are dealt by
hash into groups of about ``pages_per_group`` texts and ``chars_per_group``
characters; copies are dropped before the shuffle.  Each group's suffix array
names the runs that are frequent enough there for the host to reach its
threshold, which loses none (the groups' counts add up), and a second pass counts those
exactly over all groups of the host.  So results do not depend on the dealing.
Only pages of hosts with such runs move again.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BASES, Words, byte_slices, run_hashes, ship, stage

#: A tag, its name and its attributes; a quote hides ">" only as a value's first character.  Possessive throughout, so an
#: attempt never goes back; what a failed one costs is bounded in ``blocks``.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NAMED = {"class", "id", "role", "aria-label"}
_LONG_REFERENCE = re.compile(r"&#(?:([xX])0*+([0-9a-fA-F]*+)|0*+([0-9]*+))(;?)")
_WORD = re.compile(r"[a-z0-9]+")
#: Elements whose content is not text, ended only by their own end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "annotation", "annotation-xml"}
#: Those of them that hold markup: without an end tag they are ignored, the others take the rest of the page.
_LOOSE_RAW = {"noscript", "template", "svg", "object", "annotation", "annotation-xml"}
_FOREIGN = {"svg", "annotation", "annotation-xml"}
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>]|$)", re.I | re.A) for t in (*_RAW, "xmp")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"nav", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "label"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
          "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp"}
#: Words of class, id, role or label that mark furniture.
_MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
          "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
          "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "sidebar", "aside", "complementary",
          "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer",
          "contentinfo", "comment", "comments", "reply", "replies", "discussion", "disqus", "share", "sharing",
          "social", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "login",
          "signup", "search", "skip", "copyright"}
_COMMENTS = re.compile(r"(?:comments?|repl(?:y|ies)|disqus)(?:[-_]+(?:\d+|list|section|area|thread|form|box|body|container|wrapper))?")
#: Whole class, id and role names that mark furniture inside an article.
_INSIDE = re.compile(
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adsbygoogle|sponsored|promo)"
    r"(?:[-_]+(?:box|slot|unit|banner|block|break|label|area|container|wrapper|\d+)s?)*"
    r"|(?:share|sharing|social)(?:[-_]+(?:share|sharing|bar|box|buttons?|links?|icons?|tools?|list|container|wrapper))*"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|complementary|contentinfo"
    r"|cookie[-_]?(?:notice|banner|consent|bar)|newsletter(?:[-_]+(?:signup|form|box))?|" + _COMMENTS.pattern)
_HEADED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}


def _names(attrs: str) -> list[tuple[str, str]]:
    """The (name, value) of class, id, role and label, lower-cased."""
    return [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs) if m[1].lower() in _NAMED]


def _marked(tag: str, named: list[tuple[str, str]], inside: bool) -> bool:
    if tag in _FURNITURE:
        return True
    if tag in ("header", "footer") and not (inside and tag == "header"):
        return True
    if tag in ("html", "body"):
        return False
    if inside or tag in ("article", "main"):
        marks = _COMMENTS if tag in ("article", "main") else _INSIDE
        return any(marks.fullmatch(word) for name, value in named for word in value.split()
                   if name in ("class", "role") or name == "id" and tag not in _HEADED)
    return _widely_marked(named)


def _widely_marked(named: list[tuple[str, str]]) -> bool:
    return any(word in _MARKS for _, value in named for word in _WORD.findall(value))


def _unescape(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, are U+FFFD."""
    def number(m):
        digits = m[2] or m[3] or ""
        if len(digits) > 7:
            return "�"
        return m[0] if not digits else f"&#{m[1] or ''}{digits}{m[4]}"
    return _html.unescape(_LONG_REFERENCE.sub(number, text) if "&#" in text else text)


FURNITURE, PLAIN, MAIN, ARTICLE, ARTICLE_IN_MAIN, BESIDE = range(6)


def _inner(kind: int, tag: str, main: bool) -> int:
    """Kind inside an element: article and main nest in either order."""
    if main or tag == "main":
        return {PLAIN: MAIN, ARTICLE: ARTICLE_IN_MAIN}.get(kind, kind)
    if tag == "article":
        return {PLAIN: ARTICLE, MAIN: ARTICLE_IN_MAIN, BESIDE: ARTICLE_IN_MAIN}.get(kind, kind)
    return kind


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) per block of a page, in one linear scan.

    Kinds: 0 furniture, 1 plain, 2 inside main, 3 inside an article, 4 inside an
    article inside main, 5 inside main under a name that marks furniture outside.
    Open elements are found by name, never by a walk up the stack; a ``<``
    that no ``>`` follows is text, and once all further ``>`` turn out to be
    quoted, quotes count no more.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    opened: dict[str, list[int]] = {}
    walls: list[int] = []  # places of the open block elements
    unended: set[str] = set()
    end, last, tags = len(page), page.rfind(">"), _TAG

    def flush():
        if parts:
            text = " ".join(_unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1]))
            parts.clear()

    def close(i: int):
        """Close the element at place i with all that is open inside."""
        while len(stack) > i:
            name, _ = stack.pop()
            opened[name].pop()
        while walls and walls[-1] >= i:
            walls.pop()

    at = 0
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            parts.append(page[at:stop])
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        m = None
        if at < last:
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
            m = tags.match(page, at)
            if m is None and tags is _TAG:
                m = _PLAIN_TAG.match(page, at)
                if m:
                    tags = _PLAIN_TAG
        if m is None:
            parts.append("<")
            at += 1
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag in _BLOCK:
                flush()
            if opened.get(tag):
                i = opened[tag][-1]
                # What is still open inside a closed element ends with it.
                if stack[-1][1] != stack[i - 1][1]:
                    flush()
                close(i)
            continue
        named = _names(attrs) if attrs else []
        kind = stack[-1][1]
        if tag in _RAW or tag == "xmp":
            if tag in _FOREIGN and attrs.endswith("/"):
                continue
            stop = None if tag in unended else _RAW_END[tag].search(page, at)
            if stop is None and tag in _LOOSE_RAW:
                unended.add(tag)
                continue
            stop = stop.start() if stop else end
            if tag == "xmp":
                # Text as it stands, without markup and references.
                flush()
                if not _marked(tag, named, kind > PLAIN):
                    parts.append(_html.escape(page[at:stop]))
                    flush()
            at = stop
            continue
        if tag in _BLOCK:
            flush()
            # A new block ends an open paragraph, a new item an open item.
            ends = ("p", "li") if tag == "li" else ("p", "dt", "dd") if tag in ("dt", "dd") else ("p",)
            if walls and stack[walls[-1]][0] in ends:
                close(walls[-1])
                kind = stack[-1][1]
        if tag in _VOID or attrs.endswith("/") and tag in ("p", "div", "span"):
            continue
        if kind == FURNITURE or _marked(tag, named, kind > PLAIN):
            inner = FURNITURE
        else:
            inner = _inner(kind, tag, any(name == "role" and "main" in value.split() for name, value in named))
            if inner == MAIN and kind == MAIN and _widely_marked(named):
                inner = BESIDE
        if inner != kind:
            flush()
        opened.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            walls.append(len(stack))
        stack.append((tag, inner))
    flush()
    return out


def candidates(page: list[tuple[str, int]]) -> tuple[set[int], set[int]]:
    """Kinds of the blocks that may be the page's main text, and those of them that repetition never cuts.

    What ``main`` holds, its articles included, or else the articles, or all
    that is no furniture.  Articles outside of ``main`` win if they hold more
    text.  In a ``main`` with an article, blocks under a name that marks
    furniture elsewhere are no candidates.
    """
    size = [0] * 6
    for text, kind in page:
        size[kind] += len(text)
    inside = size[MAIN] + size[ARTICLE_IN_MAIN] + (0 if size[ARTICLE_IN_MAIN] else size[BESIDE])
    if size[ARTICLE] > inside:
        return {ARTICLE}, {ARTICLE}
    if size[ARTICLE_IN_MAIN]:
        return {MAIN, ARTICLE_IN_MAIN}, {ARTICLE_IN_MAIN}
    if inside:
        return {MAIN, BESIDE}, set()
    return {PLAIN}, set()


def _suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling up to runs of at least ``depth`` tokens, and the rank of every suffix."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        behind = np.zeros(n, np.int64)
        behind[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        step *= 2
        if rank[order[-1]] == n - 1:
            break
    return order, rank


def window_spread(tokens: np.ndarray, page: np.ndarray, min_tokens: int) -> np.ndarray:
    """For every token, on how many distinct pages the run of ``min_tokens`` tokens that starts there occurs.

    ``min_tokens`` is a power of two, the depth at which doubling stops; 0
    where a run would cross into another page, where the stream is only glued.
    """
    n = len(tokens)
    if n < min_tokens:
        return np.zeros(n, np.int64)
    order, rank = _suffix_ranks(tokens, min_tokens)
    whole = np.zeros(n, bool)
    whole[:n - min_tokens + 1] = page[:n - min_tokens + 1] == page[min_tokens - 1:]
    # Equal ranks: suffixes that share their first min_tokens tokens.
    order = order[whole[order]]
    pair = order[np.lexsort((page[order], rank[order]))]
    g, p = rank[pair], page[pair]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    pages = np.bincount(g, weights=fresh, minlength=n).astype(np.int64)[rank]
    pages[~whole] = 0
    return pages


def covering(spread: np.ndarray, min_tokens: int) -> np.ndarray:
    """For every token, the largest spread of a run that covers it."""
    best = spread.copy()
    for back in range(1, min(min_tokens, len(spread))):
        best[back:] = np.maximum(best[back:], spread[:-back])
    return best


def _streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after another, and the text of every token."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in byte_slices(texts):
        w = Words(texts[lo:hi])
        hashes.append(w.hashes())
        owner.append(np.repeat(np.arange(lo, hi), np.diff(w.first)))
    return np.concatenate(hashes), np.concatenate(owner)


def _windows(tokens: np.ndarray, owner: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of every run of ``min_tokens`` tokens inside one text."""
    at = np.arange(max(0, len(tokens) - min_tokens + 1))
    at = at[owner[at] == owner[at + min_tokens - 1]]
    return at, run_hashes(tokens, at, at + min_tokens, BASES[1]).view(np.int64)


def enough(distinct: int, share: float, min_pages: int) -> int:
    """On how many of a host's distinct texts a run must occur to be cut: on half of few texts, then on
    ``min_pages``, then on ``share`` of them; on three at least."""
    return max(3, math.ceil(share * distinct), min(min_pages, (distinct + 1) // 2))


def cut_runs(text: str, fixed: list[bool], runs: np.ndarray, counts: np.ndarray, limit: int, named: bool,
             min_tokens: int) -> tuple[str, int]:
    """``text`` without the runs (sorted hashes and their counts) that occur on ``limit`` distinct texts of the host,
    and the number of tokens in such runs, cut or kept."""
    tokens, owner = _streams([text.encode()])
    at, h = _windows(tokens, owner, min_tokens)
    place = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
    spread = np.zeros(len(tokens), np.int64)
    spread[at] = np.where(runs[place] == h, counts[place], 0)
    gone = covering(spread, min_tokens) >= limit
    kept, i, cut = [], 0, 0
    for line, stays in zip(text.split("\n"), fixed):
        words = line.split(" ")
        mine = gone[i:i + len(words)]
        i += len(words)
        if not stays and mine.any():
            cut += int(mine.sum())
            line = " ".join(w for w, g in zip(words, mine) if not g)
        if line:
            kept.append(line)
    return text if named and 2 * cut > i else "\n".join(kept), int(gone.sum())


def _parse(batches):
    """Per page: its candidate text, compressed; which of its blocks stay whole; whether it names its main text."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        body, chars, fixed, named = [], [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            kinds, whole = candidates(found)
            text = "\n".join(t for t, kind in found if kind in kinds)
            body.append(pack(text.encode()))
            chars.append(len(text))
            fixed.append([kind in whole for _, kind in found if kind in kinds])
            named.append(PLAIN not in kinds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(body, pa.binary()),
             pa.array(chars, pa.int64()), pa.array(fixed, pa.list_(pa.bool_())), pa.array(named, pa.bool_()),
             pa.array(range(len(body)), pa.int32())],
            names=["page_id", "url", "host", "body", "n_chars", "fixed", "named", "salt"])


def _repeated(min_tokens: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                tokens, owner = _streams([unpack(b) for b in row["bodies"]])
                spread = window_spread(tokens, owner, min_tokens)
                at = np.flatnonzero(spread >= row["least"])
                h = np.unique(run_hashes(tokens, at, at + min_tokens, BASES[1])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["host"]] * len(h), pa.string()), pa.array(h, pa.int64())],
                                                 names=["host", "run"])
    return run


def _counted(min_tokens: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                tokens, owner = _streams([unpack(b) for b in row["bodies"]])
                at, h = _windows(tokens, owner, min_tokens)
                mine = np.isin(h, np.array(row["runs"], np.int64))
                pairs = np.unique(np.stack([h[mine], owner[at[mine]]]), axis=1)
                h, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["host"]] * len(h), pa.string()), pa.array(h, pa.int64()),
                                                  pa.array(n, pa.int64())], names=["host", "run", "n"])
    return run


def _cut(min_tokens: int, min_pages: int, open_share: float, named_share: float, page_type: pa.DataType):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                runs = sorted((r["run"], r["n"]) for r in row["runs"])
                keys, counts = (np.array(x, np.int64) for x in zip(*runs))
                texts = [cut_runs(unpack(p["body"]).decode(), p["fixed"], keys, counts,
                                  enough(row["distinct"], named_share if p["named"] else open_share, min_pages),
                                  p["named"], min_tokens) for p in row["pages"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["page_id"] for p in row["pages"]], page_type),
                     pa.array([p["url"] for p in row["pages"]], pa.string()), pa.array([t for t, _ in texts], pa.string()),
                     pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_repeated"])
    return run


def _whole(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"),
             pa.array([unpack(b).decode() for b in batch.column("body").to_pylist()], pa.string()),
             batch.column("n_chars"), pa.array([0] * batch.num_rows, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_repeated"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_tokens: int = 8,
            min_pages: int = 10, open_share: float = 0.1, named_share: float = 0.5,
            pages_per_group: int = 256, chars_per_group: int = 1 << 21) -> DataFrame:
    """Per page: page_id, url, text, n_chars and n_repeated, the tokens of its candidate text in runs that enough
    pages of the host share, whether cut or, in an article, kept.  The last two parameters deal out the work and
    change no result."""
    ship()
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                     F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
                                F.lit("")).alias("host"))
    id_type = dict(p.dtypes)["page_id"]
    out = f"page_id {id_type}, url string, text string, n_chars long, n_repeated long"
    parsed = stage(p.mapInArrow(_parse, f"page_id {id_type}, url string, host string, body binary, n_chars long, "
                                        "fixed array<boolean>, named boolean, salt int"), "html-parsed")
    per_host = parsed.groupBy("host").agg(
        F.count_distinct(F.when(F.col("n_chars") > 0, F.xxhash64("body"))).alias("distinct"),
        F.sum("n_chars").alias("chars"), F.count("*").alias("rows"))
    limit = F.greatest(F.lit(3), F.ceil(F.col("distinct") * min(open_share, named_share)),
                       F.least(F.lit(min_pages), F.expr("(distinct + 1) div 2")))
    hosts = stage(per_host
                  .withColumn("groups", F.greatest(F.ceil(F.col("distinct") / pages_per_group),
                                                   F.least("distinct", F.ceil(F.col("chars") / chars_per_group)), F.lit(1)))
                  .withColumn("chunks", F.greatest(F.ceil(F.col("rows") / pages_per_group),
                                                   F.least("rows", F.ceil(F.col("chars") / chars_per_group)), F.lit(1)))
                  # Equal texts fall into one group, so the groups' counts add up: a run on ``limit`` texts of the
                  # host is on limit / groups of them in some group.
                  .withColumn("least", F.ceil(limit / F.col("groups"))), "html-hosts")

    def groups(hosts):
        # A set per group drops copies before the shuffle, however many there are.
        return (parsed.where("n_chars > 0").select("host", "body").join(hosts.select("host", "groups", "least"), "host")
                .groupBy("host", "least", F.pmod(F.xxhash64("body"), F.col("groups")).alias("part"))
                .agg(F.collect_set("body").alias("bodies")))

    found = groups(hosts).mapInArrow(_repeated(min_tokens), "host string, run long")
    runs = stage(found.groupBy("host").agg(F.collect_set("run").alias("runs")), "html-runs")
    counted = (groups(hosts.join(runs, "host", "left_semi")).join(runs, "host")
               .select("host", "bodies", "runs").mapInArrow(_counted(min_tokens), "host string, run long, n long")
               .groupBy("host", "run").agg(F.sum("n").alias("n"))
               .join(hosts.select("host", "distinct", "chunks", limit.alias("limit")), "host").where("n >= limit")
               .groupBy("host", "distinct", "chunks").agg(F.collect_list(F.struct("run", "n")).alias("runs")))
    templates = stage(counted, "html-templates")
    touched = parsed.where("n_chars > 0").join(templates.select("host", "chunks"), "host")
    chunked = (touched.groupBy("host", F.pmod(F.xxhash64("page_id", "url", "salt"), F.col("chunks")).alias("chunk"))
               .agg(F.collect_list(F.struct("page_id", "url", "body", "fixed", "named")).alias("pages"))
               .join(templates, "host").select("host", "distinct", "runs", "pages"))
    page_type = to_arrow_type(p.schema["page_id"].dataType)
    cut = chunked.mapInArrow(_cut(min_tokens, min_pages, open_share, named_share, page_type), out)
    untouched = (parsed.join(templates.select("host", F.lit(True).alias("templated")), "host", "left")
                 .where("n_chars = 0 or templated is null").select("page_id", "url", "body", "n_chars"))
    return untouched.mapInArrow(_whole, out).unionByName(cut)
