"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import hmm
from .centroids import cluster
from .common import WORD, crc_remainder, stage, table
from .decontaminate import decontaminate
from .fingerprint import with_next
from .langid import identify, train
from .lines import line_dedup
from .mainhtml import extract
from .mixing import mix
from .pivots import top_k
from .repeats import remove_repeats
from .setjoin import jaccard_components
from .surrogates import pseudonymise
from .whitening import whiten

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="op1").select("doc_id", "text", "n_entities")


@query
def op2_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                              F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words")),
                  "op2-sizes")
    return (mix(sized, key=("doc_id", "text_hash"), size="words")
            .select("doc_id", "size", "source_size", "target", "taken"))


@query
def op3_pivot_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE["op3_pivot_topk"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return (line_dedup(docs)
            .select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")))


ORACLE["op4_line_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, text, coalesce('s' || source, 'n') AS site, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, site, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
l AS (SELECT rid, site, line, no, trim(regexp_replace(line, '[\t\r]', ' ', 'g'), ' ') AS bare FROM p),
b AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.rid, l.no, l.line, l.bare, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON l.bare = b.bare),
g AS (SELECT rid, sum(gone::INT) AS n, bool_or(NOT gone AND bare <> '') AS stays,
             string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS kept FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN g.n > 0 AND g.stays THEN g.n ELSE 0 END::BIGINT AS n_lines_removed,
       sha256(coalesce(CASE WHEN g.n > 0 AND g.stays THEN g.kept ELSE d.text END, '')) AS text_sha256
FROM d LEFT JOIN g ON d.rid = g.rid
"""


@query
def op5_hidden_markov(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return hmm.score(docs, crc_remainder(F.col("doc_id"), 7) == 2)


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op6_decontaminate"] = r"""
WITH raw AS (SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id::VARCHAR AS id, text FROM documents
             UNION ALL SELECT 'b', row_number() OVER (), coalesce(item_id::VARCHAR, ''), text FROM benchmark),
w AS MATERIALIZED (SELECT kind, rid, id, coalesce(list_filter(string_split(regexp_replace(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> ''), []) AS ws FROM raw),
bw AS (SELECT DISTINCT id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS win
       FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE kind = 'd' AND len(ws) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT rid, id FROM hit) GROUP BY rid)
SELECT w.id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hw ON w.rid = hw.rid LEFT JOIN hi ON w.rid = hi.rid WHERE w.kind = 'd'
"""


@query
def op7_main_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query
def op8_substring_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op8_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(list_filter(string_split(regexp_replace(text,
             '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> ''), []) AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM w JOIN r USING (h)),
x AS (SELECT d.rid, p.no, p.word FROM d, LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS no) p),
k AS (SELECT x.rid, count(g.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.no) FILTER (g.p IS NULL) AS kept
      FROM x LEFT JOIN g ON x.rid = g.rid AND x.no = g.p GROUP BY x.rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


@query
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    dictionaries = train(docs.where(~held_out))
    return (identify(docs.select("doc_id", "text"), dictionaries)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


@query
def op10_jaccard_join(spark, sf_dir):
    return (jaccard_components(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id"))


ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(list_filter(string_split(regexp_replace(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> ''), []) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, sh FROM (
      SELECT rid, array_to_string(ws[i:i + 3], ' ') AS sh
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
      UNION ALL SELECT rid, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n AS a ON a.rid = x JOIN n AS b ON b.rid = y
      WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.rid = d.rid JOIN c ON c.x = d.rid
"""


@query
def op11_fingerprints(spark, sf_dir):
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _centroid_rounds(rounds: int) -> str:
    """The rounds of op13 as a chain of tables: a<r> assigns to the centroids c<r>, c<r + 1> are the floors of the means."""
    assign = """a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS best FROM (
      SELECT v.rid, c{r}.c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
      FROM v, c{r}) GROUP BY rid)"""
    update = """c{s} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (
      SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (
        SELECT a{r}.best.c AS c, i, sum(x[i]) AS t, count(*) AS n FROM v JOIN a{r} USING (rid), range(1, 65) AS g(i)
        GROUP BY 1, 2) GROUP BY c) AS m ON m.c = c{r}.c)"""
    parts = [p.format(r=r, s=r + 1) for r in range(rounds) for p in (assign, update)]
    return ",\n".join(parts + [assign.format(r=rounds)])


ORACLE["op13_centroids"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x
      FROM v) WHERE c < 8),
{_centroid_rounds(10)},
f AS MATERIALIZED (SELECT vec_id, best.c AS c, best.d AS d FROM a10 JOIN v USING (rid))
SELECT vec_id, f.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM f JOIN c10 ON c10.c = f.c
"""
