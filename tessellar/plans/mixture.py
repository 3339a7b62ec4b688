"""The mixture of retrievers from end to end: documents with vectors, searched by those whose id is divisible by 50.

The tables hold documents and vectors apart; here vector n stands for document ``FIRST + n``, the n-th of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions.providers import Providers
from tessellar.operators import dense, fusion, lexical, mor
from tessellar.operators.pipeline import sentence_similarity
from tessellar.plans import quality as Q
from tessellar.plans import retrieval as R
from tessellar.plans.presets import _cos
from tessellar.plans.retrieval import _TERMS, _tf_sql
from tessellar.plans.text_queries import SENTS
from tessellar.session import cut

FIRST = 1000
EACH, POOL, FINAL = 50, 150, 60  # hits of a retriever, of their fusion, and of the answer


def _corpus(s, d):
    e = R._t(s, d, "embeddings").select((F.col("vec_id") + FIRST).alias("doc_id"), "embedding", "label")
    c = cut(e.join(R._t(s, d).select("doc_id", "text").filter("text IS NOT NULL"), "doc_id"), "corpus")
    return c, c.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"), "embedding")


def _lists(c, q):
    """``(qid, doc_id, method, score)``: the best of each retriever, the query itself left out."""
    bm = lexical.bm25(c, q, "doc_id", "text", "qid", "query").withColumnRenamed("bm25", "score")
    tf = lexical.tfidf(c, q, "doc_id", "text", "qid", "query").withColumnRenamed("tfidf", "score")
    sparse = [lexical.best(x.filter("qid <> doc_id"), "qid", "score", "doc_id", EACH).select("qid", "doc_id", F.lit(m).alias("method"), "score") for m, x in (("bm25", bm), ("tfidf", tf))]
    near = dense.knn(c, c.filter("doc_id % 50 = 0"), EACH, "doc_id").select("qid", "doc_id", F.lit("dense").alias("method"), F.col("sim").alias("score"))
    return cut(sparse[0].unionByName(sparse[1]).unionByName(near), "lists")


def _signals(c, q, lists):
    vectors, idf = lexical.tfidf_vectors(c, "doc_id", "text")
    sparse = mor.sparse_pre(vectors, idf, q, "doc_id", "qid", "query").join(mor.sparse_signals(lists.filter("method <> 'dense'"), vectors, ["qid", "method"], "doc_id"), ["qid", "method"])
    hits, centres = lists.filter("method = 'dense'").select("qid", "doc_id"), mor.centroids(c)
    pre = mor.pre_signal(q, centres, "qid").join(mor.post_signal(hits, c, centres, "doc_id"), "qid").join(mor.moran(hits, c, "doc_id"), "qid")
    return sparse.select("qid", "method", "pre", "post", "moran").unionByName(pre.select("qid", F.lit("dense").alias("method"), "pre", "post", "moran"))


def mixture_signals(s, d):
    c, q = _corpus(s, d)
    return _signals(c, q, _lists(c, q))


def mixture_weights(s, d):
    return mor.weights(mixture_signals(s, d), "qid")


def mixture_search(s, d):
    """Lists scaled and weighted by their signals, near copies left out, re-ranked by relevance and by sentences."""
    p = Providers()
    c, q = _corpus(s, d)
    lists = _lists(c, q)
    w = mor.weights(_signals(c, q, lists), "qid")
    fused = fusion.weighted(fusion.scale_each(lists, ["qid", "method"], "score"), w, "qid", "doc_id")
    x = cut(lexical.best(fused, "qid", "fused", "doc_id", POOL), "fused")
    texts = x.join(c.select("doc_id", "text"), "doc_id")
    x = fusion.greedy_dedupe(x, fusion.tfidf_links(texts, "qid", "doc_id", "rank", "text", 0.85), "qid", "doc_id", "rank")
    own = c.select("doc_id", "text", T.terms(F.col("text")).alias("ct"))
    x = x.join(own, "doc_id").join(q.select("qid", "query", F.array_distinct(T.terms(F.col("query"))).alias("qt")), "qid")
    x = x.withColumn("cross", F.round(0.3 * F.col("fused") + 0.7 * p.relevant(F.col("query"), F.col("text"), F.col("qt"), F.col("ct")), 9))
    x = x.withColumn("ultimate", F.round(fusion.ultimate(F.col("cross"), F.round(sentence_similarity(F.col("query"), F.col("qt"), F.col("text"), p), 9), 0.3), 9))
    return lexical.best(x.select("qid", "doc_id", "fused", "n_methods", "cross", "ultimate"), "qid", "ultimate", "doc_id", FINAL)


def _over(sql: str) -> str:
    return sql.replace("FROM documents", "FROM mc").replace("FROM benchmark", "FROM mq").replace("item_id", "qid").replace("question", "query")


_MC = f"mc AS (SELECT doc_id, text, embedding::DOUBLE[] AS v, label FROM embeddings JOIN documents ON doc_id = vec_id + {FIRST} WHERE text IS NOT NULL), mq AS (SELECT doc_id AS qid, text AS query, v FROM mc WHERE doc_id % 50 = 0)"
_CE = "ce AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(v) AS x FROM mc) GROUP BY 1, 2) GROUP BY 1), cen AS (SELECT centre, n FROM ce JOIN (SELECT label, count(*) AS n FROM mc GROUP BY 1) USING (label))"
_D2 = "list_dot_product(v, v) - 2 * list_dot_product(v, centre) + list_dot_product(centre, centre)"


def _top(score: str, source: str, method: str) -> str:
    return f"SELECT qid, doc_id, '{method}' AS method, {score} AS score FROM {source} WHERE qid <> doc_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, doc_id) <= {EACH}"


_MOR = "round(CASE WHEN n >= 3 AND abs(coalesce(w, 0)) > 1e-12 AND den > 1e-12 THEN least(1, greatest(0, (n / w * num / den + 1) / 2)) ELSE 0 END, 5)"
_L = f"""{_MC}, {_over(R._BM)}, {_over(_tf_sql(False))}, kn AS (SELECT mq.qid, mc.doc_id, round(list_dot_product(mq.v, mc.v), 5) AS sim FROM mq, mc), li AS ({_top('bm25', 'bm', 'bm25')} UNION ALL {_top('tfidf', 'tf', 'tfidf')} UNION ALL {_top('sim', 'kn', 'dense')})"""
_SG = f"""{_L}, {_CE}, mu AS (SELECT doc_id, term, ev.w / en.n AS w FROM ev JOIN en USING (doc_id)), sc AS (SELECT DISTINCT doc_id FROM li WHERE method <> 'dense'), md AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS w FROM mu x JOIN mu y USING (term) WHERE x.doc_id <> y.doc_id AND x.doc_id IN (SELECT doc_id FROM sc) AND y.doc_id IN (SELECT doc_id FROM sc) GROUP BY 1, 2),
 xs AS (SELECT qid, method, doc_id, coalesce((SELECT sum(w) FROM mu WHERE mu.doc_id = li.doc_id), 0) AS x FROM li WHERE method <> 'dense' UNION ALL SELECT qid, method, doc_id, list_sum(v) FROM li JOIN mc USING (doc_id) WHERE method = 'dense'), xm AS (SELECT qid, method, avg(x) AS m, count(*) AS n FROM xs GROUP BY 1, 2), xz AS (SELECT qid, method, doc_id, x - m AS z, n FROM xs JOIN xm USING (qid, method)), xd AS (SELECT qid, method, any_value(n) AS n, sum(z * z) AS den FROM xz GROUP BY 1, 2),
 pc AS (SELECT a.qid, a.method, a.doc_id AS a, b.doc_id AS b, a.z AS za, b.z AS zb, CASE WHEN a.method = 'dense' THEN {Q._COS.format('ma.v', 'mb.v')} ELSE md.w END AS w FROM xz a JOIN xz b ON a.qid = b.qid AND a.method = b.method AND a.doc_id <> b.doc_id JOIN mc ma ON ma.doc_id = a.doc_id JOIN mc mb ON mb.doc_id = b.doc_id LEFT JOIN md ON md.a = a.doc_id AND md.b = b.doc_id),
 pn AS (SELECT qid, method, sum(w) AS w, sum(w * za * zb) AS num FROM pc GROUP BY 1, 2), pm AS (SELECT qid, method, n, w, {_MOR} AS moran FROM xd LEFT JOIN pn USING (qid, method)),
 qt AS (SELECT qid, count(k.term) / count(*) AS pre FROM (SELECT qid, unnest(list_distinct({_TERMS.format('query')})) AS term FROM mq) LEFT JOIN (SELECT DISTINCT term FROM mu) k USING (term) GROUP BY 1),
 pr AS (SELECT qid, 'bm25' AS method, coalesce(qt.pre, 0) AS pre FROM mq LEFT JOIN qt USING (qid) UNION ALL SELECT qid, 'tfidf', coalesce(s / (SELECT count(*) FROM ei), 0) FROM mq LEFT JOIN (SELECT qid, sum(w) / sqrt(sum(w * w)) AS s FROM eqv GROUP BY 1) USING (qid)),
 dp AS (SELECT qid, round(coalesce(sqrt(sum(CASE WHEN d2 > 1e-9 THEN pow(n / (SELECT count(*) FROM cen) / sqrt(d2), 2) END)), 0.5), 5) AS pre FROM (SELECT qid, n, {_D2} AS d2 FROM mq, cen) GROUP BY 1), ds AS (SELECT doc_id, sum(CASE WHEN d2 > 1e-9 THEN 1 / d2 END) AS s FROM (SELECT doc_id, {_D2} AS d2 FROM mc, cen) GROUP BY 1), dq AS (SELECT qid, round(sqrt(sum(s)), 5) AS post FROM li JOIN ds USING (doc_id) WHERE method = 'dense' GROUP BY 1),
 sg AS (SELECT qid, method, round(pre, 6) AS pre, round(CASE WHEN n < 2 THEN 0 ELSE greatest(0, 1 - coalesce(w, 0) / (n * (n - 1))) END, 5) AS post, moran FROM pr JOIN pm USING (qid, method) UNION ALL SELECT qid, 'dense', pre, post, moran FROM dp JOIN dq USING (qid) JOIN pm USING (qid) WHERE method = 'dense')"""
_W = f"{_SG}, sw AS (SELECT *, 0.4::DOUBLE * pre + 0.3::DOUBLE * post + 0.3::DOUBLE * moran AS s FROM sg), wt AS (SELECT qid, method, round(CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS weight FROM sw WINDOW w AS (PARTITION BY qid))"
_GR = R._GRAMS
_F = f"""{_W}, bo AS (SELECT qid, method, min(score) AS lo, max(score) AS hi FROM li GROUP BY 1, 2), fu AS (SELECT qid, doc_id, round(sum(weight * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END), 6) AS fused, count(*) AS n_methods FROM li JOIN bo USING (qid, method) JOIN wt USING (qid, method) GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) AS r FROM fu QUALIFY r <= {POOL}),
 g1 AS (SELECT qid, r, g, count(*) AS tf FROM (SELECT qid, r, unnest({_GR}) AS g FROM (SELECT qid, r, {_TERMS.format('text')} AS t FROM fr JOIN mc USING (doc_id))) GROUP BY 1, 2, 3), g2 AS (SELECT qid, g, count(*) AS df FROM g1 GROUP BY 1, 2), g3 AS (SELECT qid, count(*) AS n FROM fr GROUP BY 1), g4 AS (SELECT qid, r, g, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM g1 JOIN g2 USING (qid, g) JOIN g3 USING (qid)), g5 AS (SELECT qid, r, sqrt(sum(w * w)) AS m FROM g4 GROUP BY 1, 2), g6 AS (SELECT qid, r, g, w / m AS w FROM g4 JOIN g5 USING (qid, r)),
 gl AS (SELECT a.qid, a.r AS ra, b.r AS rb FROM g6 a JOIN g6 b ON a.qid = b.qid AND a.g = b.g AND a.r < b.r GROUP BY 1, 2, 3 HAVING round(sum(a.w * b.w), 6) >= 0.85), gk AS (SELECT qid, 0 AS i, []::BIGINT[] AS kept FROM mq UNION ALL SELECT gk.qid, i + 1, CASE WHEN EXISTS (SELECT 1 FROM gl WHERE gl.qid = gk.qid AND gl.rb = gk.i + 1 AND list_contains(gk.kept, gl.ra)) THEN kept ELSE list_append(kept, i + 1) END FROM gk WHERE i < {POOL}),
 fk AS (SELECT fr.*, text, query, list_distinct({_TERMS.format('query')}) AS qt FROM fr JOIN gk ON gk.qid = fr.qid AND gk.i = {POOL} AND list_contains(gk.kept, fr.r) JOIN mc USING (doc_id) JOIN mq ON mq.qid = fr.qid),
 fx AS (SELECT *, round(0.3::DOUBLE * fused + 0.7::DOUBLE * (CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {_TERMS.format('text')})) / len(qt) ELSE 0 END), 9) AS cross FROM fk),
 fy AS (SELECT *, round(coalesce(list_max(list_filter(list_transform({SENTS.format('text')}, lambda z: {_cos('qt', _TERMS.format('z'))}), lambda x: x > 0)), {_cos('qt', _TERMS.format('substring(text, 1, 200)'))}, 0), 9) AS sim FROM fx), fz AS (SELECT qid, doc_id, fused, n_methods, cross, round(cross * (1 + 0.3::DOUBLE * sim), 9) AS ultimate FROM fy)"""
SQL = {
    "mixture_signals": f"WITH {_SG} SELECT * FROM sg",
    "mixture_weights": f"WITH {_W} SELECT * FROM wt",
    "mixture_search": f"WITH RECURSIVE {_F} " + R._top('qid, doc_id, fused, n_methods, "cross", ultimate', "fz", "qid", "ultimate", "doc_id", FINAL),
}
SQL["mixture_search"] = SQL["mixture_search"].replace(" AS cross FROM", ' AS "cross" FROM').replace("n_methods, cross, round(cross *", 'n_methods, "cross", round("cross" *')
QUERIES = {f.__name__: f for f in (mixture_signals, mixture_weights, mixture_search)}
