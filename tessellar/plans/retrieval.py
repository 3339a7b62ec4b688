"""Queries over lexical, vector and fused retrieval. Question texts are those of the benchmark; vector queries are the rows
whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import dense, fusion, lexical
from tessellar.plans.text_queries import STOP_SQL, WORDS, typed


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def _bm(s, d):
    return lexical.bm25(_t(s, d), _t(s, d, "benchmark"), "doc_id", "text", "item_id", "question")


def _tf(s, d, sub=False):
    return lexical.tfidf(_t(s, d), _t(s, d, "benchmark"), "doc_id", "text", "item_id", "question", sub)


def _pool(s, d):
    return lexical.lexical_pool(_bm(s, d), _tf(s, d), "item_id", "doc_id")


def bm25_topk(s, d):
    return lexical.best(_bm(s, d), "item_id", "bm25", "doc_id", 80)


def tfidf_topk(s, d):
    return lexical.best(_tf(s, d), "item_id", "tfidf", "doc_id", 80)


def tfidf_sublinear(s, d):
    return lexical.best(_tf(s, d, True), "item_id", "tfidf", "doc_id", 80)


def lexical_pool(s, d):
    return _pool(s, d)


def query_match(s, d):
    k = _t(s, d, "keywords_excel")
    q = _t(s, d, "final_results").filter("query is not null").select(F.xxhash64(F.trim("query")).alias("h"), F.trim("query").alias("query")).distinct()
    return lexical.match_question(q.select("query"), k, "query", "query")


def dense_knn(s, d):
    e = _t(s, d, "embeddings")
    return dense.knn(e, e.filter("vec_id % 50 = 0"), 20)


def dense_ivf(s, d):
    e = _t(s, d, "embeddings")
    return dense.ivf(e, e.filter("vec_id % 50 = 0"), 20)


def mmr_select(s, d):
    e = _t(s, d, "embeddings")
    return dense.mmr(dense.knn(e, e.filter("vec_id % 50 = 0"), 20), e, 8)


def kmeans_clusters(s, d):
    return dense.clusters(_t(s, d, "embeddings"))


_CANDS = "candidate_id", "query", "chunk_id", "document", "bm25_score", "tfidf_score", "combined_score"


def candidates(s, d):
    """Candidates with a query, each delivered once, unknown scores as none."""
    p = _t(s, d, "pool_candidates").select(*_CANDS, "ingested_at")
    q = p.withColumn("query", F.trim("query")).filter("query <> ''")
    for c in ("bm25_score", "tfidf_score", "combined_score"):
        q = q.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return q.groupBy("candidate_id").agg(F.max_by(F.struct(*_CANDS[1:]), "ingested_at").alias("r")).select("candidate_id", "r.*")


def _lists(s, d, n=80):
    """The best of each score as one long table of ranked lists."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(f"{m}_score", 6).alias("score")) for m in ("bm25", "tfidf", "combined")])
    x = candidates(s, d).select("query", "candidate_id", F.explode(each).alias("p")).select("query", "candidate_id", "p.method", "p.score").filter("score is not null")
    return lexical.best(x, ["query", "method"], "score", "candidate_id", n)


def candidates_by_retriever(s, d):
    return _lists(s, d)


def rrf_fuse(s, d):
    x = _lists(s, d).withColumn("rank", F.col("rank") - 1)
    return fusion.rrf(x, "query", "candidate_id")


def min_max_fusion(s, d):
    x = candidates(s, d).filter("bm25_score is not null and tfidf_score is not null")
    x = lexical.min_max(x, "query", "bm25_score", "tfidf_score")
    x = x.select("query", "candidate_id", F.round(0.7 * F.col("bm25_score_n") + 0.3 * F.col("tfidf_score_n"), 6).alias("fused"))
    return lexical.best(x, "query", "fused", "candidate_id", 20)


def exact_dedupe(s, d):
    f = _t(s, d, "final_results").filter("query is not null")
    x = f.groupBy("result_id").agg(F.max_by(F.struct(F.trim("query").alias("query"), "rank", "extracted_sentences"), "ingested_at").alias("r")).select("result_id", "r.*")
    return fusion.distinct_texts(x, "extracted_sentences", [F.col("rank").asc_nulls_last(), F.col("result_id")], ["query"]).select("query", "result_id")


def merge_dupes(s, d):
    f = _t(s, d, "final_results").filter("query is not null").withColumn("query", F.trim("query")).withColumn("score", F.round(1.0 / (60 + F.col("rank")), 9))
    return fusion.merge_context(f, "query", "chunk_context", "extracted_sentences", "score", "result_id")


def context_features(s, d):
    p = _t(s, d, "pool_candidates").filter("query is not null")
    x = p.groupBy("candidate_id").agg(F.max_by(F.struct("query", "chunk", "combined_score"), "ingested_at").alias("r")).select("candidate_id", "r.*")
    bonus = fusion.overlap_bonus(F.col("query"), F.col("chunk"))
    base = F.coalesce(F.nanvl("combined_score", F.lit(None).cast("double")), F.lit(0.0))
    return x.select("candidate_id", F.round(bonus, 6).alias("bonus"), F.round(base + 0.2 * bonus, 6).alias("enhanced"))


def heading_score(s, d):
    """Of each query's candidates, how far the heading's words cover the query's."""
    p = _t(s, d, "pool_candidates").filter("query is not null").groupBy("candidate_id").agg(F.max_by(F.struct("query", "heading"), "ingested_at").alias("r")).select("candidate_id", "r.*")
    q, h = F.array_distinct(T.terms(F.col("query"))), F.array_distinct(T.terms(F.col("heading")))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, h)) / F.size(q)).otherwise(0.0)
    return p.select("candidate_id", F.round(share, 6).alias("heading_share"), F.round(F.least(F.lit(1.0), 0.6 * share + 0.4 * share / 2), 6).alias("boost"))


def best_sentence(s, d):
    """The sentence of each candidate's chunk that shares most words with the query; of equals the first."""
    p = _t(s, d, "pool_candidates").filter("query is not null and chunk is not null").groupBy("candidate_id").agg(F.max_by(F.struct("query", "chunk"), "ingested_at").alias("r")).select("candidate_id", "r.*")
    q = F.array_distinct(T.terms(F.col("query")))
    scored = F.transform(T.sentences(F.col("chunk")), lambda x, i: F.struct(F.size(F.array_intersect(F.col("qt"), T.terms(x))).alias("hits"), (-i).alias("at"), x.alias("s")))
    x = p.withColumn("qt", q).select("candidate_id", F.array_max(scored).alias("b"))
    return x.filter("b is not null").select("candidate_id", "b.hits", (-F.col("b.at")).alias("pos"), F.md5("b.s").alias("digest"))


def final_ultimate(s, d):
    x = context_features(s, d).join(best_sentence(s, d), "candidate_id")
    sim = F.least(F.lit(1.0), F.col("hits") / 10)
    return x.select("candidate_id", F.round(fusion.ultimate(F.col("enhanced"), sim), 6).alias("ultimate"))


def subqueries(s, d):
    """Deterministic sub-queries of each question by fixed templates."""
    t = F.array(*[F.concat(F.lit(a), F.lower("q")) for a in ("what is reported on ", "figures for ", "policy on ", "responsibility for ", "risks of ", "targets for ", "changes in ")])
    x = _t(s, d, "benchmark").select("item_id", F.array_join(T.terms(F.col("question")), " ").alias("q"))
    return x.select("item_id", F.posexplode(t).alias("n", "subquery"))


def expanded_queries(s, d):
    """Each known question with its keywords behind it."""
    k = F.regexp_replace(F.regexp_replace("keywords", r"[\[\]\"']", " "), r"\s+", " ")
    return _t(s, d, "keywords_excel").filter("question is not null").select("kw_id", F.concat_ws(" ", F.trim("question"), F.trim(k)).alias("expanded"))


def tfidf_dedupe(s, d):
    """Of each query's best 40 candidates, those whose TF-IDF vector within these is not 0.9 alike to a better one kept."""
    top = lexical.best(candidates(s, d).filter("combined_score is not null").select("query", "candidate_id", "chunk_id", F.col("combined_score").alias("score")), "query", "score", "candidate_id", 40)
    p = _t(s, d, "pool_candidates").filter("chunk is not null").groupBy("chunk_id").agg(F.max("chunk").alias("chunk"))
    x = top.join(p.select("chunk_id", F.array_join(T.terms(F.col("chunk")), " ").alias("terms")), "chunk_id", "left")
    return fusion.tfidf_dedupe(x, "query", "candidate_id", "rank", "terms", 0.9)


def keyword_pool(s, d):
    """The pool over all chunks of every query that was run, with the keywords that stood beside it."""
    k = F.array_distinct(F.filter(F.transform(F.split("k", ";"), lambda x: F.trim(x)), lambda x: x != ""))
    q = _t(s, d, "final_results").filter("trim(query) <> ''").groupBy(F.trim("query").alias("query")).agg(F.max("keywords").alias("k")).select("query", k.alias("keywords"))
    c = _t(s, d, "pool_candidates").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("chunk").alias("chunk"))
    return lexical.keyword_pool(c, q.withColumn("text", F.col("query")), "chunk_id", "chunk", "query", "text", "keywords")


_TERMS = f"list_filter({WORDS}, lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL}))"
_BM = f"""d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
 st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
 idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 q AS (SELECT item_id, term, count(*) AS qw FROM (SELECT item_id, unnest({_TERMS.format('question')}) AS term FROM benchmark) GROUP BY 1, 2),
 bm AS (SELECT item_id, doc_id, round(sum(qw * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS bm25 FROM q JOIN idf USING (term) JOIN p USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2)"""


def _tf_sql(sub: bool) -> str:
    f = "(1 + ln(tf))" if sub else "tf"
    grams = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    return f"""e AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents), ep AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams}) AS term FROM e) GROUP BY 1, 2),
 ei AS (SELECT term, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM ep GROUP BY 1 HAVING count(*) <= 0.9 * (SELECT count(*) FROM e)),
 ev AS (SELECT doc_id, term, {f} * idf AS w FROM ep JOIN ei USING (term)), en AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM ev GROUP BY 1),
 eq AS (SELECT item_id, {_TERMS.format('question')} AS t FROM benchmark), eqp AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({grams}) AS term FROM eq) GROUP BY 1, 2),
 eqv AS (SELECT item_id, term, {f} * idf AS w FROM eqp JOIN ei USING (term)), eqn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM eqv GROUP BY 1),
 tf AS (SELECT item_id, doc_id, round(sum(ev.w / en.n * (eqv.w / eqn.n)), 6) AS tfidf FROM ev JOIN en USING (doc_id) JOIN eqv USING (term) JOIN eqn USING (item_id) GROUP BY 1, 2)"""


_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
_LINE = "(' ' || array_to_string(" + WORDS + ", ' ') || ' ')"
_KPOOL = f"""kq AS (SELECT query, list_distinct(list_filter(list_transform(string_split(k, ';'), lambda x: trim(x)), lambda x: x <> '')) AS kw FROM (SELECT trim(query) AS query, max(keywords) AS k FROM final_results WHERE trim(query) <> '' GROUP BY 1)),
 kc AS (SELECT chunk_id, {_TERMS.format('chunk')} AS t, {_LINE.format('chunk')} AS line FROM (SELECT chunk_id, max(chunk) AS chunk FROM pool_candidates WHERE chunk_id IS NOT NULL GROUP BY 1)),
 kph AS (SELECT DISTINCT query, phrase FROM (SELECT query, array_to_string({WORDS.format('k')}, ' ') AS phrase FROM (SELECT query, unnest(kw) AS k FROM kq)) WHERE contains(phrase, ' ')),
 kex AS (SELECT chunk_id, replace(phrase, ' ', '_') AS term FROM (SELECT DISTINCT phrase FROM kph) JOIN kc ON contains(line, ' ' || phrase || ' ')),
 kow AS (SELECT query, replace(phrase, ' ', '_') AS term FROM kph WHERE contains({_LINE.format('query')}, ' ' || phrase || ' ')),
 kre AS (SELECT query, term FROM (SELECT DISTINCT query, unnest({_TERMS.format('k')}) AS term FROM (SELECT query, unnest(kw) AS k FROM kq)) UNION ALL SELECT query, replace(phrase, ' ', '_') FROM kph),
 kt AS (SELECT query, term, sum(n) AS qw FROM (SELECT query, term, 3 AS n FROM (SELECT query, unnest({_TERMS.format('query')}) AS term FROM kq UNION ALL SELECT * FROM kow) UNION ALL SELECT query, term, 1 FROM kre) GROUP BY 1, 2),
 kp AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM kc) GROUP BY 1, 2 UNION ALL SELECT chunk_id, term, 1 FROM kex), ks AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM kc), kd AS (SELECT term, count(*) AS df FROM kp GROUP BY 1),
 kr AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM kd, ks), ki AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM kr) ELSE raw END AS idf FROM kr),
 kb AS (SELECT query, chunk_id, round(sum(qw * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS bm25 FROM kt JOIN ki USING (term) JOIN kp USING (term) JOIN kc USING (chunk_id), ks GROUP BY 1, 2),
 ep AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_GRAMS}) AS term FROM kc) GROUP BY 1, 2), ei AS (SELECT term, ln((1.0 + (SELECT count(*) FROM kc)) / (1 + count(*))) + 1 AS idf FROM ep GROUP BY 1 HAVING count(*) <= 0.9 * (SELECT count(*) FROM kc)),
 ev AS (SELECT chunk_id, term, tf * idf AS w FROM ep JOIN ei USING (term)), en AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM ev GROUP BY 1), eq AS (SELECT query, {_TERMS.format('query')} AS t FROM kq),
 eqv AS (SELECT query, term, sum(tf) * any_value(idf) AS w FROM (SELECT query, term, 4 AS tf FROM (SELECT query, unnest({_GRAMS}) AS term FROM eq) UNION ALL SELECT query, term, 1 FROM kre) JOIN ei USING (term) GROUP BY 1, 2), eqn AS (SELECT query, sqrt(sum(w * w)) AS n FROM eqv GROUP BY 1),
 kf AS (SELECT query, chunk_id, round(sum(ev.w * eqv.w) / any_value(en.n) / any_value(eqn.n), 6) AS tfidf FROM ev JOIN eqv USING (term) JOIN en USING (chunk_id) JOIN eqn USING (query) GROUP BY 1, 2),
 j AS (SELECT query, chunk_id, coalesce(bm25, 0) AS bm25, coalesce(tfidf, 0) AS tfidf FROM kb FULL JOIN kf USING (query, chunk_id)), m AS (SELECT query, min(bm25) AS b0, max(bm25) AS b1, min(tfidf) AS t0, max(tfidf) AS t1 FROM j GROUP BY 1),
 k AS (SELECT query, chunk_id, bm25, tfidf, round(0.7 * ((bm25 - b0) / (b1 - b0 + 1e-8)) + 0.3 * ((tfidf - t0) / (t1 - t0 + 1e-8)), 6) AS combined FROM j JOIN m USING (query))"""


def _top(cols: str, source: str, group: str, score: str, tie: str, n: int) -> str:
    return f"SELECT * FROM (SELECT {cols}, row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC, {tie})::INT AS rank FROM {source}) WHERE rank <= {n}"


_CAND = "c AS (SELECT candidate_id, r.* FROM (SELECT candidate_id, arg_max({'query': trim(query), 'chunk_id': chunk_id, 'bm25_score': CASE WHEN isnan(bm25_score) THEN NULL ELSE bm25_score END, 'tfidf_score': CASE WHEN isnan(tfidf_score) THEN NULL ELSE tfidf_score END, 'combined_score': CASE WHEN isnan(combined_score) THEN NULL ELSE combined_score END}, ingested_at) AS r FROM pool_candidates WHERE trim(query) <> '' GROUP BY 1))"
_LIST = _CAND + ", ls AS (" + " UNION ALL ".join(f"SELECT query, candidate_id, '{m}' AS method, round({m}_score, 6) AS score FROM c WHERE {m}_score IS NOT NULL" for m in ("bm25", "tfidf", "combined")) + "), rk AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY score DESC, candidate_id)::INT AS rank FROM ls QUALIFY rank <= 80)"
_KNN = "SELECT * FROM (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 20"
_NAMES = "list_distinct(regexp_extract_all(coalesce({0}, ''), '\\b[A-Z][a-z0-9]+'))"
_FEAT = f"""f AS (SELECT candidate_id, r.query AS query, r.chunk AS chunk, r.s AS s FROM (SELECT candidate_id, arg_max({{'query': query, 'chunk': chunk, 's': combined_score}}, ingested_at) AS r FROM pool_candidates WHERE query IS NOT NULL GROUP BY 1)),
 fb AS (SELECT candidate_id, query, chunk, CASE WHEN s IS NULL OR isnan(s) THEN 0 ELSE s END AS s, 0.1::DOUBLE * len(list_intersect(list_distinct({_TERMS.format('query')}), list_distinct({_TERMS.format('chunk')}))) + 0.2::DOUBLE * len(list_intersect({_NAMES.format('query')}, {_NAMES.format('chunk')})) AS bonus FROM f),
 ft AS (SELECT candidate_id, round(bonus, 6) AS bonus, round(s + 0.2 * bonus, 6) AS enhanced FROM fb)"""
_SENT = "list_filter(list_transform(coalesce(regexp_extract_all(regexp_replace(chunk, '\\s+', ' ', 'g'), '[^.!?]+[.!?]*'), []), lambda x: trim(x)), lambda x: x <> '')"
_BEST = f"""bx AS (SELECT candidate_id, query, {_SENT} AS ss FROM f WHERE chunk IS NOT NULL), by_ AS (SELECT candidate_id, query, unnest(range(len(ss))) AS i, unnest(ss) AS x FROM bx),
 bs AS (SELECT candidate_id, i, x, len(list_intersect(list_distinct({_TERMS.format('query')}), list_distinct({_TERMS.format('x')}))) AS hits FROM by_),
 bb AS (SELECT candidate_id, hits, i AS pos, md5(x) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY hits DESC, i) AS n FROM bs) WHERE n = 1)"""

SQL = {
    "bm25_topk": f"WITH {_BM} " + _top("item_id, doc_id, bm25", "bm", "item_id", "bm25", "doc_id", 80),
    "tfidf_topk": f"WITH {_tf_sql(False)} " + _top("item_id, doc_id, tfidf", "tf", "item_id", "tfidf", "doc_id", 80),
    "tfidf_sublinear": f"WITH {_tf_sql(True)} " + _top("item_id, doc_id, tfidf", "tf", "item_id", "tfidf", "doc_id", 80),
    "lexical_pool": f"WITH {_BM}, {_tf_sql(False)}, j AS (SELECT item_id, doc_id, coalesce(bm25, 0) AS bm25, coalesce(tfidf, 0) AS tfidf FROM bm FULL JOIN tf USING (item_id, doc_id)), m AS (SELECT item_id, min(bm25) AS b0, max(bm25) AS b1, min(tfidf) AS t0, max(tfidf) AS t1 FROM j GROUP BY 1), k AS (SELECT item_id, doc_id, bm25, tfidf, round(0.7 * ((bm25 - b0) / (b1 - b0 + 1e-8)) + 0.3 * ((tfidf - t0) / (t1 - t0 + 1e-8)), 6) AS combined FROM j JOIN m USING (item_id)) " + _top("item_id, doc_id, bm25, tfidf, combined", "k", "item_id", "combined", "doc_id", 80),
    "dense_knn": _KNN,
    "candidates_by_retriever": f"WITH {_LIST} SELECT query, candidate_id, method, score, rank FROM rk",
    "rrf_fuse": f"WITH {_LIST} SELECT query, candidate_id, round(sum(1.0 / (rank - 1 + 60)), 9) AS rrf, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM rk GROUP BY 1, 2",
    "min_max_fusion": f"WITH {_CAND}, x AS (SELECT * FROM c WHERE bm25_score IS NOT NULL AND tfidf_score IS NOT NULL), m AS (SELECT query, min(bm25_score) AS b0, max(bm25_score) AS b1, min(tfidf_score) AS t0, max(tfidf_score) AS t1 FROM x GROUP BY 1), k AS (SELECT query, candidate_id, round(0.7 * ((bm25_score - b0) / (b1 - b0 + 1e-8)) + 0.3 * ((tfidf_score - t0) / (t1 - t0 + 1e-8)), 6) AS fused FROM x JOIN m USING (query)) " + _top("query, candidate_id, fused", "k", "query", "fused", "candidate_id", 20),
    "exact_dedupe": f"WITH x AS (SELECT result_id, r.* FROM (SELECT result_id, arg_max({{'query': trim(query), 'rank': rank, 's': extracted_sentences}}, ingested_at) AS r FROM final_results WHERE query IS NOT NULL GROUP BY 1)) SELECT query, result_id FROM (SELECT query, result_id, row_number() OVER (PARTITION BY query, md5(array_to_string({WORDS.format('s')}, ' ')) ORDER BY rank ASC NULLS LAST, result_id) AS n FROM x) WHERE n = 1",
    "merge_dupes": "WITH x AS (SELECT trim(query) AS query, lower(trim(coalesce(chunk_context, ''))) AS ctx, lower(trim(extracted_sentences)) AS low, arg_min(trim(extracted_sentences), result_id) AS s, min(result_id) AS k, max(round(1.0 / (60 + rank), 9)) AS sc FROM final_results WHERE query IS NOT NULL GROUP BY 1, 2, 3) SELECT query, md5(ctx) AS context, coalesce(string_agg(s, ' | ' ORDER BY k, s) FILTER (coalesce(low, '') <> ''), '') AS merged, max(sc) AS score, min(k) AS result_id FROM x GROUP BY query, ctx",
    "context_features": f"WITH {_FEAT} SELECT * FROM ft",
    "heading_score": f"WITH p AS (SELECT candidate_id, list_distinct({_TERMS.format('r.q')}) AS q, list_distinct({_TERMS.format('r.h')}) AS h FROM (SELECT candidate_id, arg_max({{'q': query, 'h': heading}}, ingested_at) AS r FROM pool_candidates WHERE query IS NOT NULL GROUP BY 1)), s AS (SELECT candidate_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, h)) / len(q) ELSE 0 END AS v FROM p) SELECT candidate_id, round(v, 6) AS heading_share, round(least(1, 0.6 * v + 0.4 * v / 2), 6) AS boost FROM s",
    "best_sentence": f"WITH {_FEAT}, {_BEST} SELECT * FROM bb",
    "final_ultimate": f"WITH {_FEAT}, {_BEST} SELECT candidate_id, round(enhanced * (1 + 0.2 * least(1, hits / 10)), 6) AS ultimate FROM ft JOIN bb USING (candidate_id)",
    "subqueries": f"SELECT item_id, unnest(range(7))::INT AS n, unnest([p || q FOR p IN ['what is reported on ', 'figures for ', 'policy on ', 'responsibility for ', 'risks of ', 'targets for ', 'changes in ']]) AS subquery FROM (SELECT item_id, array_to_string({_TERMS.format('question')}, ' ') AS q FROM benchmark)",
    "expanded_queries": "SELECT kw_id, concat_ws(' ', trim(question), trim(regexp_replace(regexp_replace(keywords, '[\\[\\]\"'']', ' ', 'g'), '\\s+', ' ', 'g'))) AS expanded FROM keywords_excel WHERE question IS NOT NULL",
    "query_match": f"WITH q AS (SELECT DISTINCT trim(query) AS query FROM final_results WHERE query IS NOT NULL), k AS (SELECT lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS kq, max(kw_id) AS kw_id FROM keywords_excel WHERE question IS NOT NULL GROUP BY 1), x AS (SELECT query, kw_id, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) = kq AS same, list_distinct({WORDS.format('query')}) AS a, list_distinct({WORDS.format('kq')}) AS b FROM q, k), o AS (SELECT query, kw_id, same, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) AS overlap FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY same DESC, overlap DESC, kw_id) AS n FROM o WHERE same OR overlap > 0.8) SELECT query, kw_id, CASE WHEN same THEN 'exact' ELSE 'overlap' END AS how, overlap FROM z WHERE n = 1",
    "tfidf_dedupe": f"""WITH RECURSIVE {_CAND}, t AS (SELECT query, candidate_id, chunk_id, row_number() OVER (PARTITION BY query ORDER BY combined_score DESC, candidate_id) AS rank FROM c WHERE combined_score IS NOT NULL QUALIFY rank <= 40),
 w AS (SELECT chunk_id, {_TERMS.format('max(chunk)')} AS t FROM pool_candidates WHERE chunk IS NOT NULL GROUP BY 1), x AS (SELECT query, rank, t FROM t JOIN w USING (chunk_id)),
 gr AS (SELECT query, rank, g, count(*) AS tf FROM (SELECT query, rank, unnest({_GRAMS}) AS g FROM x) GROUP BY 1, 2, 3), nn AS (SELECT query, count(*) AS n FROM t GROUP BY 1), df AS (SELECT query, g, count(*) AS df FROM gr GROUP BY 1, 2),
 v AS (SELECT query, rank, g, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM gr JOIN df USING (query, g) JOIN nn USING (query)), nv AS (SELECT query, rank, sqrt(sum(w * w)) AS m FROM v GROUP BY 1, 2), u AS (SELECT query, rank, g, w / m AS w FROM v JOIN nv USING (query, rank)),
 l AS (SELECT a.query, a.rank AS ra, b.rank AS rb FROM u a JOIN u b ON a.query = b.query AND a.g = b.g AND a.rank < b.rank GROUP BY 1, 2, 3 HAVING round(sum(a.w * b.w), 6) >= 0.9),
 g AS (SELECT query, 0 AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT query FROM t) UNION ALL SELECT g.query, g.r + 1, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.query = g.query AND l.rb = g.r + 1 AND list_contains(g.kept, l.ra)) THEN kept ELSE list_append(kept, g.r + 1) END FROM g WHERE g.r < 40),
 k AS (SELECT query, kept FROM g WHERE r = 40) SELECT t.query, candidate_id, rank::INT AS rank FROM t JOIN k USING (query) WHERE list_contains(kept, rank)""",
    "keyword_pool": f"""WITH {_KPOOL} """ + _top("query, chunk_id, bm25, tfidf, combined", "k", "query", "combined", "chunk_id", 80),
}
SQL["best_sentence"] = typed(SQL["best_sentence"], hits="INT", pos="INT")
QUERIES = {f.__name__: f for f in (bm25_topk, tfidf_topk, tfidf_sublinear, lexical_pool, query_match, dense_knn, dense_ivf, mmr_select, kmeans_clusters, candidates_by_retriever, rrf_fuse, min_max_fusion, exact_dedupe, merge_dupes, context_features, heading_score, best_sentence, final_ultimate, subqueries, expanded_queries, tfidf_dedupe, keyword_pool)}
