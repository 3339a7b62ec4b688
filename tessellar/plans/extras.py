"""Further queries: keyword match, dense-first retrieval, pre-signals, blocks, default model steps, side-by-side reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions.providers import Providers
from tessellar.operators import dense, fusion, lexical, segment
from tessellar.plans import quality as Q
from tessellar.plans import retrieval as R
from tessellar.plans.retrieval import _BM, _KNN, _TERMS, _tf_sql, _top
from tessellar.plans.text_queries import SENTS
from tessellar.session import numbered


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def _pool(s, d, *cols):
    """Candidates with a query, each by its latest delivery."""
    p = _t(s, d, "pool_candidates").filter("trim(query) <> ''").groupBy("candidate_id").agg(F.max_by(F.struct(*cols), "ingested_at").alias("r"))
    return p.select("candidate_id", "r.*")


def keyword_match_score(s, d):
    """How many of a result's comma-separated keywords stand in its sentences, as a share."""
    f = _t(s, d, "final_results").groupBy("result_id").agg(F.max_by(F.struct("keywords", "extracted_sentences"), "ingested_at").alias("r")).select("result_id", "r.*")
    k = F.filter(F.transform(F.split(F.lower("keywords"), ","), lambda x: F.trim(x)), lambda x: x != "")
    hit = F.filter("k", lambda x: F.contains(F.lower("extracted_sentences"), x))
    return f.withColumn("k", k).select("result_id", F.round(F.when((F.size("k") > 0) & F.col("extracted_sentences").isNotNull(), F.size(hit) / F.size("k")).otherwise(0.0), 6).alias("score"))


def neural_rerank(s, d):
    """The default relevance of each candidate's chunk in the neural mix, the best 40 of each query."""
    p = Providers()
    x = _pool(s, d, "query", "chunk", "combined_score").withColumn("query", F.trim("query"))
    base = F.coalesce(F.nanvl("combined_score", F.lit(None).cast("double")), F.lit(0.0))
    x = x.select("query", "candidate_id", F.round(0.4 * base + 0.6 * p.relevance(F.col("query"), F.col("chunk")), 6).alias("neural"))
    return lexical.best(x, "query", "neural", "candidate_id", 40)


def extracted_sentences(s, d):
    """Default extraction: sentences that share a term with the query; none gives the first 200 characters."""
    x = _pool(s, d, "query", "chunk").filter("chunk is not null")
    e = Providers().extract(F.col("query"), F.col("chunk"))
    return x.select("candidate_id", F.md5(e).alias("digest"))


def sentence_similarity(s, d):
    """The largest share of the query's terms that any sentence of a candidate's chunk holds."""
    x = _pool(s, d, "query", "chunk").withColumn("q", F.array_distinct(T.terms(F.col("query"))))
    share = F.transform(T.sentences(F.col("chunk")), lambda z: F.size(F.array_intersect("q", T.terms(z))) / F.size("q"))
    return x.filter(F.size("q") > 0).select("candidate_id", F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 6).alias("similarity"))


def dense_first(s, d):
    """Of each query's 80 nearest rows two lists, by similarity and by label agreement, fused by reciprocal rank."""
    e = _t(s, d, "embeddings")
    near = dense.knn(e, e.filter("vec_id % 50 = 0"), 80)
    a = near.filter("rank <= 20").select("qid", "vec_id", F.lit("dense").alias("method"), (F.col("rank") - 1).alias("rank"))
    b = Q.dense_rerank(s, d).filter("rank <= 40").select("qid", "vec_id", F.lit("rescored").alias("method"), (F.col("rank") - 1).alias("rank"))
    return fusion.rrf(a.unionByName(b), "qid", "vec_id")


def rrf_lexical(s, d):
    """Reciprocal-rank fusion of BM25 and TF-IDF over documents."""
    a = R.bm25_topk(s, d).select("item_id", "doc_id", F.lit("bm25").alias("method"), (F.col("rank") - 1).alias("rank"))
    b = R.tfidf_topk(s, d).select("item_id", "doc_id", F.lit("tfidf").alias("method"), (F.col("rank") - 1).alias("rank"))
    return lexical.best(fusion.rrf(a.unionByName(b), "item_id", "doc_id"), "item_id", "rrf", "doc_id", 60)


def sparse_pre_signal(s, d):
    """The share of each question's terms that the corpus knows."""
    known = lexical.postings(_t(s, d), "doc_id", "text").select("term").distinct().withColumn("known", F.lit(1))
    q = lexical.query_terms(_t(s, d, "benchmark"), "item_id", "question").join(known, "term", "left")
    return q.groupBy("item_id").agg(F.round(F.sum(F.coalesce("known", F.lit(0))) / F.count("*"), 6).alias("pre"))


def heading_hierarchy(s, d):
    """Headings of each document at their depth, each worth one over its depth, at most 1 together."""
    h = segment.lines(_t(s, d)).filter(F.trim("line").rlike(r"^#+\s*\S") & ~segment.is_page_line(F.col("line")))
    depth = F.length(F.regexp_extract(F.trim("line"), "^(#+)", 1))
    return h.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(depth).alias("top"), F.round(F.least(F.lit(1.0), F.sum(0.1 / depth)), 6).alias("bonus"))


def side_by_side(s, d):
    """Benchmark questions beside known questions, row by row, the longer list to its end."""
    a = numbered(_t(s, d, "benchmark").select("item_id"), "item_id")
    return a.join(numbered(_t(s, d, "keywords_excel").select("kw_id"), "kw_id"), "n", "full")


def candidate_union(s, d):
    """The 25 best by BM25 and the 25 best by TF-IDF of each question, as one set."""
    a = R.bm25_topk(s, d).filter("rank <= 25").select("item_id", "doc_id")
    return a.union(R.tfidf_topk(s, d).filter("rank <= 25").select("item_id", "doc_id")).distinct()


def hypothetical_questions(s, d):
    """Default questions of each chunk, by templates over its heading."""
    p = _t(s, d, "pool_candidates").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("heading").alias("h"))
    h = T.unsentinel(T.squash(F.col("h")))
    t = F.array(*[F.concat(F.lit(a), h, F.lit("?")) for a in ("what is said on ", "who is responsible for ", "what figures stand for ")])
    return p.filter(h.isNotNull()).select("chunk_id", F.posexplode(t).alias("n", "question"))


def query_shares(s, d):
    """The rows and chunks of each query, as counts and as parts of all."""
    x = _pool(s, d, "query", "chunk_id").groupBy(F.trim("query").alias("query")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))
    total = x.agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total)).select("query", "n", "chunks", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


def text_blocks(s, d):
    x = segment.blocks(_t(s, d), 1000)
    return x.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max(F.length("block")).alias("longest"), F.sum(F.length("block")).alias("chars"))


_P = "p AS (SELECT candidate_id, trim(r.query) AS query, r.chunk AS chunk, CASE WHEN r.s IS NULL OR isnan(r.s) THEN 0 ELSE r.s END AS s FROM (SELECT candidate_id, arg_max({'query': query, 'chunk': chunk, 's': combined_score}, ingested_at) AS r FROM pool_candidates WHERE trim(query) <> '' GROUP BY 1))"
_REL = f"CASE WHEN len(list_distinct({_TERMS.format('query')})) > 0 THEN len(list_intersect(list_distinct({_TERMS.format('query')}), list_distinct({_TERMS.format('chunk')}))) / len(list_distinct({_TERMS.format('query')})) ELSE 0 END"
_RR80 = _KNN.replace("rank <= 20", "rank <= 80")
SQL = {
    "keyword_match_score": "WITH f AS (SELECT result_id, list_filter(list_transform(string_split(lower(r.k), ','), lambda x: trim(x)), lambda x: x <> '') AS k, r.e AS e FROM (SELECT result_id, arg_max({'k': keywords, 'e': extracted_sentences}, ingested_at) AS r FROM final_results GROUP BY 1)) SELECT result_id, round(CASE WHEN len(k) > 0 AND e IS NOT NULL THEN len(list_filter(k, lambda x: contains(lower(e), x))) / len(k) ELSE 0 END, 6) AS score FROM f",
    "neural_rerank": f"WITH {_P}, x AS (SELECT query, candidate_id, round(0.4::DOUBLE * s + 0.6::DOUBLE * {_REL}, 6) AS neural FROM p) " + _top("query, candidate_id, neural", "x", "query", "neural", "candidate_id", 40),
    "extracted_sentences": f"WITH {_P}, x AS (SELECT candidate_id, chunk, list_filter({SENTS.format('chunk')}, lambda z: len(list_intersect({_TERMS.format('z')}, {_TERMS.format('query')})) > 0) AS h FROM p WHERE chunk IS NOT NULL) SELECT candidate_id, md5(CASE WHEN len(h) > 0 THEN array_to_string(h, ' | ') ELSE substring(chunk, 1, 200) END) AS digest FROM x",
    "sentence_similarity": f"WITH {_P}, x AS (SELECT candidate_id, list_distinct({_TERMS.format('query')}) AS q, {SENTS.format('chunk')} AS ss FROM p) SELECT candidate_id, round(coalesce(list_max(list_transform(ss, lambda z: len(list_intersect(q, list_distinct({_TERMS.format('z')}))) / len(q))), 0), 6) AS similarity FROM x WHERE len(q) > 0",
    "dense_first": f"WITH h AS ({_RR80}), rs AS ({Q.SQL['dense_rerank']}), u AS (SELECT qid, vec_id, 'dense' AS method, rank - 1 AS rank FROM h WHERE rank <= 20 UNION ALL SELECT qid, vec_id, 'rescored', rank - 1 FROM rs WHERE rank <= 40) SELECT qid, vec_id, round(sum(1.0 / (rank + 60)), 9) AS rrf, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM u GROUP BY 1, 2",
    "rrf_lexical": f"WITH {_BM}, {_tf_sql(False)}, a AS ({_top('item_id, doc_id, bm25', 'bm', 'item_id', 'bm25', 'doc_id', 80)}), b AS ({_top('item_id, doc_id, tfidf', 'tf', 'item_id', 'tfidf', 'doc_id', 80)}), u AS (SELECT item_id, doc_id, 'bm25' AS method, rank - 1 AS rank FROM a UNION ALL SELECT item_id, doc_id, 'tfidf', rank - 1 FROM b), g AS (SELECT item_id, doc_id, round(sum(1.0 / (rank + 60)), 9) AS rrf, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM u GROUP BY 1, 2) " + _top("item_id, doc_id, rrf, n_methods, methods", "g", "item_id", "rrf", "doc_id", 60),
    "sparse_pre_signal": f"WITH k AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS term FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('question')}) AS term FROM benchmark) SELECT item_id, round(count(k.term) / count(*), 6) AS pre FROM q LEFT JOIN k USING (term) GROUP BY 1",
    "heading_hierarchy": "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, length(regexp_extract(line, '^(#+)', 1)) AS depth FROM l WHERE regexp_matches(line, '^#+\\s*\\S') AND NOT regexp_matches(line, '(?i)^(#*\\s*)?(Page|p\\.)?\\s*\\d+\\s*(#*\\s*)?$')) SELECT doc_id, count(*) AS n, min(depth)::INT AS top, round(least(1, sum(0.1::DOUBLE / depth)), 6) AS bonus FROM h GROUP BY 1",
    "side_by_side": "SELECT * FROM (SELECT row_number() OVER (ORDER BY item_id) AS n, item_id FROM benchmark) FULL JOIN (SELECT row_number() OVER (ORDER BY kw_id) AS n, kw_id FROM keywords_excel) USING (n)",
    "candidate_union": f"WITH {_BM}, {_tf_sql(False)} SELECT item_id, doc_id FROM ({_top('item_id, doc_id, bm25', 'bm', 'item_id', 'bm25', 'doc_id', 25)}) UNION SELECT item_id, doc_id FROM ({_top('item_id, doc_id, tfidf', 'tf', 'item_id', 'tfidf', 'doc_id', 25)})",
    "hypothetical_questions": "WITH p AS (SELECT chunk_id, lower(trim(regexp_replace(max(heading), '\\s+', ' ', 'g'))) AS h FROM pool_candidates WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT chunk_id, unnest(range(3))::INT AS n, unnest(['what is said on ' || h || '?', 'who is responsible for ' || h || '?', 'what figures stand for ' || h || '?']) AS question FROM p WHERE h NOT IN ('', 'nan', 'null', 'none', 'unknown', 'no heading')",
    "query_shares": "WITH p AS (SELECT candidate_id, r.* FROM (SELECT candidate_id, arg_max({'query': trim(query), 'chunk_id': chunk_id}, ingested_at) AS r FROM pool_candidates WHERE trim(query) <> '' GROUP BY 1)), x AS (SELECT query, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM p GROUP BY 1) SELECT query, n, chunks, round(n / sum(n) OVER (), 9) AS share FROM x",
}
QUERIES = {f.__name__: f for f in (keyword_match_score, neural_rerank, extracted_sentences, sentence_similarity, dense_first, rrf_lexical, sparse_pre_signal, heading_hierarchy, side_by_side, candidate_union, hypothetical_questions, query_shares, text_blocks)}
