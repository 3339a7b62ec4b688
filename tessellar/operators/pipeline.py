"""The retrieval pipeline over pooled candidates, for all queries at once, as a preset says: pool, dense and neural
re-ranking, features of context, headings and keywords, and the final score by the sentences extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.config import PipelineConfig
from tessellar.functions import text as T
from tessellar.functions.providers import Providers, cosine_of_terms, share_of_terms
from tessellar.operators import fusion
from tessellar.operators.lexical import best, min_max

# What the sub-queries of a question begin with.
SUBQUERIES = ("what is reported on ", "figures for ", "policy on ", "responsibility for ", "risks of ", "targets for ", "changes in ")
ID, DIGITS = "candidate_id", 9


def names(c: Column) -> Column:
    """Words that begin with a capital, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b[A-Z][a-z0-9]+"), 0))


def heading_relevance(query: Column, qt: Column, heading: Column, p: Providers) -> Column:
    """0.3 x the part of the query's terms + 0.3 x the part of its names + 0.4 x similarity; 0 without a heading."""
    n, ht = names(query), T.terms(heading)
    part = F.when(F.size(n) > 0, F.size(F.array_intersect(n, names(heading))) / F.size(n)).otherwise(0.0)
    return F.when(heading.isNotNull(), 0.3 * share_of_terms(qt, ht) + 0.3 * part + 0.4 * p.alike(query, heading, qt, ht)).otherwise(0.0)


def hierarchy_bonus(query: Column, qt: Column, chunk: Column, p: Providers) -> Column:
    """Over the heading lines of a chunk, each one's relevance by its depth, at most 1 together."""
    lines = F.filter(F.split(F.coalesce(chunk, F.lit("")), "\n"), lambda x: x.rlike(r"^#+\s*\S"))
    each = F.transform(lines, lambda x: heading_relevance(query, qt, x, p) / F.length(F.regexp_extract(x, "^(#+)", 1)))
    return F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda a, b: a + b))


def heading_boost(query: Column, qt: Column, heading: Column, chunk: Column, p: Providers) -> Column:
    own = F.when(~F.contains(F.lower(heading), F.lit("introduction")), heading)
    return 0.6 * heading_relevance(query, qt, own, p) + 0.4 * hierarchy_bonus(query, qt, chunk, p)


def keyword_score(keywords: Column, text: Column, ct: Column, p: Providers) -> Column:
    """0.6 x the part of the keywords that stand in the text + 0.4 x their mean similarity to it; 0 without keywords."""
    k = F.coalesce(keywords, F.array().cast("array<string>"))
    hits = F.size(F.filter(k, lambda x: F.contains(F.lower(text), F.lower(x))))
    each = F.transform(k, lambda x: p.similarity(x, text)) if p.similarity else F.transform(F.transform(k, T.terms), lambda x: cosine_of_terms(x, ct))
    return F.when(F.size(k) > 0, 0.6 * hits / F.size(k) + 0.4 * F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(k)).otherwise(0.0)


def sentence_similarity(query: Column, qt: Column, chunk: Column, p: Providers) -> Column:
    """The highest similarity of a sentence that shares a term with the query, else that of the first 200 characters."""
    first = F.substring(chunk, 1, 200)
    if p.similarity:
        hits = F.filter(T.sentences(chunk), lambda s: F.size(F.array_intersect(T.terms(s), qt)) > 0)
        top = F.array_max(F.transform(hits, lambda s: p.similarity(query, s)))
    else:  # a sentence without a shared term is not similar at all
        top = F.array_max(F.transform(F.transform(T.sentences(chunk), T.terms), lambda t: cosine_of_terms(qt, t)))
        top = F.when(top > 0, top)
    return F.coalesce(top, p.alike(query, first, qt, T.terms(first)), F.lit(0.0))


def _round(c: Column) -> Column:
    return F.round(c, DIGITS)


def _fused(x: DataFrame, cfg: PipelineConfig, p: Providers) -> DataFrame:
    """Reciprocal-rank fusion of lists of the pool: by its score and by similarity, or by similarity to subqueries."""
    if cfg.fuse == "nearest":
        x = best(x, "query", "near", ID, cfg.pool, "_r").drop("_r")
    cols = [F.struct(F.lit("pool").alias("method"), F.col("pool_score").alias("v")), F.struct(F.lit("near").alias("method"), F.col("near").alias("v"))]
    if cfg.fuse == "subqueries":
        sub = lambda t: (F.concat(F.lit(t), F.array_join("qt", " ")), F.col("chunk"), F.concat(T.terms(F.lit(t)), "qt"), F.col("ct"))
        cols = [cols[0], *[F.struct(F.lit(f"sub{i}").alias("method"), _round(p.alike(*sub(t))).alias("v")) for i, t in enumerate(SUBQUERIES)]]
    long = x.select("query", ID, F.explode(F.array(*cols)).alias("l")).select("query", ID, "l.method", "l.v")
    lists = best(long, ["query", "method"], "v", ID, cfg.pool).withColumn("rank", F.col("rank") - 1)
    f = fusion.rrf(lists, "query", ID).select("query", ID, F.col("rrf"))
    x = x.join(f, ["query", ID])
    return x.withColumn("dense", _round(F.col("rrf") * (1 + cfg.main * F.col("near")))).drop("rrf")


def search(cands: DataFrame, chunks: DataFrame, keywords: DataFrame, cfg: PipelineConfig, p: Providers | None = None) -> DataFrame:
    """``(query, candidate_id, pool_score, dense, neural, enhanced, similarity, ultimate, rank)``: the best of each query.

    ``cands``: ``(query, candidate_id, chunk_id, bm25_score, tfidf_score)``, rows without both scores left out;
    ``chunks``: ``(chunk_id, chunk, heading)``, one row each; ``keywords``: ``(query, keywords)``, lists. Texts are joined
    to what the pool keeps, unless keywords count in the pool already. Ties go to the smaller candidate id; a chunk
    without text scores by its candidate's scores alone.
    """
    p = p or Providers()
    c = cands.filter(F.col("bm25_score").isNotNull() & F.col("tfidf_score").isNotNull())
    x = min_max(c, "query", "bm25_score", "tfidf_score").select("query", ID, "chunk_id", "bm25_score_n", "tfidf_score_n")
    words = keywords.select("query", "keywords")
    kw = _round(keyword_score(F.col("keywords"), F.col("chunk"), F.col("ct"), p))
    qt = F.array_distinct(T.terms(F.col("query"))).alias("qt")
    texts = lambda c: c.select("chunk_id", F.coalesce("chunk", F.lit("")).alias("chunk"), "heading", T.terms(F.col("chunk")).alias("ct"))
    score = cfg.lexical_mix[0] * F.col("bm25_score_n") + cfg.lexical_mix[1] * F.col("tfidf_score_n")
    if len(cfg.lexical_mix) > 2:
        x = x.join(texts(chunks), "chunk_id").join(words, "query", "left").withColumn("kw", kw)
        x = best(x.withColumn("pool_score", _round(score + cfg.lexical_mix[2] * F.col("kw"))), "query", "pool_score", ID, cfg.pool, "_r")
    else:
        x = best(x.withColumn("pool_score", _round(score)), "query", "pool_score", ID, cfg.pool, "_r")
        few = chunks.join(x.select("chunk_id").distinct(), "chunk_id", "left_semi")
        x = x.join(texts(few), "chunk_id").join(words, "query", "left").withColumn("kw", kw)
    x = x.select("*", qt).withColumn("near", _round(p.alike(F.col("query"), F.col("chunk"), F.col("qt"), F.col("ct"))))
    if cfg.fuse == "scores":
        mix = cfg.dense_mix
        dense = mix[0] * F.col("pool_score") + mix[1] * F.col("near")
        x = x.withColumn("dense", _round(dense + mix[2] * F.col("kw") if len(mix) > 2 else dense))
    else:
        x = _fused(x, cfg, p)
    x = best(x.drop("_r"), "query", "dense", ID, cfg.dense, "_r").drop("_r")
    if cfg.neural:
        m = cfg.neural_mix
        x = x.withColumn("neural", _round(m[0] * F.col("pool_score") + m[1] * F.col("dense") + m[2] * p.relevant(F.col("query"), F.col("chunk"), F.col("qt"), F.col("ct"))))
        x = best(x, "query", "neural", ID, cfg.neural, "_r").drop("_r")
    else:
        x = x.withColumn("neural", F.col("dense"))
    shared = F.size(F.array_intersect("qt", "ct")), F.size(F.array_intersect(names(F.col("query")), names(F.col("chunk"))))
    more = cfg.context * 0.1 * shared[0] + cfg.context * 0.2 * shared[1]
    if cfg.heading:
        more = more + cfg.heading * heading_boost(F.col("query"), F.col("qt"), F.col("heading"), F.col("chunk"), p)
    if cfg.keyword:
        more = more + cfg.keyword * F.col("kw")
    x = x.withColumn("enhanced", _round(F.col("neural") + more)).withColumn("similarity", _round(sentence_similarity(F.col("query"), F.col("qt"), F.col("chunk"), p)))
    last = fusion.ultimate(F.col("enhanced"), F.col("similarity"), cfg.sentence)
    x = x.withColumn("ultimate", _round(last * (1 + F.col("kw")) if cfg.keyword else last))
    by = "ultimate" if cfg.sort_by == "ultimate" else "similarity"
    return best(x, "query", by, ID, cfg.final).select("query", ID, "pool_score", "dense", "neural", "enhanced", "similarity", "ultimate", "rank")
