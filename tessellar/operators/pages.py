"""Page gate and the joining of its findings with those of retrieval; rounds of keyword-driven search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions.providers import cosine_of_terms
from tessellar.operators.lexical import best
from tessellar.session import cut


def keyword_hits(text: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))


def gate(pages: DataFrame, keywords: list[str], least: float = 0.6, require: bool = True) -> DataFrame:
    """Pages with ``relevance`` (1 with a keyword's literal, else 0), their hits and what is missing. Without keywords all
    pages pass, or none if a hit is required."""
    k = F.array(*map(F.lit, keywords)).cast("array<string>")
    t = F.lower(F.coalesce("page_text", F.lit("")))
    x = pages.withColumn("matched", F.filter(k, lambda w: F.contains(t, w))).withColumn("missing", F.filter(k, lambda w: ~F.contains(t, w)))
    x = x.withColumn("relevance", F.when(F.size("matched") > 0, 1.0).otherwise(0.0))
    if not keywords:
        return x.filter(F.lit(not require))
    return x.filter(F.col("relevance") >= least)


def rank_page_chunks(chunks: DataFrame, keywords: list[str], n: int) -> DataFrame:
    """The best ``n`` chunks of each page of each file by score plus 0.05 for each keyword hit."""
    k = F.array(*map(F.lit, keywords)).cast("array<string>")
    x = chunks.withColumn("adjusted", F.round(F.coalesce("score", F.lit(0.0)) + 0.05 * F.greatest(keyword_hits(F.col("chunk"), k), F.lit(0)), 6))
    return best(x.drop("chunk"), ["document", "page_no"], "adjusted", "chunk_id", n)


def local_scores(chunks: DataFrame, keywords: list[str], least: float = 0.6) -> DataFrame:
    """Adds ``local``, the similarity of a chunk's terms to the keywords', and its ``rank`` within its page of its file;
    chunks of at least ``least`` and the best of each page stay."""
    k = F.array_distinct(T.terms(F.lit(" ".join(keywords))))
    x = chunks.withColumn("local", F.round(cosine_of_terms(k, T.terms(F.col("chunk"))), 6)).drop("chunk")
    w = Window.partitionBy("document", "page_no").orderBy(F.col("local").desc(), "chunk_id")
    return x.withColumn("rank", F.row_number().over(w)).filter((F.col("local") >= least) | (F.col("rank") == 1))


def remaining(all_pages: DataFrame, used: DataFrame) -> DataFrame:
    """Known pages of each file that no result stands on."""
    return all_pages.filter("page_no is not null").distinct().join(used.filter("page_no is not null").distinct(), ["document", "page_no"], "left_anti")


def union_sources(*parts: tuple[str, DataFrame]) -> DataFrame:
    """All rows of all parts with their source; scores keep their own scales."""
    out = None
    for name, df in parts:
        x = df.select(F.lit(name).alias("source"), "document", "page_no", "chunk_id", "score")
        out = x if out is None else out.unionByName(x)
    return out


def rounds(cands: DataFrame, keywords: DataFrame, size: int = 40, most: int = 4, enough: float = 0.9, least_new: int = 3) -> DataFrame:
    """``(query, chunk_id, score, round, coverage)``: search in rounds, for all queries at once.

    A round takes a query's best unseen chunks, from the second on only such as hold a keyword still missing and half as
    many; what it looked at counts as seen, also what it then trimmed. A query ends when its coverage is enough or a round
    brings it fewer than ``least_new`` chunks and keywords. ``cands``: ``(query, chunk_id, score, chunk)``;
    ``keywords``: ``(query, keyword)``. A query without keywords is covered after the first round.
    """
    hits = cut(cands.join(keywords, "query").filter(F.contains(F.lower("chunk"), F.lower("keyword"))).select("query", "chunk_id", "keyword").distinct(), "hits")
    n = keywords.groupBy("query").agg(F.count_distinct("keyword").alias("n"))
    slim = cut(cands.groupBy("query", "chunk_id").agg(F.max("score").alias("score")), "cands")
    seen = slim.select("query", "chunk_id").limit(0)
    done = slim.select("query").limit(0)
    covered = hits.select("query", "keyword").limit(0)
    taken = None
    for i in range(most):
        k = size if i == 0 else -(-size // 2)
        open_ = slim.join(done, "query", "left_anti").join(seen, ["query", "chunk_id"], "left_anti")
        if i:
            open_ = open_.join(hits.join(covered, ["query", "keyword"], "left_anti").select("query", "chunk_id").distinct(), ["query", "chunk_id"], "left_semi")
        looked = cut(best(open_, "query", "score", "chunk_id", 2 * k, "r"), "round")
        if looked.isEmpty():
            break
        kept = looked.filter(F.col("r") <= k).select("query", "chunk_id", "score", F.lit(i + 1).alias("round"))
        seen = seen.unionByName(looked.select("query", "chunk_id"))
        now = cut(covered.unionByName(hits.join(kept, ["query", "chunk_id"], "left_semi").select("query", "keyword")).distinct(), "covered")
        gain = now.groupBy("query").agg(F.count("*").alias("c")).join(covered.groupBy("query").agg(F.count("*").alias("o")), "query", "left")
        new = kept.groupBy("query").agg(F.count("*").alias("new"))
        state = slim.select("query").distinct().join(n, "query", "left").join(gain, "query", "left").join(new, "query", "left").fillna(0)
        state = state.withColumn("coverage", F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(1.0))
        done = cut(done.unionByName(state.filter((F.col("coverage") >= enough) | ((F.col("new") < least_new) & (F.col("c") - F.col("o") < least_new))).select("query")).distinct(), "done")
        covered = now
        part = kept.join(state.select("query", F.round("coverage", 6).alias("coverage")), "query")
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        return slim.select("query", "chunk_id", "score", F.lit(1).alias("round"), F.lit(1.0).alias("coverage")).limit(0)
    return taken


def missing_bundles(missing: DataFrame, most: int = 12, size: int = 3) -> DataFrame:
    """``(query, n, rewrite)``: each query with bundles of three of its first twelve missing keywords, in their order."""
    w = Window.partitionBy("query").orderBy("keyword")
    x = missing.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).withColumn("n", F.floor((F.col("r") - 1) / size).cast("int"))
    g = x.groupBy("query", "n").agg(F.array_sort(F.collect_list("keyword")).alias("k"))
    return g.select("query", "n", F.concat_ws(" ", "query", F.array_join("k", " ")).alias("rewrite"))
