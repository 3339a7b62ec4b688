"""How much of a benchmark a corpus covers: sentence matches, attribution, greedy cover, methods and bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T


def bench_sentences(bench: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(key, sid, sentence, words)`` of the sentences that have a term at all."""
    s = bench.select(key, F.posexplode(T.sentences(F.col(text))).alias("sid", "sentence"))
    return s.withColumn("words", F.array_distinct(T.terms(F.col("sentence")))).filter(F.size("words") > 0)


def sentence_scores(bench: DataFrame, docs: DataFrame, key: str = "item_id", doc: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``(key, sid, doc, overlap)``: the share of a benchmark sentence's words that a document holds, from ``least`` on.

    Sentences and documents meet by way of their words: at most ``ceil((1 - least) * n) + 1`` of a sentence's words, the
    corpus's rarest, are enough to find every document with that share, so frequent words make no pairs of their own.
    """
    s = bench_sentences(bench, key)
    own = docs.filter(F.col(text).isNotNull()).select(doc, F.array_distinct(T.terms(F.col(text))).alias("dw"))
    held = own.select(doc, F.explode("dw").alias("w"))
    sw = s.select(key, "sid", F.size("words").alias("n"), F.explode("words").alias("w"))
    df = held.join(sw.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rare = sw.join(df, "w", "left").withColumn("r", F.row_number().over(Window.partitionBy(key, "sid").orderBy(F.coalesce("df", F.lit(0)), "w")))
    seeds = rare.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(key, "sid", "w")
    cand = held.join(seeds, "w").select(key, "sid", doc).distinct()
    x = cand.join(s.select(key, "sid", "words"), [key, "sid"]).join(own, doc)
    share = F.size(F.array_intersect("words", "dw")) / F.size("words")
    return x.select(key, "sid", doc, F.round(share, 6).alias("overlap")).filter(F.col("overlap") >= least)


def item_scores(bench: DataFrame, docs: DataFrame, key: str = "item_id", doc: str = "doc_id", text: str = "text", least: float = 15, block_words: int = 2_000_000) -> DataFrame:
    """``(key, doc, score)``: the share in percent of an item's words that a document holds, above ``least``.

    At a low share nearly every pair has some word in common, so pairs aren't joined: the items, the small side, come to the
    driver in blocks of bounded size, and every document counts its words against all items of a block. Null texts and items
    without terms have no row; empty tables give no row.
    """
    own = docs.filter(F.col(text).isNotNull()).select(doc, F.array_distinct(T.terms(F.col(text))).alias("dw"))
    b = bench.select(F.col(key).alias("i"), F.array_distinct(T.terms(F.col(text))).alias("bw")).filter(F.size("bw") > 0)
    blocks = max(1, -(-(b.agg(F.sum(F.size("bw"))).first()[0] or 0) // block_words))
    kinds = own.schema[doc].dataType.simpleString(), b.schema["i"].dataType.simpleString()
    out = None
    for x in range(blocks):
        rows = b.filter(F.pmod(F.xxhash64("i", "bw"), F.lit(blocks)) == x).toArrow().combine_chunks()  # at most about block_words words
        part = own.mapInArrow(_held(docs.sparkSession.sparkContext.broadcast(rows), key, doc, least), f"`{key}` {kinds[1]}, `{doc}` {kinds[0]}, held bigint, n bigint")
        out = part if out is None else out.unionAll(part)
    return out.select(key, doc, F.round(100 * F.col("held") / F.col("n"), 6).alias("score")).filter(F.col("score") > least)


def _held(items, key: str, doc: str, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in items.value.columns)
        n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        flat = pc.list_flatten(lists)
        known = pc.unique(flat)
        word = pc.index_in(flat, known).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)[np.argsort(word, kind="stable")]  # the items of each word, word by word
        first = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(known)))))
        for big in batches:
            for lo in range(0, big.num_rows if len(n) else 0, step := max(1, 200_000 // max(1, len(n)))):
                b = big.slice(lo, step)
                w = pc.index_in(pc.list_flatten(b.column(1)), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column(1))))[w >= 0]
                w = w[w >= 0]
                many = first[w + 1] - first[w]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[w], many)
                held = np.bincount(np.repeat(row, many) * len(n) + of[at], minlength=b.num_rows * len(n))
                hit = np.flatnonzero(100 * held >= least * np.tile(n, b.num_rows))
                d, i = hit // len(n), hit % len(n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), b.column(0).take(pa.array(d)), pa.array(held[hit].astype(np.int64)), pa.array(n[i])], names=[key, doc, "held", "n"])

    return scan


def assign(scores: DataFrame, key: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """Each sentence's best document; of equals the smaller id."""
    w = Window.partitionBy(key, "sid").orderBy(F.col("overlap").desc(), doc)
    return scores.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def greedy_cover(assigned: DataFrame, totals: DataFrame, key: str = "item_id", doc: str = "doc_id", alpha: float = 0.95, hard: int = 5, least: float = 0.8) -> DataFrame:
    """``(key, doc, covered, pick)``: documents by what they cover, taken until ``alpha`` of the item's sentences are covered
    or ``hard`` are taken. As each sentence is credited to one document, the greedy cover is a rank and a running sum."""
    g = assigned.filter(F.col("overlap") >= least).groupBy(key, doc).agg(F.count("*").alias("covered"))
    w = Window.partitionBy(key).orderBy(F.col("covered").desc(), doc)
    x = g.join(totals, key).withColumn("pick", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("covered").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.filter((F.col("pick") <= hard) & (F.col("before") < F.ceil(F.col("n") * alpha))).select(key, doc, "covered", "pick")


def report(cover: DataFrame, totals: DataFrame, key: str = "item_id") -> DataFrame:
    """``(key, sentences, covered, coverage, documents)`` of every item, 0 where nothing covers it."""
    g = cover.groupBy(key).agg(F.sum("covered").alias("c"), F.count("*").alias("d"))
    x = totals.join(g, key, "left")
    return x.select(key, F.col("n").alias("sentences"), F.coalesce("c", F.lit(0)).alias("covered"), F.round(100 * F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("coverage"), F.coalesce("d", F.lit(0)).alias("documents"))


def adaptive(scores: DataFrame, key: str = "item_id") -> DataFrame:
    """``(key, score, pattern, n)`` from an item's document scores in percent: the top one if it is strong or alone, else a
    discounted sum of the top three where several share the content."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "doc_id")
    top = scores.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    n = scores.groupBy(key).agg(F.count("*").alias("n"))
    p = top.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("r") == i, F.col("score"))), F.lit(0.0)).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))]).join(n, key)
    total = F.least(F.lit(100.0), F.col("a") + 0.7 * F.col("b") + 0.5 * F.col("c"))
    spread = (F.col("n") >= 2) & ((F.col("a") >= 40) | (F.col("a") + F.col("b") + F.col("c") >= 60))
    score = F.when(F.col("a") >= 80, F.col("a")).when(spread, total).otherwise(F.col("a"))
    pattern = F.when((F.col("n") == 1) | (F.col("a") >= 80), "concentrated").when(F.col("a") < 60, "distributed").otherwise("mixed")
    return p.select(key, F.round(score, 6).alias("score"), pattern.alias("pattern"), "n")
