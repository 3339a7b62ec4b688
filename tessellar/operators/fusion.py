"""Fusion of ranked lists, duplicates among results, feature bonuses and final scores."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T


def rrf(lists: DataFrame, group: str, item: str, method: str = "method", rank: str = "rank", k: int = 60) -> DataFrame:
    """``(group, item, rrf, n_methods, methods)``: reciprocal-rank fusion of a long table of ranked lists, ranks from 0."""
    return lists.groupBy(group, item).agg(F.round(F.sum(1.0 / (F.col(rank) + k)), 9).alias("rrf"), F.count_distinct(method).alias("n_methods"), F.array_join(F.array_sort(F.collect_set(method)), ",").alias("methods"))


def scale_each(scores: DataFrame, group: list[str], score: str) -> DataFrame:
    """Adds ``norm``: scores scaled to 0..1 within each list, 0.5 where all are equal."""
    bounds = scores.groupBy(*group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    x = scores.join(bounds, group)
    return x.withColumn("norm", F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)).drop("lo", "hi")


def weighted(scores: DataFrame, weights: DataFrame, group: str, item: str, method: str = "method") -> DataFrame:
    """``(group, item, fused, n_methods)``: the sum of each method's weight times its scaled score."""
    x = scores.join(weights, [group, method])
    return x.groupBy(group, item).agg(F.round(F.sum(F.col("weight") * F.col("norm")), 6).alias("fused"), F.count("*").alias("n_methods"))


def distinct_texts(df: DataFrame, text: str, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """The first row of each text in the order given, texts compared by their words; null texts are one text."""
    w = Window.partitionBy(*(group or []), F.md5(F.array_join(T.words(F.col(text)), " "))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_context(df: DataFrame, group: str, context: str, sentence: str, score: str, key: str) -> DataFrame:
    """Rows of one context merged: distinct sentences joined by `` | `` in id order, the best score, the first id."""
    c = F.lower(F.trim(F.coalesce(context, F.lit(""))))
    first = df.groupBy(F.col(group), c.alias("ctx"), F.lower(F.trim(sentence)).alias("low")).agg(F.min_by(F.trim(sentence), key).alias("s"), F.min(key).alias("k"), F.max(score).alias("sc"))
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("low", F.lit("")) != "", F.struct("k", "s"))))
    g = first.groupBy(group, "ctx").agg(parts.alias("p"), F.max("sc").alias(score), F.min("k").alias(key))
    return g.select(group, F.md5("ctx").alias("context"), F.array_join(F.transform("p", lambda x: x["s"]), " | ").alias("merged"), score, key)


def overlap_bonus(q: Column, c: Column, token: float = 0.1, entity: float = 0.2) -> Column:
    """A bonus for shared words, and a larger one for shared names (words that begin with a capital)."""
    names = lambda x: F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b[A-Z][a-z0-9]+"), 0))
    return token * F.size(F.array_intersect(T.terms(q), T.terms(c))) + entity * F.size(F.array_intersect(names(q), names(c)))


def ultimate(enhanced: Column, similarity: Column, factor: float = 0.2) -> Column:
    return enhanced * (1 + factor * similarity)


def tfidf_links(df: DataFrame, group: str, item: str, rank: str, text: str, least: float) -> DataFrame:
    """``(group, a, b)``: rows of a group whose uni- and bigram TF-IDF vectors, fitted on the group alone, have a cosine of
    ``least`` or more, ``a`` ranked before ``b``. A group holds what a ranking left, a bounded number; null texts are alike
    to nothing."""
    t = T.terms(F.col(text))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = df.select(group, item, rank, t.alias("t")).select(group, item, rank, F.explode(F.concat("t", pairs)).alias("g")).groupBy(group, item, rank, "g").agg(F.count("*").alias("tf"))
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    x = grams.withColumn("df", F.count("*").over(Window.partitionBy(group, "g"))).join(n, group)
    x = x.select(group, item, rank, "g", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    x = x.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, item))))
    x = x.select(group, item, rank, "g", (F.col("w") / F.col("norm")).alias("w"))
    a, b = x.select(group, "g", F.col(item).alias("a"), F.col(rank).alias("ra"), F.col("w").alias("wa")), x.select(group, "g", F.col(item).alias("b"), F.col(rank).alias("rb"), F.col("w").alias("wb"))
    dots = a.join(b, [group, "g"]).filter("ra < rb").groupBy(group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))
    return dots.filter(F.round("cos", 6) >= least).select(group, "a", "b")


def tfidf_dedupe(df: DataFrame, group: str, item: str, rank: str, terms: str, least: float) -> DataFrame:
    """``(group, item, rank)`` of rows whose uni- and bigram TF-IDF vector, fitted on the group alone, has a cosine under
    ``least`` with every better row kept: ``tfidf_links`` and ``greedy_dedupe`` in one pass over rows in the order of groups
    and ranks. ``terms``: a text's terms, parted by blanks. A group holds what a ranking left, a bounded number; null texts
    are alike to nothing."""
    x = df.select(group, item, rank, terms).repartition(group).sortWithinPartitions(group, rank)
    kind = {c: x.schema[c].dataType.simpleString() for c in (group, item, rank)}

    def kept(texts: list[str | None]) -> list[bool]:
        index: dict[str, int] = {}
        row, gram = [], []
        for r, t in enumerate(texts):
            w = (t or "").split()
            found = [*w, *map(" ".join, pairwise(w))]
            row += [r] * len(found)
            gram += [index.setdefault(g, len(index)) for g in found]
        tf = np.bincount(np.array(row, int) * len(index) + np.array(gram, int), minlength=len(texts) * len(index)).reshape(len(texts), len(index))
        v = tf * (np.log((1 + len(texts)) / (1 + np.count_nonzero(tf, axis=0))) + 1)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
        near = np.floor(v @ v.T * 1e6 + 0.5) / 1e6 >= least
        keep: list[bool] = []
        for r in range(len(texts)):
            keep.append(not near[r, : r][keep].any())
        return keep

    def walk(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            whole = t[group].combine_chunks()
            n = len(whole)
            ends = np.flatnonzero(np.asarray(pc.not_equal(whole[1:], whole[:-1]))) + 1 if n else np.zeros(0, int)
            rest = t.slice(ends[-1]) if len(ends) else t
            if len(ends):
                yield from done(t.slice(0, ends[-1]), ends)
        if rest is not None and rest.num_rows:
            yield from done(rest, np.array([rest.num_rows]))

    def done(t: pa.Table, ends: np.ndarray):
        texts, at = t[terms].to_pylist(), 0
        keep = []
        for end in ends:
            keep += kept(texts[at:end])
            at = end
        yield from t.select([group, item, rank]).filter(pa.array(keep)).combine_chunks().to_batches()

    return x.mapInArrow(walk, ", ".join(f"`{c}` {k}" for c, k in kind.items()))


def greedy_dedupe(df: DataFrame, links: DataFrame, group: str, item: str, rank: str) -> DataFrame:
    """Walks each group by rank and drops what is linked to an item already kept. Only items that have a link are gathered,
    a group at a time; all others pass."""
    linked = links.select(group, F.col("a").alias(item)).unionAll(links.select(group, F.col("b").alias(item))).distinct()
    held = df.join(linked, [group, item], "left_semi").select(group, F.col(item).alias("x"), F.col(rank).alias("r"))
    edges = links.groupBy(group).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    g = held.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("items")).join(edges, group)
    kind = dict(df.dtypes)

    def walk(batches):
        for b in batches:
            out = []
            for q, items, es in zip(*(c.to_pylist() for c in b.columns), strict=True):
                near: dict = {}
                for e in es:
                    near.setdefault(e["a"], set()).add(e["b"])
                    near.setdefault(e["b"], set()).add(e["a"])
                kept: set = set()
                for i in items:
                    if near.get(i["x"], set()) & kept:
                        out.append((q, i["x"]))
                    else:
                        kept.add(i["x"])
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], b.column(1).type.value_type.field("x").type)], names=[group, item])

    gone = g.select(group, "items", "edges").mapInArrow(walk, f"`{group}` {kind[group]}, `{item}` {kind[item]}")
    return df.join(gone, [group, item], "left_anti")
