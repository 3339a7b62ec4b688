"""Mixture of retrievers: signals of each retriever before and after retrieval, and the weights they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions.vectors import cosine, dot, mean_vector
from tessellar.operators import lexical
from tessellar.session import cut


#: centroids sent to all tasks at once; more come in blocks
BLOCK = 10_000


def centroids(df: DataFrame, cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """``(cluster, centre, n)``: the mean vector and size of each cluster."""
    m = mean_vector(df, [cluster], vector).withColumnRenamed(vector, "centre")
    return m.join(df.groupBy(cluster).agg(F.count("*").alias("n")), cluster)


def _over_centroids(rows: DataFrame, centres: DataFrame, key: str, vector: str, part: Column) -> DataFrame:
    """``(key, s)``: the sum of ``part`` (of ``n``, the number ``k`` of centroids and the squared distance ``d2``) over all
    centroids, of which a block of bounded size at a time goes to every task."""
    c = cut(centres.select("centre", "n"), "centres")
    k = c.count()
    blocks = max(1, -(-k // BLOCK))
    d2 = dot(F.col(vector), F.col(vector)) - 2 * dot(F.col(vector), F.col("centre")) + dot(F.col("centre"), F.col("centre"))
    out = None
    for i in range(blocks):
        block = c.filter(F.pmod(F.xxhash64("centre", "n"), F.lit(blocks)) == i) if blocks > 1 else c
        x = rows.select(key, vector).join(F.broadcast(block)).withColumn("d2", d2).withColumn("k", F.lit(k)).groupBy(key).agg(F.sum(part).alias("s"))
        out = x if out is None else out.unionAll(x)
    return out.groupBy(key).agg(F.sum("s").alias("s"))


def pre_signal(queries: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, pre)``: the length of the vector of (cluster size / clusters) / distance over centroids away from the query;
    0.5 where there is none."""
    part = F.when(F.col("d2") > 1e-9, F.pow(F.col("n") / F.col("k") / F.sqrt("d2"), 2))
    return _over_centroids(queries, centres, key, vector, part).select(key, F.round(F.coalesce(F.sqrt("s"), F.lit(0.5)), 5).alias("pre"))


def post_signal(hits: DataFrame, base: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, post)``: the length of the vector, over a query's hits, of the lengths of 1 / distance to each centroid. Only
    rows that some query hit are compared."""
    own = base.join(hits.select(key).distinct(), key, "left_semi")
    x = _over_centroids(own, centres, key, vector, F.when(F.col("d2") > 1e-9, 1 / F.col("d2")))
    return hits.join(x, key).groupBy("qid").agg(F.round(F.sqrt(F.sum("s")), 5).alias("post"))


def _pairs(hits: DataFrame, base: DataFrame, key: str, vector: str) -> DataFrame:
    """Ordered pairs of a query's hits, of which the search before left a bounded number."""
    x = hits.select("qid", key).join(base.select(key, vector), key)
    a = x.select("qid", F.col(key).alias("a"), F.col(vector).alias("va"))
    b = x.select("qid", F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, "qid").filter("a <> b")


def diversity(hits: DataFrame, base: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, diversity)``: one less the mean similarity of the hits' pairs, not below 0; 0 with fewer than two hits."""
    p = _pairs(hits, base, key, vector).groupBy("qid").agg(F.avg(cosine(F.col("va"), F.col("vb"))).alias("m"))
    return hits.select("qid").distinct().join(p, "qid", "left").select("qid", F.round(F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("m")), F.lit(0.0)), 5).alias("diversity"))


def moran(hits: DataFrame, base: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, moran)``: Moran's I of the hits' component sums under their similarities, moved to 0..1; 0 for fewer than
    three hits or where a denominator is 0."""
    x = hits.select("qid", key).join(base.select(key, F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double")).alias("x")), key)
    m = x.groupBy("qid").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    c = x.join(m, "qid").select("qid", key, "n", (F.col("x") - F.col("m")).alias("z"))
    den = c.groupBy("qid").agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.first("n").alias("n"))
    p = _pairs(hits, base, key, vector).withColumn("w", cosine(F.col("va"), F.col("vb")))
    p = p.join(c.select("qid", F.col(key).alias("a"), F.col("z").alias("za")), ["qid", "a"]).join(c.select("qid", F.col(key).alias("b"), F.col("z").alias("zb")), ["qid", "b"])
    num = p.groupBy("qid").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("num"))
    i = F.col("n") / F.col("w") * F.col("num") / F.col("den")
    ok = (F.col("n") >= 3) & (F.abs("w") > 1e-12) & (F.col("den") > 1e-12)
    return den.join(num, "qid", "left").select("qid", F.round(F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (i + 1) / 2))).otherwise(0.0), 5).alias("moran"))


def sparse_pre(vectors: DataFrame, idf: DataFrame, queries: DataFrame, key: str, qkey: str, text: str) -> DataFrame:
    """``(qkey, method, pre)``: for BM25 the part of the query's terms that the corpus knows, for TF-IDF the mean of the
    query's unit vector over all terms; 0 for a query without terms."""
    words = queries.select(qkey, F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term"))
    known = words.join(vectors.select("term").distinct().withColumn("known", F.lit(1)), "term", "left").groupBy(qkey).agg((F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("pre"))
    w = lexical.postings(queries, qkey, text, True).join(idf, "term").select(qkey, (F.col("tf") * F.col("idf")).alias("w"))
    mean = w.groupBy(qkey).agg((F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("s")).join(F.broadcast(idf.agg(F.count("*").alias("n"))))  # one row
    both = known.select(qkey, F.lit("bm25").alias("method"), "pre").unionByName(mean.select(qkey, F.lit("tfidf").alias("method"), (F.col("s") / F.col("n")).alias("pre")))
    every = queries.select(qkey, F.explode(F.array(F.lit("bm25"), F.lit("tfidf"))).alias("method"))
    return every.join(both, [qkey, "method"], "left").select(qkey, "method", F.round(F.coalesce("pre", F.lit(0.0)), 6).alias("pre"))


def sparse_signals(hits: DataFrame, vectors: DataFrame, group: list[str], key: str) -> DataFrame:
    """``(*group, post, moran)`` of lists of a bounded number of hits: one less the mean cosine of the hits' vectors, and
    Moran's I of their sums under these cosines, both as for dense hits."""
    x = hits.select(*group, key).join(vectors, key)
    a, b = x.select(*group, "term", F.col(key).alias("a"), F.col("w").alias("wa")), x.select(*group, "term", F.col(key).alias("b"), F.col("w").alias("wb"))
    pairs = a.join(b, [*group, "term"]).filter("a <> b").groupBy(*group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    sums = hits.select(*group, key).join(vectors.groupBy(key).agg(F.sum("w").alias("x")), key, "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    z = sums.join(sums.groupBy(*group).agg(F.avg("x").alias("m"), F.count("*").alias("n")), group).select(*group, key, "n", (F.col("x") - F.col("m")).alias("z"))
    den = z.groupBy(*group).agg(F.first("n").alias("n"), F.sum(F.col("z") * F.col("z")).alias("den"))
    p = pairs.join(z.select(*group, F.col(key).alias("a"), F.col("z").alias("za")), [*group, "a"]).join(z.select(*group, F.col(key).alias("b"), F.col("z").alias("zb")), [*group, "b"])
    num = p.groupBy(*group).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("num"))
    y = den.join(num, group, "left")
    post = F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("w", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))))
    ok = (F.col("n") >= 3) & (F.coalesce("w", F.lit(0.0)) > 1e-12) & (F.col("den") > 1e-12)
    i = F.col("n") / F.col("w") * F.col("num") / F.col("den")
    return y.select(*group, F.round(post, 5).alias("post"), F.round(F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (i + 1) / 2))).otherwise(0.0), 5).alias("moran"))


def weights(signals: DataFrame, group: str, mix: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """``(group, method, weight)`` from ``pre``, ``post`` and ``moran``: their mix, scaled to sum 1; equal where all are 0."""
    s = mix[0] * F.col("pre") + mix[1] * F.col("post") + mix[2] * F.col("moran")
    w = Window.partitionBy(group)
    x = signals.withColumn("s", s)
    return x.select(group, "method", F.round(F.when(F.sum("s").over(w) > 0, F.col("s") / F.sum("s").over(w)).otherwise(1.0 / F.count("*").over(w)), 6).alias("weight"))
