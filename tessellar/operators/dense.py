"""Vector search: exact in blocks, and by an inverted file of centroids; diversity selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.operators.lexical import best


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))


def knn(base: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", block: int = 20_000, skip_self: bool = True) -> DataFrame:
    """``(qid, key, sim, rank)``: the ``n`` nearest by dot product of every query, against all rows.

    Queries meet the rows in blocks of bounded size; a task keeps the best ``n`` of its rows for each query, so what is
    shuffled is ``n`` rows a query and task. Null vectors take no part.
    """
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("qid"), F.col(vector).alias("v"))
    total = q.count()
    blocks = max(1, -(-total // block))
    out = None
    for i in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect() if total else []
        if not rows:
            continue
        held = base.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                own, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for lo in range(0, len(ids), 2000):
                    s = np.round(m[lo : lo + 2000] @ x.T, 5)
                    if skip_self:
                        s[ids[lo : lo + 2000, None] == own[None, :]] = -np.inf
                    k = min(n, len(own))
                    # of equal similarities the smaller id: sort all where the cut is among equals
                    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                    sims = np.take_along_axis(s, order, 1)
                    ok = np.isfinite(sims).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 2000], k)[ok]), pa.array(own[order].ravel()[ok]), pa.array(sims.ravel()[ok])], names=["qid", key, "sim"])

        part = base.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(scan, f"qid bigint, `{key}` bigint, sim double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], f"qid bigint, `{key}` bigint, sim double")
    return best(out, "qid", "sim", key, n)


def kmeans(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(x), x


def clusters(df: DataFrame, k: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, cluster)`` by k-means with ``max(2, sqrt(N / 4))`` clusters."""
    k = k or max(2, int((df.count() / 4) ** 0.5))
    model, x = kmeans(df, k, key, vector)
    return model.transform(x).select(key, F.col("prediction").alias("cluster"))


def ivf(base: DataFrame, queries: DataFrame, n: int, cells: int | None = None, probed: float = 0.7, sample: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate ``knn``: every row is filed under its nearest centroid, and a query meets the rows of the nearest
    cells, ``probed`` of all (vectors without clusters need that many for a recall over 0.9; a test measures it). There are
    ``cells`` cells, by default the root of the number of rows and no fewer than 16, so no cell holds a fixed part of the
    rows. Centroids are fitted on at most ``sample`` rows, drawn by a hash of the id."""
    rows = base.filter(F.col(vector).isNotNull())
    cells = cells or max(16, min(sample // 4, int(rows.count() ** 0.5)))
    probes = max(1, -(-int(cells * probed * 1000) // 1000))
    model, _ = kmeans(rows.orderBy(F.xxhash64(key), key).limit(sample), cells, key, vector)
    centres = np.array(model.clusterCenters(), np.float64)
    held = base.sparkSession.sparkContext.broadcast(centres)

    def near(m: int):
        def scan(batches):
            c = held.value
            for b in batches:
                x = _matrix(b.column(1))
                if not len(x):
                    continue
                d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
                cell = np.argsort(d, axis=1, kind="stable")[:, :m]
                row = np.repeat(np.arange(len(x)), cell.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell.ravel().astype(np.int32))], names=["id", "v", "cell"])

        return scan

    filed = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(near(1), "id bigint, v array<float>, cell int")
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(near(probes), "id bigint, v array<float>, cell int")
    pairs = filed.join(asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), "cell"), "cell").filter("id <> qid")

    def score(batches):
        for b in batches:
            if b.num_rows:
                s = np.round((_matrix(b.column(2)) * _matrix(b.column(3))).sum(1), 5)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["qid", key, "sim"])

    return best(pairs.select("qid", "id", "v", "qv").mapInArrow(score, f"qid bigint, `{key}` bigint, sim double"), "qid", "sim", key, n)


def mmr(cands: DataFrame, base: DataFrame, n: int, trade: float = 0.7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, key, pick)``: of each query's candidates ``n`` by maximal marginal relevance; similarity to what is already
    picked counts from zero up. Queries of no more than ``n`` candidates keep their order. Each choice depends on the
    ones before it, so a query's candidates, bounded by the search before, form one group."""
    x = cands.join(base.select(F.col(key).cast("bigint").alias(key), vector), key)

    def pick(t: pa.Table) -> pa.Table:
        qid, ids, sims, rank = t["qid"].to_numpy(), t[key].to_numpy(), t["sim"].to_numpy(), t["rank"].to_numpy()
        m = _matrix(t[vector].combine_chunks())
        order = np.argsort(rank, kind="stable")
        if len(ids) <= n:
            chosen = list(order)
        else:
            inner, chosen, top = m @ m.T, [], np.zeros(len(ids))
            left = list(order)
            while len(chosen) < n:
                i = max(left, key=lambda j: (round(trade * sims[j] - (1 - trade) * top[j], 9), -rank[j]))
                chosen.append(i)
                left.remove(i)
                top = np.maximum(top, inner[i])
        return pa.table({"qid": qid[: len(chosen)], key: ids[chosen], "pick": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return x.groupBy("qid").applyInArrow(pick, f"qid bigint, `{key}` bigint, pick int")
