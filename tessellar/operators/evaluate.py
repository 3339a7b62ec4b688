"""Agreement of pairs of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import text as T


def bleu(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``(*keys, bleu)``: the geometric mean of clipped one- and two-word matches over the first text's, in percent, row by
    row on Arrow batches. 0 where the first text has less than two words, or a key is null."""
    slim = pairs.select(*keys, T.words(F.col(a)).alias("_a"), T.words(F.col(b)).alias("_b"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            held: dict[str, list[int]] = {c: [] for c in ("m1", "n1", "m2", "n2")}
            for x, y in zip(t.column("_a").to_pylist(), t.column("_b").to_pylist(), strict=True):
                for n, p, q in ((1, x, y), (2, list(pairwise(x)), list(pairwise(y)))):
                    there = Counter(q)
                    held[f"m{n}"].append(sum(min(k, there[g]) for g, k in Counter(p).items()))
                    held[f"n{n}"].append(len(p))
            yield pa.RecordBatch.from_arrays([*(t.column(k) for k in keys), *(pa.array(v, pa.int64()) for v in held.values())], names=[*keys, *held])

    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    x = slim.mapInArrow(scan, f"{kinds}, m1 bigint, n1 bigint, m2 bigint, n2 bigint")
    part = lambda n: F.log(F.col(f"m{n}") / F.col(f"n{n}") + 1e-10)
    some = reduce(lambda p, k: p & F.col(k).isNotNull(), keys, F.col("n2") > 0)
    return x.select(*keys, F.round(F.when(some, 100 * F.exp((part(1) + part(2)) / 2)).otherwise(0.0), 6).alias("bleu"))


def rouge_l(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, rouge_l)``: the F1 of the longest common subsequence of words, in percent, row by row on Arrow batches."""
    slim = pairs.select(F.col(key).alias("k"), T.words(F.col(a)).alias("a"), T.words(F.col(b)).alias("b"))

    def lcs(x: list[str], y: list[str]) -> int:
        ids = {w: i for i, w in enumerate(dict.fromkeys(y))}
        yy, row = np.array([ids[w] for w in y], np.int64), np.zeros(len(y) + 1, np.int64)
        for w in x:
            new = row.copy()
            new[1:] = np.maximum(row[1:], np.where(yy == ids.get(w, -1), row[:-1] + 1, 0))
            row = np.maximum.accumulate(new)
        return int(row[-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for x, y in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
                n = lcs(x, y) if x and y else 0
                out.append(round(200 * n / (len(x) + len(y)), 6) if n else 0.0)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(out, pa.float64())], names=[key, "rouge_l"])

    return slim.mapInArrow(scan, f"`{key}` {slim.schema['k'].dataType.simpleString()}, rouge_l double")


def ratio(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, ratio)``: matching-blocks similarity of two texts in percent."""
    import difflib

    slim = pairs.select(F.col(key).alias("k"), F.coalesce(F.col(a), F.lit("")).alias("a"), F.coalesce(F.col(b), F.lit("")).alias("b"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = [round(100 * difflib.SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio(), 6) for x, y in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(out, pa.float64())], names=[key, "ratio"])

    return slim.mapInArrow(scan, f"`{key}` {slim.schema['k'].dataType.simpleString()}, ratio double")
