"""Vector arithmetic on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def mean_vector(df, group: list[str], column: str, weight: Column | None = None):
    """Weighted mean vector of each group, by position: partial sums instead of collected vectors."""
    w = F.lit(1.0) if weight is None else weight
    x = df.select(*group, w.alias("w"), F.posexplode(column).alias("i", "v"))
    s = x.groupBy(*group, "i").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("v"))
    return s.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(column))
