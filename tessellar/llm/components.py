"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.session import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)``: the least node reachable from each node that has a link, by alternating large-star and
    small-star steps (each a join-free aggregate; rounds grow with the logarithm of a component's diameter).

    Links to itself and repeated links don't count; an empty table gives no row.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    state = None
    for _ in range(most_rounds):
        edges = cut(star(star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
