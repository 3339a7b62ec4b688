"""Top N items of every group, with a fixed tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: characters that count as blanks around a group's name
BLANKS = " \t\r\n "


def top_n(df: DataFrame, group: Column, item: str, score: Column, n: int, *, descending: bool = True, valid: Column | None = None, version: str | None = None) -> DataFrame:
    """``(grp, item, score, pos)`` of the ``n`` best items of each group; of equal scores the smaller id wins.

    Rows with a null group, id or score, a NaN score, or for which ``valid`` isn't true never count. An id that occurs
    again counts once: the row with the latest ``version`` (nulls first, then the larger score and group) stands for it;
    without ``version`` only rows alike in group and score fall together. Groups of fewer items give all they have; an
    empty table gives no row. Only the three columns used leave the scan, so extra columns cannot clash.

    The rank filter lets Spark place a group limit before and after the shuffle: a task sends at most ``n`` rows of a
    group, so a group that holds a third of all rows costs no more than any other.
    """
    cols = [group.alias("grp"), F.col(item).alias("item"), score.cast("double").alias("score"), (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).alias("ok")]
    if version is None:
        rows = df.select(*cols).distinct()
    else:
        latest = F.max(F.struct(F.col(version).alias("v"), F.struct("score", "grp", "ok").alias("r")))
        rows = df.select(*cols, F.col(version)).filter(F.col("item").isNotNull()).groupBy("item").agg(latest.alias("m")).select("item", "m.r.*")
    rows = rows.filter(F.col("ok") & F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    order = F.col("score").desc() if descending else F.col("score").asc()
    w = Window.partitionBy("grp").orderBy(order, F.col("item").asc())
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select("grp", "item", "score", "pos")


def query_name(column: str) -> Column:
    """A query without the blanks around it; null where nothing is left."""
    q = F.trim(F.col(column), F.lit(BLANKS))
    return F.when(q != "", q)


def found(pool: DataFrame, results: DataFrame, best: int = 10, first: int = 3) -> DataFrame:
    """The best candidates and the best-ranked results of each query as ``(src, row_id)``."""
    a = top_n(pool, query_name("query"), "candidate_id", F.col("combined_score"), best, version="ingested_at")
    b = top_n(results, query_name("query"), "result_id", F.col("rank"), first, descending=False, valid=F.col("rank") >= 1, version="ingested_at")
    return a.select(F.lit("pool_candidates").alias("src"), F.col("item").alias("row_id")).unionByName(b.select(F.lit("final_results").alias("src"), F.col("item").alias("row_id")))


FOUND_SQL = """
WITH p AS (SELECT candidate_id AS id, arg_max({'q': trim(query, ' \t\r\n '), 's': combined_score}, ingested_at) AS r FROM pool_candidates GROUP BY 1),
     f AS (SELECT result_id AS id, arg_max({'q': trim(query, ' \t\r\n '), 's': rank}, ingested_at) AS r FROM final_results GROUP BY 1),
     a AS (SELECT id, row_number() OVER (PARTITION BY r.q ORDER BY r.s DESC, id) AS n FROM p WHERE r.q <> '' AND r.s IS NOT NULL AND NOT isnan(r.s)),
     b AS (SELECT id, row_number() OVER (PARTITION BY r.q ORDER BY r.s, id) AS n FROM f WHERE r.q <> '' AND r.s >= 1)
SELECT 'pool_candidates' AS src, id AS row_id FROM a WHERE n <= 10
UNION ALL SELECT 'final_results', id FROM b WHERE n <= 3
"""
