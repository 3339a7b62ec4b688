"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.operators.packed import split_packed


def p1_found(spark, d):
    return split_packed(spark.read.parquet(f"{d}/keywords_excel.parquet"), "keywords", "kw_id", value="keyword")


def p1_keyword_rates(spark, d):
    """How often each keyword stands in a cell, and in how many cells."""
    k = p1_found(spark, d).groupBy(F.lower("keyword").alias("keyword"))
    return k.agg(F.count("*").alias("n"), F.count_distinct("kw_id").alias("cells"))


QUERIES = {"p1_found": p1_found, "p1_keyword_rates": p1_keyword_rates}
SQL: dict[str, str] = {}
