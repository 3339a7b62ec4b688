"""Queries over the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellar.llm import abuse, leakage, neardup, packing, scans, splitting, topn

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "p2_found": lambda s, d: topn.found(_t(s, d, "pool_candidates"), _t(s, d, "final_results")),
    "p3_found": lambda s, d: splitting.found(_t(s, d, "pool_candidates")),
    "p3_pieces": lambda s, d: splitting.split_oversized(_t(s, d, "pool_candidates")),
    "p3_checks": lambda s, d: splitting.checks(_t(s, d, "pool_candidates")),
    "p4_found": lambda s, d: scans.found(_t(s, d, "pool_candidates")),
    "p4_clean": lambda s, d: scans.reflow(scans.read_lines(_t(s, d, "pool_candidates"))),
    "p5_found": lambda s, d: neardup.found(_t(s, d, "pool_candidates")),
    "p6_sequences": lambda s, d: packing.pack(_t(s, d, "documents")),
    "p6_utilisation": lambda s, d: packing.utilisation(packing.pack(_t(s, d, "documents"))),
    "p6_checks": lambda s, d: packing.checks(_t(s, d, "documents"), packing.pack(_t(s, d, "documents"))),
    "p7_found": lambda s, d: leakage.found(_t(s, d, "documents"), _t(s, d, "benchmark")),
    "p7_leaks": lambda s, d: leakage.leaks(_t(s, d, "documents"), _t(s, d, "benchmark")),
    "p8_found": lambda s, d: abuse.found(_t(s, d, "documents"), _t(s, d, "doc_labels")),
    "p8_rates": lambda s, d: abuse.rates(_t(s, d, "documents"), _t(s, d, "doc_labels")),
    "p5_groups": lambda s, d: neardup.near_groups(_t(s, d, "pool_candidates")),
}

SQL: dict[str, str] = {"p3_checks": splitting.CHECKS_SQL, "p6_checks": packing.CHECKS_SQL, "p3_found": splitting.FOUND_SQL, "p2_found": topn.FOUND_SQL, "p5_found": neardup.FOUND_SQL, "p5_groups": neardup.GROUPS_SQL, "p7_found": leakage.FOUND_SQL}
