"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellar.plans import extras, mixture, packed_fields, presets, qc, quality, reports, retrieval, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (packed_fields, text_queries, retrieval, quality, reports, extras, presets, qc, mixture)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
