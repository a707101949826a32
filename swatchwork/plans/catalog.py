"""All queries of the core library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swatchwork.plans import audit_queries, check_queries, choice_queries, file_queries, measure_queries, pixel_queries, ring_queries, scene_queries, search_queries, shape_queries, table_queries

_MODULES = (pixel_queries, table_queries, shape_queries, audit_queries, check_queries, choice_queries, scene_queries, measure_queries, ring_queries, search_queries, file_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["detail_gate"](spark, sf_dir)
