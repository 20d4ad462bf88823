"""All registered site-audit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, performance_queries, place_queries, report_queries, scalar_queries, site_queries, source_queries, stream_queries

MODULES = [scalar_queries, performance_queries, audit_queries, source_queries, place_queries, report_queries, site_queries, stream_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["pf7_section_rollup"](spark, sf_dir)


def queries() -> dict:
    return {name: q for module in MODULES for name, q in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
