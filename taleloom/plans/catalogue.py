"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taleloom.plans import corpus_queries, eav_queries, experiment_queries, report_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": eav_queries.p1_found,
    "p1_wide": eav_queries.p1_wide,
    **corpus_queries.QUERIES,
    **experiment_queries.QUERIES,
    **report_queries.QUERIES,
}

SQL: dict[str, str] = {
    "p1_found": eav_queries.P1_FOUND_SQL,
    "p1_wide": eav_queries.p1_wide_sql(eav_queries.METRIC_COLUMNS),
    **corpus_queries.SQL,
    **experiment_queries.SQL,
    **report_queries.SQL,
}
