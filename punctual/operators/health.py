"""Health of the tables, the model and the call log in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.sources.lake import path_exists
from punctual.sources.reports import call_stats


def has_rows(spark: SparkSession, table: str) -> bool:
    """Does the table exist with at least one row; reads one row only."""
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def health_checks(spark: SparkSession, tables: list[str], paths: dict[str, str]) -> DataFrame:
    """check, ok for each table and named path."""
    rows = [(table, has_rows(spark, table)) for table in tables]
    rows += [(name, path_exists(spark, path)) for name, path in paths.items()]
    return spark.createDataFrame(rows, "check string, ok boolean")


def pipeline_health(checks: DataFrame, drift: DataFrame, log: DataFrame) -> DataFrame:
    """healthy, checks, drift and log statistics; each input is a report of a few rows."""
    return checks.agg(
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("healthy"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "ok")))).alias("checks"),
    ).select(
        "healthy", "checks",
        drift.select(F.struct("*")).scalar().alias("drift"),
        call_stats(log).select(F.struct("*")).scalar().alias("rag"),
    )
