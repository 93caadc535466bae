"""JSON reports and the call log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.functions.scalars import half_up
from punctual.schemas import DRIFT_REPORT_SCHEMA, LOG_SCHEMA


def write_report(report: DataFrame, path: str) -> None:
    """Overwrite one JSON report; reports hold a row or a handful, hence one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def _no_report(spark: SparkSession, status: str, summary: str) -> DataFrame:
    return spark.range(1).select(
        F.from_json(F.lit("{}"), DRIFT_REPORT_SCHEMA).alias("r")
    ).select(
        "r.drift_detected", "r.drift_share", F.lit(status).alias("status"),
        F.lit(summary).alias("summary"), "r.measured_at", "r.details",
    )


def load_drift_report(spark: SparkSession, path: str) -> DataFrame:
    """The stored drift report in one row; absent or broken reports are told by status."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return _no_report(spark, "not_measured", "no report at this path")
    raw = text.filter(F.length(F.trim("value")) > 0).agg(F.max("value").alias("value"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    parsed = raw.select(
        F.from_json("value", DRIFT_REPORT_SCHEMA).alias("r"),
        F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("ok"),
        F.coalesce(kind.isNotNull(), F.lit(False)).alias("is_json"),
    )
    bad = F.when(F.col("is_json"), F.lit("report is JSON but no object")).otherwise(
        F.lit("report is not JSON")
    )
    return parsed.select(
        F.when(F.col("ok"), F.col("r.drift_detected")).alias("drift_detected"),
        F.when(F.col("ok"), F.col("r.drift_share")).alias("drift_share"),
        F.when(F.col("ok"), F.col("r.status")).otherwise("invalid_report").alias("status"),
        F.when(F.col("ok"), F.col("r.summary")).otherwise(bad).alias("summary"),
        F.when(F.col("ok"), F.col("r.measured_at")).alias("measured_at"),
        F.when(F.col("ok"), F.col("r.details")).alias("details"),
    )


def log_calls(calls: DataFrame, path: str) -> None:
    """Append answered prompts (prompt, response, latency_ms, tokens_used, docs) to the log."""
    calls.select(
        F.current_timestamp().cast("double").alias("ts"),
        "prompt",
        "response",
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.col("tokens_used").cast("int").alias("tokens_used"),
        F.size("docs").alias("docs_retrieved"),
    ).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The call log; empty when nothing was logged yet."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def call_stats(log: DataFrame) -> DataFrame:
    """Calls, mean latency and tokens; zeros for an empty log."""
    return log.agg(
        F.count(F.lit(1)).alias("total_calls"),
        half_up(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
