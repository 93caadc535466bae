"""Raw extracts to Gold, data tests, model and drift in one run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from punctual.operators import (
    documents, drift, health, kpis, metrics, quality, scoring, silver, training,
)
from punctual.operators.features import build_features, feature_matrix, split
from punctual.schemas import BRONZE, OTIF_COLUMNS
from punctual.session import scratch_path, shuffles_freed, stored
from punctual.sources import lake, reports
from punctual.sources.raw import load_bronze

#: Column of the stored order mart that splits it, as ``2024-01``.
MONTH = "order_month"


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


STAGING = {
    "parts_master": silver.stg_parts_master,
    "purchase_orders": silver.stg_purchase_orders,
    "quality_incidents": silver.stg_quality_incidents,
    "supply_chain_history": silver.stg_supply_chain_history,
}


@dataclass
class Result:
    manifest: DataFrame
    checks: DataFrame
    metrics: DataFrame | None = None
    drift: DataFrame | None = None
    health: DataFrame | None = None


def stage(spark: SparkSession, bronze_folder: str) -> dict[str, DataFrame]:
    """Silver views by name."""
    views = {
        f"stg_{name}": STAGING[name](lake.read_bronze(spark, bronze_folder, name)) for name in BRONZE
    }
    lake.publish_silver(views)
    return views


def build_gold(
    spark: SparkSession, views: dict[str, DataFrame], database: str = "gold", location: str | None = None
) -> None:
    """Each mart is computed from the stored one below it, so the join runs once.

    The order mart is split by is_delivered and order month and sorted by id: KPIs read
    delivered orders only, a span of dates reads its months, a lookup few row groups.

    Columns that follow from others are not shuffled but computed where they are written. The joined
    rows are stored before they are dealt into ranges: the disk never holds the joins' shuffles
    and that of the ranges together, and the bounds of the ranges are found without joining again.
    """
    lake.create_database(spark, database, location)
    with shuffles_freed(spark):
        narrow = views["stg_purchase_orders"].drop(*silver.OUTCOME)
        joined = scratch_path(spark, "joined-orders")
        kpis.with_part(narrow, views["stg_parts_master"]).write.option("compression", "zstd").parquet(joined)
        dealt = spark.read.parquet(joined).repartitionByRange("is_delivered", _month(F.col("order_date")), "po_id")
        enriched = kpis.with_measures(silver.with_outcome(dealt))
        lake.write_gold(
            enriched.withColumn(MONTH, _month(F.col("order_date"))), "marts_otif_kpi", database,
            partition_by=("is_delivered", MONTH), sort_by=("po_id",), dealt=True,
        )
        lake.remove(spark, joined)
        mart = read_orders(spark, database)
        lake.write_gold(kpis.otif_summary(mart), "marts_otif_summary", database)
        lake.write_gold(
            kpis.supplier_kpi(mart, views["stg_quality_incidents"]), "marts_supplier_kpi", database
        )


def read_orders(spark: SparkSession, database: str = "gold") -> DataFrame:
    """The order mart with its columns in their usual order."""
    return lake.read_gold(spark, "marts_otif_kpi", database).select(OTIF_COLUMNS)


def orders_between(spark: SparkSession, first: date, last: date, database: str = "gold") -> DataFrame:
    """The mart's orders of a span of order dates, both included; other months are not read."""
    months = F.col(MONTH).between(_month(F.lit(first)), _month(F.lit(last)))
    days = F.col("order_date").between(F.lit(first), F.lit(last))
    return lake.read_gold(spark, "marts_otif_kpi", database).filter(months & days).select(OTIF_COLUMNS)


def build_index(spark: SparkSession, database: str, embedder_path: str) -> None:
    """Supplier texts and their vectors as Gold tables, and the embedder for questions."""
    kpi = lake.read_gold(spark, "marts_supplier_kpi", database)
    lake.write_gold(documents.supplier_documents(kpi), "supplier_documents", database)
    texts = lake.read_gold(spark, "supplier_documents", database).select("id", "text")
    embedder = documents.fit_embedder(texts)
    embedder.save(spark, embedder_path)
    lake.write_gold(documents.embed(texts, embedder), "supplier_vectors", database)


def train_and_evaluate(spark: SparkSession, mart: DataFrame, lake_folder: str, **trees) -> DataFrame:
    """Train on one part of the delivered orders, report on the other; returns the metrics."""
    model_path, folder = f"{lake_folder}/model", f"{lake_folder}/reports"
    matrix = feature_matrix(build_features(mart), "po_id")
    trained = training.train(matrix, model_path, **trees)
    reports.write_report(
        trained.withColumn("baseline_otif_rate", metrics.baseline_rate(matrix).scalar()), f"{folder}/model_eval"
    )
    model = training.load_model(model_path)
    scored = scoring.model_scorer(model)(split(matrix)[1])
    predicted = scored.withColumn("predicted_otif", (F.col("otif_proba") >= 0.5).cast("int"))
    reports.write_report(metrics.classification_report(predicted), f"{folder}/classification")
    reports.write_report(
        training.global_importance(spark, training.importances(model)), f"{folder}/feature_importance"
    )
    return spark.read.json(f"{folder}/model_eval")


def run(
    spark: SparkSession, raw_folder: str, lake_folder: str, database: str = "gold",
    on_missing: str = "error", fit_model: bool = True, read_options: dict[str, dict] | None = None, **trees,
) -> Result:
    """Load, transform, test, then index, train, measure drift and health; a failed
    test stops everything after it."""
    bronze = f"{lake_folder}/bronze"
    manifest = load_bronze(spark, raw_folder, bronze, on_missing=on_missing, options=read_options)
    views = stage(spark, bronze)
    build_gold(spark, views, database, f"{lake_folder}/gold")
    mart = read_orders(spark, database)
    kpi = lake.read_gold(spark, "marts_supplier_kpi", database)
    checks = stored(
        quality.run_checks(mart, kpi, views["stg_purchase_orders"], views["stg_parts_master"]), "checks"
    )
    result = Result(manifest, quality.enforce(checks))
    build_index(spark, database, f"{lake_folder}/embedder")
    if fit_model:
        result.metrics = train_and_evaluate(spark, mart, lake_folder, **trees)
    drift_path = f"{lake_folder}/reports/drift"
    reports.write_report(drift.mean_shift_report(drift.populations(mart)), drift_path)
    result.drift = reports.load_drift_report(spark, drift_path)
    tables = ["marts_otif_kpi", "marts_otif_summary", "marts_supplier_kpi", "supplier_vectors"]
    found = health.health_checks(
        spark, [f"{database}.{name}" for name in tables],
        {"bronze": bronze, "model": f"{lake_folder}/model"},
    )
    result.health = health.pipeline_health(
        found, result.drift, reports.read_log(spark, f"{lake_folder}/rag_logs")
    )
    return result
