"""Gold marts: enriched orders, segment summary, supplier and global KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.joins import lookup_join
from punctual.functions.scalars import days_between, half_up, share
from punctual.schemas import OTIF_COLUMNS

SEGMENTS = {
    "supplier": "supplier_id",
    "part_family": "part_family",
    "criticality_class": "criticality_class",
}


def otif_enriched(orders: DataFrame, parts: DataFrame) -> DataFrame:
    """Orders with their part's attributes; an unknown part leaves them NULL."""
    return with_measures(with_part(orders, parts))


def with_part(orders: DataFrame, parts: DataFrame) -> DataFrame:
    """The lookup alone, whatever the columns of the orders."""
    attributes = parts.select(
        "part_id",
        F.col("lead_time_days").alias("standard_lead_time_days"),
        "unit_cost", "part_family", "criticality_class", "supplier_risk_class",
        "is_repairable", "shelf_life_days",
    )
    return lookup_join(orders, attributes, "part_id")


def with_measures(orders: DataFrame) -> DataFrame:
    """What follows from an order and its part's attributes."""
    lead_time = F.when(
        F.col("receipt_date").isNotNull(), days_between(F.col("order_date"), F.col("receipt_date"))
    )
    return orders.withColumns({
        "actual_lead_time_days": lead_time,
        "lead_time_variance_days": lead_time - F.col("standard_lead_time_days"),
        "total_order_cost": half_up(F.col("ordered_qty") * F.col("unit_cost"), 2),
        "otif_score": F.when(F.col("is_otif"), 1.0).when(~F.col("is_otif"), 0.0),
    }).select(OTIF_COLUMNS)


def delivered_only(mart: DataFrame) -> DataFrame:
    """Orders with an outcome. is_delivered says the same and prunes a table split by it."""
    return mart.filter(F.col("is_delivered") & F.col("is_otif").isNotNull())


def orders_by_id(mart: DataFrame, *po_ids: str) -> DataFrame:
    """Mart rows of a few given ids, filtered at the scan."""
    return mart.filter(F.col("po_id").isin(*po_ids))


def _segment_measures() -> list:
    orders = F.count(F.lit(1))
    hits = F.count_if("is_otif")
    return [
        orders.alias("total_orders"),
        hits.alias("otif_orders"),
        half_up(hits * F.lit(100.0) / orders, 2).alias("otif_rate_pct"),
        half_up(F.avg("delay_days"), 1).alias("avg_delay_days"),
        half_up(F.avg("fill_rate"), 3).alias("avg_fill_rate"),
    ]


def otif_by(mart: DataFrame, segment: str) -> DataFrame:
    """OTIF summary for one segment type; NULL is a segment of its own."""
    column = SEGMENTS[segment]
    return (
        delivered_only(mart).groupBy(F.col(column).alias("segment_value")).agg(*_segment_measures())
        .select(F.lit(segment).alias("segment_type"), "*")
    )


def otif_summary(mart: DataFrame) -> DataFrame:
    """All three segment types in one pass over the orders."""
    columns = list(SEGMENTS.values())
    grouped = (
        delivered_only(mart).select(*columns, "is_otif", "delay_days", "fill_rate")
        .groupingSets([[c] for c in columns], *columns)
        .agg(F.grouping_id().alias("__set"), *_segment_measures())
    )
    # grouping_id sets a bit, first column highest, for each column not grouped by.
    last = len(columns) - 1
    marks = {name: (2 ** len(columns) - 1) - 2 ** (last - i) for i, name in enumerate(SEGMENTS)}
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, column in SEGMENTS.items():
        kind = F.when(F.col("__set") == marks[name], name).otherwise(kind)
        value = F.when(F.col("__set") == marks[name], F.col(column)).otherwise(value)
    return grouped.select(
        kind.alias("segment_type"), value.alias("segment_value"),
        "total_orders", "otif_orders", "otif_rate_pct", "avg_delay_days", "avg_fill_rate",
    )


def incident_stats(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("supplier_id").agg(
        F.count("incident_id").alias("total_incidents"),
        F.sum("scrap_qty").alias("total_scrap_qty"),
        F.count_if(F.col("defect_severity") == "Critical").alias("critical_incidents"),
    )


def supplier_stats(mart: DataFrame) -> DataFrame:
    delivered = F.count_if("is_delivered")
    on_time, in_full, otif = (F.count_if(c) for c in ("is_on_time", "is_in_full", "is_otif"))
    return mart.groupBy("supplier_id").agg(
        F.max("supplier_risk_class").alias("supplier_risk_class"),
        F.count("po_id").alias("total_orders"),
        delivered.alias("delivered_orders"),
        F.count_if(~F.col("is_delivered")).alias("pending_orders"),
        on_time.alias("on_time_orders"),
        in_full.alias("in_full_orders"),
        otif.alias("otif_orders"),
        share(on_time, delivered, 4).alias("on_time_rate"),
        share(in_full, delivered, 4).alias("in_full_rate"),
        share(otif, delivered, 4).alias("otif_rate"),
        half_up(F.avg("delay_days"), 2).alias("avg_delay_days"),
        F.max("delay_days").alias("max_delay_days"),
        half_up(F.sum("total_order_cost"), 2).alias("total_ordered_spend"),
    )


def supplier_kpi(mart: DataFrame, incidents: DataFrame) -> DataFrame:
    """Both inputs shrink to one row per supplier before they meet."""
    zero = F.lit(0).cast("bigint")
    counts = ["total_incidents", "critical_incidents", "total_scrap_qty"]
    stats = supplier_stats(mart)
    return stats.join(incident_stats(incidents), "supplier_id", "left").select(
        *stats.columns, *[F.coalesce(F.col(c), zero).alias(c) for c in counts]
    )


def global_kpi(mart: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))

    def rate(column):
        return F.coalesce(half_up(column, 4), F.lit(0.0))

    def mean_of(flag):
        return F.try_divide(F.count_if(flag).cast("double"), rows.cast("double"))

    return mart.filter(F.col("is_delivered") & F.col("otif_score").isNotNull()).agg(
        rate(F.avg("otif_score")).alias("global_otif"),
        rate(mean_of("is_on_time")).alias("on_time_rate"),
        rate(mean_of("is_in_full")).alias("in_full_rate"),
        rows.alias("total_orders"),
    )
