"""Bronze to Silver: trimmed, typed columns and per-order delivery flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.scalars import days_between, half_up, lenient_date, whole_number, yes_flag


def _trimmed(*names: str) -> dict:
    return {name: F.trim(F.col(name)) for name in names}


def _select(df: DataFrame, columns: dict) -> DataFrame:
    return df.select([column.alias(name) for name, column in columns.items()])


def stg_parts_master(bronze: DataFrame) -> DataFrame:
    return _select(bronze, {
        **_trimmed("part_id", "part_family", "criticality_class"),
        "unit_cost": F.col("unit_cost").cast("double"),
        "lead_time_days": F.col("lead_time_days").cast("int"),
        **_trimmed("supplier_id_primary", "supplier_risk_class"),
        "is_repairable": yes_flag(F.col("is_repairable")),
        "shelf_life_days": F.col("shelf_life_days").cast("double"),
    })


#: Columns of staged orders that follow from the others.
OUTCOME = ("delay_days", "is_on_time", "is_in_full", "is_otif")


def stg_purchase_orders(bronze: DataFrame) -> DataFrame:
    """An order counts as delivered when its raw receipt date is present, parsable or not."""
    filled = F.try_divide(F.col("received_qty").cast("double"), F.col("ordered_qty").cast("double"))
    typed = _select(bronze, {
        **_trimmed("po_id", "supplier_id", "site_id", "part_id"),
        **{name: lenient_date(F.col(name)) for name in ("order_date", "promised_date", "receipt_date")},
        **{name: whole_number(F.col(name)) for name in ("ordered_qty", "received_qty")},
        "is_delivered": F.col("receipt_date").isNotNull(),
        "fill_rate": F.when(F.col("ordered_qty") > 0, half_up(filled, 4)).otherwise(F.lit(1.0)),
    })
    return with_outcome(typed).select(*[c for c in typed.columns if c != "fill_rate"], *OUTCOME, "fill_rate")


def with_outcome(orders: DataFrame) -> DataFrame:
    """Typed orders with their delay and delivery flags."""
    received = F.col("is_delivered")
    in_time = F.coalesce(F.col("receipt_date") <= F.col("promised_date"), F.lit(False))
    complete = F.coalesce(F.col("received_qty") >= F.col("ordered_qty"), F.lit(False))
    delay = days_between(F.col("promised_date"), F.col("receipt_date"))
    values = (delay, in_time, complete, in_time & complete)
    return orders.withColumns({name: F.when(received, value) for name, value in zip(OUTCOME, values)})


def stg_quality_incidents(bronze: DataFrame) -> DataFrame:
    return _select(bronze, {
        **_trimmed("incident_id"),
        "incident_date": lenient_date(F.col("incident_date")),
        **_trimmed("part_id", "supplier_id", "site_id", "defect_severity", "defect_type"),
        "scrap_qty": F.col("scrap_qty").cast("bigint"),
    })


def stg_supply_chain_history(bronze: DataFrame) -> DataFrame:
    quantities = ["consumption_qty", "on_hand_qty", "backorder_qty", "blocked_qty", "forecast_qty"]
    return _select(bronze, {
        "snapshot_date": lenient_date(F.col("date")),
        **_trimmed("site_id", "part_id"),
        "planned_maintenance": F.coalesce(F.col("planned_maintenance"), F.lit(False)),
        **{name: F.col(name).cast("bigint") for name in quantities},
        **_trimmed("forecast_type"),
        "forecast_uplift_pct": F.col("forecast_uplift_pct").cast("double"),
    })


def deduplicate(df: DataFrame, *keys: str) -> DataFrame:
    """One row per business key: the smallest by its other columns, NULL first.

    A minimum is combined before the shuffle, so a key with very many copies
    sends one row per task and not its whole group to one task.
    """
    others = [name for name in df.columns if name not in keys]
    if not others:
        return df.dropDuplicates(list(keys))
    return (
        df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__row"))
        .select(*keys, "__row.*").select(df.columns)
    )
