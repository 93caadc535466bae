"""Data tests on the marts and the gate behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CHECK_SCHEMA = "model string, test string, column string, n_fail bigint"


class QualityGateError(RuntimeError):
    """At least one data test failed."""


# --- failing rows -----------------------------------------------------------

def not_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    )


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys without parent, with their number of rows.

    Both sides shrink to distinct keys first, so a frequent key costs nothing extra.
    """
    keys = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return keys.join(known, column, "left_anti")


def _outside_set(column: str, allowed: list) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def _outside_range(column: str, low: float, high: float) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).between(low, high)


def not_in_set(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(_outside_set(column, allowed))


def not_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(_outside_range(column, low, high))


def otif_score_out_of_range(mart: DataFrame) -> DataFrame:
    """Ids of orders whose score lies outside 0..1."""
    return mart.filter((F.col("otif_score") < 0) | (F.col("otif_score") > 1)).select("po_id")


# --- counts -----------------------------------------------------------------

def _row_checks(df: DataFrame, model: str, conditions: dict[tuple[str, str], Column]) -> DataFrame:
    """Count the rows hit by each condition, all conditions in one pass."""
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    checks = [
        F.struct(F.lit(test).alias("test"), F.lit(column).alias("column"), F.col(f"c{i}").alias("n_fail"))
        for i, (test, column) in enumerate(conditions)
    ]
    return counts.select(F.inline(F.array(*checks))).select(F.lit(model).alias("model"), "*")


def _one(model: str, test: str, column: str, count: DataFrame) -> DataFrame:
    return count.toDF("n_fail").select(
        F.lit(model).alias("model"), F.lit(test).alias("test"), F.lit(column).alias("column"),
        F.coalesce("n_fail", F.lit(0).cast("bigint")).alias("n_fail"),
    )


def run_checks(mart: DataFrame, kpi: DataFrame, staged_orders: DataFrame, parts: DataFrame) -> DataFrame:
    """Every data test of the marts: model, test, column, n_fail, status."""
    orders, suppliers = "marts_otif_kpi", "marts_supplier_kpi"
    score = F.col("otif_score")
    results = [
        _row_checks(mart, orders, {
            **{("not_null", c): F.col(c).isNull() for c in ("po_id", "supplier_id", "part_id", "promised_date")},
            ("in_set", "otif_score"): _outside_set("otif_score", [0, 1]),
            ("score_in_range", "otif_score"): (score < 0) | (score > 1),
        }),
        _one(orders, "unique", "po_id", not_unique(mart, "po_id").agg(F.count(F.lit(1)))),
        _one(orders, "relationships", "supplier_id",
             orphans(mart, "supplier_id", staged_orders, "supplier_id").agg(F.sum("n_rows"))),
        _one(orders, "relationships", "part_id",
             orphans(mart, "part_id", parts, "part_id").agg(F.sum("n_rows"))),
        _row_checks(kpi, suppliers, {
            **{("not_null", c): F.col(c).isNull() for c in ("supplier_id", "total_orders")},
            ("between", "otif_rate"): _outside_range("otif_rate", 0.0, 1.0),
        }),
        _one(suppliers, "unique", "supplier_id", not_unique(kpi, "supplier_id").agg(F.count(F.lit(1)))),
    ]
    return reduce(DataFrame.unionByName, results).withColumn(
        "status", F.when(F.col("n_fail") > 0, "fail").otherwise("pass")
    )


def enforce(checks: DataFrame) -> DataFrame:
    """Stop when a test failed; the table holds one row per test."""
    failed = checks.filter("status = 'fail'").collect()
    if failed:
        raise QualityGateError(
            "; ".join(f"{r['model']}.{r['column']} {r['test']}: {r['n_fail']}" for r in failed)
        )
    return checks
