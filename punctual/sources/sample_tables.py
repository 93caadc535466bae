"""The ERP tables as views over the generic sample tables.

Orders are order lines, parts and their suppliers are the part and supplier
tables, incidents and stock history come from the event table. Keys of the
orders are made from their own columns, so no sort or shuffle is needed for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from punctual.functions.joins import estimated_bytes, lookup_chain, lookup_join

# Given, so that no file is opened before the query runs.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SPREAD_BYTES = 1 << 20
UNKNOWN_PART = 1_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a part of a table whose few files would keep only some busy.

    Tables with at least one split per core, as all large ones, are left alone.
    """
    pieces = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(estimated_bytes(df) / SPREAD_BYTES))
    return df.repartition(pieces, key) if df.rdd.getNumPartitions() < pieces else df


def _site(key: Column) -> Column:
    return F.concat(F.lit("SITE0"), (key % 6 + 1).cast("string"))


def _supplier_count(spark: SparkSession, folder: str) -> Column:
    return table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()


def parts_master(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("__supplier"), "s_acctbal"
    )
    parts = table(spark, folder, "part").withColumn(
        "__supplier", F.col("p_partkey") % _supplier_count(spark, folder)
    )
    size = F.col("p_size")
    balance = F.col("s_acctbal")
    return lookup_join(parts, suppliers, "__supplier").select(
        F.col("p_partkey").cast("string").alias("part_id"),
        F.col("p_type").alias("part_family"),
        F.when(size <= 16, "A").when(size <= 33, "B").otherwise("C").alias("criticality_class"),
        F.col("p_retailprice").alias("unit_cost"),
        size.alias("lead_time_days"),
        F.col("__supplier").cast("string").alias("supplier_id_primary"),
        F.when(balance < 3000, "High").when(balance < 7000, "Medium").otherwise("Low")
        .alias("supplier_risk_class"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "Yes").otherwise("No").alias("is_repairable"),
        F.when(size % 10 == 0, size * F.lit(30.0)).alias("shelf_life_days"),
    )


def purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    # Days take less room in the shuffles than instants.
    lines = table(spark, folder, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    lines = spread(lines, "l_orderkey")
    # Headers get their customer before the lines do, which are many more and wider.
    headers = lookup_join(headers, customers, "o_custkey")
    lines = lookup_chain(lines, [(headers, "l_orderkey", "inner"), (parts, "l_partkey", "left")])
    ordered = F.col("o_orderdate")
    quantity = F.col("l_quantity")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return lines.select(
        F.concat_ws(
            "-", *[F.col(k).cast("string") for k in keys], F.col("l_shipdate").cast("string")
        ).alias("po_id"),
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        _site(F.col("c_nationkey")).alias("site_id"),
        # Orders of every fiftieth part name one that the master does not know.
        (F.col("l_partkey") + F.when(F.col("l_partkey") % 50 == 0, UNKNOWN_PART).otherwise(0)).cast("string").alias("part_id"),
        ordered.alias("order_date"),
        F.date_add(ordered, F.col("p_size")).alias("promised_date"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("receipt_date"),
        quantity.alias("ordered_qty"),
        F.when(F.col("l_linestatus") == "O", F.lit(0.0))
        .when(F.col("l_returnflag") == "R", quantity - 1).otherwise(quantity).alias("received_qty"),
    )


def quality_incidents(spark: SparkSession, folder: str) -> DataFrame:
    part_count = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, folder, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("QI"), event.cast("string")).alias("incident_id"),
        F.col("ts").cast("date").alias("incident_date"),
        (event % part_count).cast("string").alias("part_id"),
        (user % _supplier_count(spark, folder)).cast("string").alias("supplier_id"),
        _site(user).alias("site_id"),
        F.when(value < 10, "Minor").when(value < 50, "Major").otherwise("Critical")
        .alias("defect_severity"),
        F.lit("Material").alias("defect_type"),
        (event % 13 + 1).cast("bigint").alias("scrap_qty"),
    )


def supply_chain_history(spark: SparkSession, folder: str) -> DataFrame:
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("ts").cast("date").alias("date"),
        _site(user).alias("site_id"),
        (event % 2000).cast("string").alias("part_id"),
        F.when(kind == "error", True).when(kind != "view", False).alias("planned_maintenance"),
        F.floor(value).cast("bigint").alias("consumption_qty"),
        (event % 500).cast("bigint").alias("on_hand_qty"),
        (event % 40).cast("bigint").alias("backorder_qty"),
        (user % 20).cast("bigint").alias("blocked_qty"),
        (event % 500 + 25).cast("bigint").alias("forecast_qty"),
        F.when(event % 3 == 0, "Statistical").when(event % 3 == 1, "Manual").otherwise("ML")
        .alias("forecast_type"),
        (value / 1000).alias("forecast_uplift_pct"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about suppliers made from every event, and every conversation turn."""
    suppliers = _supplier_count(spark, folder)
    event, user = F.col("event_id"), F.col("user_id")
    asked = table(spark, folder, "events").select(
        F.concat(F.lit("E"), event.cast("string")).alias("question_id"),
        F.when(event % 8 == 0, F.concat(
            F.lit("Pourquoi le fournisseur "), (user % suppliers).cast("string"), F.lit(" a-t-il chuté ?")))
        .when(event % 8 == 1, F.concat(
            F.lit("Supplier: "), (user % (suppliers * 2)).cast("string"), F.lit(" status ?")))
        .when(event % 8 == 2, "Quel est le niveau d'OTIF global ?")
        .when(event % 8 == 3, "Quels incidents qualité sont critiques ?")
        .when(event % 8 == 4, F.concat(F.lit("Où en est la commande "), event.cast("string"), F.lit(" ?")))
        .when(event % 8 == 5, "Les fournisseurs ont-ils du retard de livraison ?")
        .when(event % 8 == 6, F.concat(F.lit("sup00"), (user % 10).cast("string"), F.lit(" est-il fiable ?")))
        .when(F.col("event_type") == "error", "  ")
        .otherwise("Bonjour")
        .alias("text"),
    )
    said = table(spark, folder, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("question_id"),
        "text",
    )
    return asked.unionByName(said)
