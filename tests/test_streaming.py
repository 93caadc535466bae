from pyspark.sql import functions as F

from punctual.operators import silver
from punctual.operators.kpis import otif_enriched
from punctual.operators.scoring import predict_batch
from punctual.plans.catalog import fixed_scorer
from punctual.sources import lake
from punctual.streaming import orders as stream
from rows import frame, order, part


def test_load_once_over_restarts(spark, tmp_path):
    landing, bronze, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "checkpoint"))
    base = frame(spark, "purchase_orders", order("OLD"))
    base.write.parquet(f"{bronze}/purchase_orders")

    def arrive(*ids):
        rows = [order(i, receipt_date=None) for i in ids]
        frame(spark, "purchase_orders", *rows).write.mode("append").parquet(landing)

    def load():
        stream.ingest_open_orders(
            stream.read_orders(spark, landing, base.schema, files_per_batch=1), bronze, checkpoint
        ).awaitTermination()
        return sorted(r["po_id"] for r in lake.read_bronze(spark, bronze, "purchase_orders").collect())

    arrive("A", "B", "A")
    assert load() == ["A", "B", "OLD"]
    arrive("B", "C")  # a new run goes on from the checkpoint and still knows B
    assert load() == ["A", "B", "C", "OLD"]
    assert load() == ["A", "B", "C", "OLD"]


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    raw = frame(spark, "purchase_orders", *[
        order(f"P{i}", ordered_qty=float(i), receipt_date=None if i % 2 else "2024-01-09", part_id="AZ"[i % 3 == 0])
        for i in range(40)])
    raw.write.parquet(landing)
    parts = silver.stg_parts_master(frame(spark, "parts_master", part()))
    scores = stream.score_open_orders(stream.read_orders(spark, landing, raw.schema), parts, fixed_scorer)
    stream.write_scores(scores, out, checkpoint).awaitTermination()
    want = predict_batch(
        otif_enriched(silver.stg_purchase_orders(raw).filter(~F.col("is_delivered")), parts), fixed_scorer)
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
