from datetime import date
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from punctual.operators.quality import QualityGateError
from punctual.plans import batch
from punctual.plans.catalog import RAW
from punctual.sources import lake

SF = "/root/testdata/sf0.001"


def write_extracts(spark, folder, keep_orphans):
    for name, table in RAW.items():
        df = table(spark, SF)
        if name == "purchase_orders" and not keep_orphans:
            df = df.filter("cast(part_id as int) % 50 <> 0")
        df.write.option("header", True).csv(f"{folder}/{name}.csv")


def test_whole_run(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_extracts(spark, raw, keep_orphans=False)
    result = batch.run(spark, raw, out, database="gold_run", maxIter=2)
    assert result.manifest.count() == 4
    assert result.checks.filter("status = 'fail'").isEmpty() and result.checks.count() == 13
    assert result.metrics.first()["test_size"] > 0 and "baseline_otif_rate" in result.metrics.columns
    assert spark.read.json(f"{out}/reports/classification").count() == 5
    health = result.health.first()
    assert health["healthy"] is True and len(health["checks"]) == 6 and health["rag"]["total_calls"] == 0
    assert result.drift.first()["status"] == "measured"
    mart = batch.read_orders(spark, "gold_run")
    assert mart.filter("not is_delivered").count() + mart.filter("is_delivered").count() == mart.count()
    plan = mart.filter("is_delivered")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_delivered" in plan
    whole = lake.read_gold(spark, "marts_otif_kpi", "gold_run")
    # A span of dates reads its months alone.
    some = batch.orders_between(spark, date(1995, 3, 10), date(1995, 4, 20), "gold_run")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "order_month" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    names = {f.split("order_month=")[1][:7] for f in whole.inputFiles()}
    read = {f.split("order_month=")[1][:7] for f in some.select("po_id", F.input_file_name().alias("f")).toPandas()["f"]}
    assert read == {"1995-03", "1995-04"} < names
    want = mart.filter("order_date between '1995-03-10' and '1995-04-20'")
    assert some.count() == want.count() > 0 and some.exceptAll(want).isEmpty()
    # Files are sorted by id, so few of them can hold a key.
    files = [pq.ParquetFile(p) for p in Path(urlparse(whole.inputFiles()[0]).path).parents[2].rglob("*.parquet")]
    spans = []
    for file in files:
        at = file.schema_arrow.names.index("po_id")
        own = [file.metadata.row_group(i).column(at).statistics for i in range(file.num_row_groups)]
        spans += [(s.min, s.max) for s in own]
        ids = file.read(["po_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
    key = mart.first().po_id
    assert sum(a <= key <= b for a, b in spans) < len(spans) / 2
    for name in ("marts_otif_summary", "marts_supplier_kpi", "supplier_documents", "supplier_vectors"):
        assert not lake.read_gold(spark, name, "gold_run").isEmpty()


def test_failed_test_stops_the_run(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_extracts(spark, raw, keep_orphans=True)
    with pytest.raises(QualityGateError, match="part_id relationships"):
        batch.run(spark, raw, out, database="gold_stopped")
    assert not (tmp_path / "lake" / "model").exists()
