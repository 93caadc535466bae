from pyspark.sql import functions as F

from punctual.operators import kpis, quality, ranking, silver
from punctual.plans import batch, catalog
from punctual.sources import lake
from rows import frame, incident, marts, order, part

SF = "/root/testdata/sf0.001"


def test_unmatched_part_keeps_the_order(spark):
    mart, _ = marts(spark, [order(part_id=" A "), order("P2", part_id="Z")])
    rows = {r["po_id"]: r for r in mart.collect()}
    assert rows["P1"]["total_order_cost"] == 25.0 and rows["P1"]["standard_lead_time_days"] == 7
    assert rows["P1"]["lead_time_variance_days"] == 2
    assert rows["P2"]["unit_cost"] is None and rows["P2"]["otif_score"] == 1.0


def test_supplier_without_delivery_or_incident(spark):
    _, kpi = marts(spark, [order(), order("P2", supplier_id="S2", receipt_date=None)])
    rows = {r["supplier_id"]: r.asDict() for r in kpi.collect()}
    s2 = rows["S2"]
    assert s2["otif_rate"] is None and s2["avg_delay_days"] is None and s2["pending_orders"] == 1
    assert (s2["total_incidents"], s2["critical_incidents"], s2["total_scrap_qty"]) == (0, 0, 0)
    assert (rows["S1"]["total_incidents"], rows["S1"]["total_scrap_qty"]) == (1, 3)
    assert [r["supplier_id"] for r in ranking.supplier_ranking(kpi).collect()] == ["S1", "S2"]
    assert [(r["rank"], r["supplier_id"]) for r in ranking.weakest_table(kpi).collect()] == [(1, "S2"), (2, "S1")]


def test_null_family_is_its_own_segment(spark):
    mart, _ = marts(spark, [order(), order("P2", part_id="Z")])
    family = kpis.otif_summary(mart).filter("segment_type = 'part_family'").collect()
    assert {r["segment_value"] for r in family} == {None, "Engine"}


def test_one_pass_summary_equals_three_aggregates(spark):
    mart = catalog.mart(spark, SF)
    three = None
    for segment in kpis.SEGMENTS:
        part_ = kpis.otif_by(mart, segment)
        three = part_ if three is None else three.unionByName(part_)
    key = lambda r: (r[0], str(r[1]))
    assert sorted(map(tuple, kpis.otif_summary(mart).collect()), key=key) == sorted(map(tuple, three.collect()), key=key)


def test_empty_mart_gives_zero_kpis(spark):
    mart, _ = marts(spark, [order(receipt_date=None)])
    assert tuple(kpis.global_kpi(mart).first()) == (0.0, 0.0, 0.0, 0)


def test_invariants(spark):
    mart = catalog.mart(spark, SF)
    assert mart.filter("is_otif and not (is_on_time and is_in_full)").isEmpty()
    kpi = catalog.kpi(spark, SF)
    assert kpi.filter("delivered_orders + pending_orders <> total_orders").isEmpty()
    rates = ["on_time_rate", "in_full_rate", "otif_rate"]
    assert kpi.filter(" or ".join(f"{c} not between 0 and 1" for c in rates)).isEmpty()


def test_diagnostic_thresholds(spark):
    rows = [("a", 0.04, 0.0, 0, 0), ("b", 0.5, 0.0, 9, 2), ("c", 0.5, 5.0, 0, 0), ("d", 0.5, 3.0, 3, 0),
            ("e", 0.5, 3.1, 3, 0), ("f", None, None, None, None)]
    kpi = spark.createDataFrame(
        rows, "supplier_id string, otif_rate double, avg_delay_days double, total_incidents int, critical_incidents int")
    trend = {r["supplier_id"]: r["trend"] for r in ranking.supplier_diagnostic(kpi).collect()}
    assert trend == {"a": ranking.TREND_DOWN, "b": ranking.TREND_DOWN, "c": ranking.TREND_DOWN,
                     "d": ranking.TREND_UP, "e": ranking.TREND_FLAT, "f": ranking.TREND_DOWN}


def test_seeded_violations_are_found(spark):
    mart, kpi = marts(spark, [order(), order(), order("P2", part_id="Z"), order("P3", promised_date=None)])
    kpi = kpi.withColumn("otif_rate", F.lit(1.2))
    parts = spark.createDataFrame([("A",)], "part_id string")
    checks = quality.run_checks(mart, kpi, mart.select("supplier_id"), parts)
    failed = {(r["test"], r["column"]): r["n_fail"] for r in checks.collect() if r["status"] == "fail"}
    assert failed == {("unique", "po_id"): 1, ("relationships", "part_id"): 1,
                      ("not_null", "promised_date"): 1, ("between", "otif_rate"): 1}
    try:
        quality.enforce(checks)
        raise AssertionError("the gate let a failure pass")
    except quality.QualityGateError as error:
        assert "po_id unique: 1" in str(error)


def test_orders_by_id(spark):
    mart, _ = marts(spark, [order(), order("P2"), order("P3")])
    assert {r["po_id"] for r in kpis.orders_by_id(mart, "P1", "P3", "PX").collect()} == {"P1", "P3"}


def test_the_stored_mart_is_written_in_steps(spark, tmp_path, no_broadcast):
    """The joins' shuffles are gone before the rows are dealt out, nothing that follows from other columns
    is shuffled, and the stored rows are those of the plain join."""
    raw = [order(f"P{i}", part_id="AZ"[i % 3 == 0], receipt_date=None if i % 4 == 0 else f"2024-0{1 + i % 9}-1{i % 8}",
                 order_date=None if i == 7 else f"2024-0{1 + i % 5}-01", received_qty=float(8 + i % 3)) for i in range(60)]
    # A receipt that cannot be read counts as delivered.
    raw += [order("P90", receipt_date="soon"), order(None), order("P5"), order("P91", ordered_qty=None, received_qty=None)]
    views = {
        "stg_purchase_orders": silver.stg_purchase_orders(frame(spark, "purchase_orders", *raw)),
        "stg_parts_master": silver.stg_parts_master(frame(spark, "parts_master", part())),
        "stg_quality_incidents": silver.stg_quality_incidents(frame(spark, "quality_incidents", incident())),
    }
    freed, dealt = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, write_gold = spark.conf.get(freed), lake.write_gold
    lake.write_gold = lambda df, *a, **b: (dealt.append((df, spark.conf.get(freed))), write_gold(df, *a, **b))[1]
    try:
        batch.build_gold(spark, views, "gold_in_steps", str(tmp_path / "gold"))
    finally:
        lake.write_gold = write_gold
    assert spark.conf.get(freed) == before and {kept for _, kept in dealt} == {"true"}
    plan = dealt[0][0]._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()
    moved = next(line for line in plan.toString().splitlines() if "RepartitionByExpression" in line)
    below = plan.toString().split(moved)[1]
    assert not any(name in below for name in (*silver.OUTCOME, "total_order_cost", "otif_score", "order_month"))
    want = kpis.otif_enriched(views["stg_purchase_orders"], views["stg_parts_master"])
    got = batch.read_orders(spark, "gold_in_steps")
    assert got.columns == want.columns and got.count() == len(raw)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    spark.sql("DROP DATABASE gold_in_steps CASCADE")
