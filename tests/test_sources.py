import os

import pytest
from pyspark.sql import functions as F

from punctual.operators import health
from punctual.session import shared_root
from punctual.sources import lake, raw, reports
from rows import frame, order


def write_csv(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text(text)


PARTS = (
    "lead_time_days,part_id,part_family,criticality_class,unit_cost,supplier_id_primary,supplier_risk_class,"
    "is_repairable,shelf_life_days\n27,P1,\"Engine, large\",B,23.5,S1,Low,No,\n31,P2,Cabin,C,6.0,S2,,Yes,90\n"
)


def test_csv_is_read_by_column_name(spark, tmp_path):
    write_csv(tmp_path, "parts_master", PARTS)
    rows = raw.read_raw(spark, str(tmp_path), "parts_master").orderBy("part_id").collect()
    assert tuple(rows[0]) == ("P1", "Engine, large", "B", 23.5, 27, "S1", "Low", "No", None)
    assert rows[1]["supplier_risk_class"] is None and rows[1]["shelf_life_days"] == 90.0


def test_missing_extract(spark, tmp_path):
    write_csv(tmp_path / "raw", "parts_master", PARTS)
    with pytest.raises(raw.MissingSource):
        raw.load_bronze(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"))
    assert not (tmp_path / "bronze").exists()
    manifest = raw.load_bronze(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), on_missing="skip")
    assert [tuple(r)[:3] for r in manifest.collect()] == [("parts_master", 2, 9)]
    assert raw.row_total(manifest).first()["row_count"] == 2
    assert lake.read_bronze(spark, str(tmp_path / "bronze"), "parts_master").count() == 2


def test_wrong_value_stops_the_load(spark, tmp_path):
    write_csv(tmp_path / "raw", "parts_master", PARTS.replace("23.5", "cheap"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        raw.load_bronze(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), on_missing="skip")


def test_open_orders_continue_the_numbering(spark, tmp_path):
    base = frame(spark, "purchase_orders", order("PO000041"), order("PO000007"), order("none"))
    base.write.parquet(str(tmp_path / "purchase_orders"))
    new = frame(spark, "purchase_orders", *[order(None, supplier_id=f"S{i}") for i in range(25)]).repartition(4)
    assert lake.store_open_orders(spark, str(tmp_path), new, "monday")
    # A repeated run adds nothing, a run of its own goes on.
    assert not lake.store_open_orders(spark, str(tmp_path), new, "monday")
    rows = lake.read_bronze(spark, str(tmp_path), "purchase_orders").filter("receipt_date is null").collect()
    assert sorted(r["po_id"] for r in rows) == [f"PO{i:06d}" for i in range(42, 67)]
    assert len({r["supplier_id"] for r in rows}) == 25
    assert lake.store_open_orders(spark, str(tmp_path), new.limit(2), "tuesday")
    after = lake.read_bronze(spark, str(tmp_path), "purchase_orders")
    assert after.count() == 30 and {"PO000067", "PO000068"} < {r.po_id for r in after.collect()}


def test_runs_at_a_time_never_share_numbers(spark, tmp_path):
    base = frame(spark, "purchase_orders", order("PO000010"))
    lake.write_bronze(base, str(tmp_path / "purchase_orders"), "purchase_orders")
    # Another run has taken 11 to 15 and has not stored its rows yet.
    assert lake._take_numbers(spark, str(tmp_path), base, 5) == 10
    lake.store_open_orders(spark, str(tmp_path), frame(spark, "purchase_orders", order(None)), "own")
    assert {r.po_id for r in lake.read_bronze(spark, str(tmp_path), "purchase_orders").collect()} == {"PO000010", "PO000016"}
    assert lake._take_numbers(spark, str(tmp_path), base, 1) == 16


def test_a_broken_append_goes_on_with_its_numbers(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    lake.write_bronze(frame(spark, "purchase_orders", order("PO000010")), f"{root}/purchase_orders", "purchase_orders")
    new = frame(spark, "purchase_orders", *[order(None, supplier_id=f"S{i}") for i in range(6)])
    merge = lake.merge_rows

    def breaks(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(lake, "merge_rows", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        lake.store_open_orders(spark, root, new, "key")
    monkeypatch.setattr(lake, "merge_rows", merge)
    assert lake.store_open_orders(spark, root, new.orderBy(F.desc("supplier_id")).repartition(3), "key")
    rows = lake.read_bronze(spark, root, "purchase_orders").collect()
    assert sorted(r.po_id for r in rows) == [f"PO{i:06d}" for i in range(10, 17)]
    assert len({r.supplier_id for r in rows if r.po_id != "PO000010"}) == 6


def test_numbering_starts_at_one(spark):
    base = frame(spark, "purchase_orders", order()).filter("1 = 0")
    got = lake.append_open_orders(base, frame(spark, "purchase_orders", order(None), order(None)))
    assert sorted(r["po_id"] for r in got.collect()) == ["PO000001", "PO000002"]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tuple(reports.call_stats(reports.read_log(spark, path)).first()) == (0, 0.0, 0)
    call = spark.createDataFrame([("p", "r", 10.25, 7, ["a", "b"])],
                                 "prompt string, response string, latency_ms double, tokens_used int, docs array<string>")
    reports.log_calls(call, path)
    reports.log_calls(call.withColumn("latency_ms", F.lit(20.0)), path)
    log = reports.read_log(spark, path)
    assert {r["docs_retrieved"] for r in log.collect()} == {2} and log.filter("ts < 1e9").isEmpty()
    assert tuple(reports.call_stats(log).first()) == (2, 15.1, 14)


def test_health(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS health_db")
    lake.write_gold(spark.range(3), "full", "health_db")
    lake.write_gold(spark.range(0), "empty", "health_db")
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "part").write_text("x")
    checks = health.health_checks(
        spark, ["health_db.full", "health_db.empty", "health_db.none"],
        {"model": str(tmp_path / "model"), "index": str(tmp_path / "nothing")})
    assert {r["check"]: r["ok"] for r in checks.collect()} == {
        "health_db.full": True, "health_db.empty": False, "health_db.none": False, "model": True, "index": False}
    report = health.pipeline_health(
        checks, reports.load_drift_report(spark, str(tmp_path / "d")), reports.read_log(spark, str(tmp_path / "l")))
    row = report.first()
    assert row["healthy"] is False and row["drift"]["status"] == "not_measured" and row["rag"]["total_calls"] == 0


def test_csv_dialect(spark, tmp_path):
    write_csv(tmp_path, "quality_incidents", (
        "incident_id,incident_date,part_id,supplier_id,site_id,defect_severity,defect_type,scrap_qty\n"
        'Q1,2024-01-02,"6"" tube, bent",S1,X,Minor,"two\nlines",10.0\n'
        "Q2,2024-01-03,P,S1,X,Minor,plain,9007199254740993\nQ3,2024-01-03,P,S1,X,Minor,plain,\n"
    ))
    rows = {r.incident_id: r for r in raw.read_raw(spark, str(tmp_path), "quality_incidents", multiLine=True).collect()}
    assert len(rows) == 3
    assert (rows["Q1"].part_id, rows["Q1"].defect_type, rows["Q1"].scrap_qty) == ('6" tube, bent', "two\nlines", 10)
    assert rows["Q2"].scrap_qty == 9007199254740993 and rows["Q3"].scrap_qty is None
    write_csv(tmp_path / "bad", "quality_incidents", "incident_id,incident_date,part_id,supplier_id,site_id,"
              "defect_severity,defect_type,scrap_qty\nQ1,2024-01-02,P,S,X,M,t,10.5\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        raw.read_raw(spark, str(tmp_path / "bad"), "quality_incidents").collect()


def test_bronze_has_every_order_once(spark, tmp_path):
    base = frame(spark, "purchase_orders", order("A", receipt_date=None), order("B"), order("C", receipt_date=None))
    live = frame(spark, "purchase_orders", order("A"), order("B", receipt_date=None), order("D", receipt_date=None),
                 order("D"), order("C", receipt_date=None, ordered_qty=7.0), order(None))
    base.write.parquet(str(tmp_path / "purchase_orders"))  # not in buckets yet
    for _ in range(2):  # a repeated merge changes nothing but rows without an id
        lake.merge_rows(spark, str(tmp_path), "purchase_orders", live.filter("po_id is not null"), "again")
    lake.merge_rows(spark, str(tmp_path), "purchase_orders", live.filter("po_id is null"), "last")
    found = lake.read_bronze(spark, str(tmp_path), "purchase_orders")
    rows = {r.po_id: r for r in found.collect()}
    assert found.columns == base.columns and found.count() == 5
    assert sorted(rows, key=str) == ["A", "B", "C", "D", None]
    assert rows["A"].receipt_date and rows["B"].receipt_date and rows["D"].receipt_date
    assert rows["C"].receipt_date is None and rows["C"].ordered_qty == 7.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_merge_begins_a_table(spark, tmp_path):
    lake.merge_rows(spark, str(tmp_path), "purchase_orders", frame(spark, "purchase_orders", order("A")), "1")
    assert [r.po_id for r in lake.read_bronze(spark, str(tmp_path), "purchase_orders").collect()] == ["A"]


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_merge_writes_only_touched_buckets(spark, tmp_path):
    path = tmp_path / "purchase_orders"
    lake.write_bronze(frame(spark, "purchase_orders", *[order(f"P{i}") for i in range(200)]), str(path), "purchase_orders", 16)
    before = files(path)
    lake.merge_rows(spark, str(tmp_path), "purchase_orders", frame(spark, "purchase_orders", order("P7", ordered_qty=3.0)), "1")
    after = files(path)
    touched = {p.name for p in path.glob("__bucket=*") if not files(p).items() <= before.items()}
    assert len(touched) == 1 and len(before.items() & after.items()) >= len(before) * 14 // 16
    rows = {r.po_id: r for r in lake.read_bronze(spark, str(tmp_path), "purchase_orders").collect()}
    assert len(rows) == 200 and rows["P7"].ordered_qty == 3.0


def test_a_broken_merge_is_taken_up(spark, tmp_path, monkeypatch):
    lake.write_bronze(frame(spark, "purchase_orders", order("A"), order("B")), str(tmp_path / "purchase_orders"), "purchase_orders", 1)
    live = frame(spark, "purchase_orders", order("A", ordered_qty=5.0))
    removed = lake.remove
    monkeypatch.setattr(lake, "remove", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        lake.merge_rows(spark, str(tmp_path), "purchase_orders", live, "1")
    monkeypatch.setattr(lake, "remove", removed)
    # The bucket is lost between both steps: what lies beside the table brings it back.
    lake.remove(spark, str(tmp_path / "purchase_orders" / "__bucket=0"))
    lake.merge_rows(spark, str(tmp_path), "purchase_orders", live, "1")
    rows = {r.po_id: r.ordered_qty for r in lake.read_bronze(spark, str(tmp_path), "purchase_orders").collect()}
    assert rows["A"] == 5.0 and set(rows) == {"A", "B"}


def test_a_failed_load_leaves_all_tables(spark, tmp_path):
    folder, bronze = tmp_path / "raw", tmp_path / "bronze"
    incidents = "incident_id,incident_date,part_id,supplier_id,site_id,defect_severity,defect_type,scrap_qty\nQ1,2024-01-02,P,S,X,M,t,{}\n"
    write_csv(folder, "parts_master", PARTS)
    write_csv(folder, "quality_incidents", incidents.format(1))
    raw.load_bronze(spark, str(folder), str(bronze), on_missing="skip")
    before = files(bronze)
    write_csv(folder, "parts_master", PARTS.replace("P1", "P9"))
    write_csv(folder, "quality_incidents", incidents.format("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        raw.load_bronze(spark, str(folder), str(bronze), on_missing="skip")
    assert files(bronze) == before and not list(bronze.glob("_loading*"))
    write_csv(folder, "quality_incidents", incidents.format(2))
    raw.load_bronze(spark, str(folder), str(bronze), on_missing="skip")
    assert {r.part_id for r in lake.read_bronze(spark, str(bronze), "parts_master").collect()} == {"P9", "P2"}


def test_swap_is_all_or_nothing(spark, tmp_path):
    for name in ("one", "two", "new/one"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "file").write_text(name)
    with pytest.raises(Exception):
        lake.swap(spark, [(str(tmp_path / "new/one"), str(tmp_path / "one")), (str(tmp_path / "new/two"), str(tmp_path / "two"))])
    assert (tmp_path / "one/file").read_text() == "one" and (tmp_path / "two/file").read_text() == "two"


def test_a_large_file_is_read_in_splits(spark, tmp_path):
    lines = PARTS.splitlines()
    write_csv(tmp_path, "parts_master", "\n".join([lines[0], *[lines[2].replace("P2", f"P{i}") for i in range(20_000)]]))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100k")
    try:
        assert raw.read_raw(spark, str(tmp_path), "parts_master").rdd.getNumPartitions() > 4
        assert raw.read_raw(spark, str(tmp_path), "parts_master", multiLine=True).rdd.getNumPartitions() == 1
        manifest = raw.load_bronze(spark, str(tmp_path), str(tmp_path / "b"), ["parts_master"], options={"parts_master": {"multiLine": True}})
        assert manifest.first()["n_rows"] == 20_000
    finally:
        spark.conf.set(size, before)


def test_a_merge_shuffles_once_and_leaves_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "purchase_orders"), [order("A"), order("A"), order("B"), order(None), order("E", receipt_date=None)]
    lake.write_bronze(frame(spark, "purchase_orders", *rows), path, "purchase_orders", 4)
    before = set(os.listdir(shared_root(spark)))
    live = frame(spark, "purchase_orders", order("B", ordered_qty=3.0), order("B", ordered_qty=4.0, receipt_date=None), order(None), order("E"))
    lake.merge_rows(spark, str(tmp_path), "purchase_orders", live, "1")
    # Ids that do not arrive again keep all their rows, as those without an id do.
    found = lake.read_bronze(spark, str(tmp_path), "purchase_orders").collect()
    assert sorted((r.po_id or "", r.ordered_qty, r.receipt_date) for r in found) == [
        ("", 10.0, "2024-01-10"), ("", 10.0, "2024-01-10"), ("A", 10.0, "2024-01-10"), ("A", 10.0, "2024-01-10"),
        ("B", 3.0, "2024-01-10"), ("E", 10.0, "2024-01-10")]
    assert not {name for name in set(os.listdir(shared_root(spark))) - before if name.startswith("arrived")}
    table = spark.read.parquet(path)
    plan = lake.newest(table, table.filter("po_id = 'B'"), "purchase_orders")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
