import datetime
import random

import pytest

from punctual.operators import silver
from punctual.schemas import BRONZE
from rows import frame, order, part


def staged(spark, **changes):
    return silver.stg_purchase_orders(frame(spark, "purchase_orders", order(**changes))).first().asDict()


def test_order_on_promise_and_complete(spark):
    row = staged(spark)
    assert (row["is_delivered"], row["delay_days"], row["is_on_time"], row["is_in_full"], row["is_otif"]) == (
        True, 0, True, True, True)
    assert row["fill_rate"] == 1.0


def test_unparsable_receipt_counts_as_delivered_but_late(spark):
    row = staged(spark, receipt_date="bad")
    assert row["is_delivered"] is True
    assert row["receipt_date"] is None and row["delay_days"] is None
    assert row["is_on_time"] is False and row["is_otif"] is False and row["is_in_full"] is True


def test_open_order_has_no_outcome(spark):
    row = staged(spark, receipt_date=None, received_qty=0.0)
    assert row["is_delivered"] is False
    assert [row[c] for c in ("delay_days", "is_on_time", "is_in_full", "is_otif")] == [None] * 4


def test_missing_promise_is_not_on_time(spark):
    row = staged(spark, promised_date=None)
    assert row["delay_days"] is None and row["is_on_time"] is False and row["is_otif"] is False


@pytest.mark.parametrize("ordered, received, rate", [
    (0.0, 5.0, 1.0), (None, 5.0, 1.0), (-1.0, 5.0, 1.0), (10.0, None, None), (3.0, 2.0, 0.6667), (40.0, 23.0, 0.575)])
def test_fill_rate(spark, ordered, received, rate):
    row = staged(spark, ordered_qty=ordered, received_qty=received)
    assert row["fill_rate"] == rate
    if received is None:
        assert row["is_in_full"] is False


def test_quantities_round_to_even_like_a_bigint_cast(spark):
    row = staged(spark, ordered_qty=2.5, received_qty=3.7)
    assert (row["ordered_qty"], row["received_qty"]) == (2, 4)


def test_dates_parse_leniently_and_ids_are_trimmed(spark):
    row = staged(spark, po_id=" P9 ", order_date="2024-1-5", promised_date="2024-01-05 10:00:00")
    assert row["po_id"] == "P9"
    assert row["order_date"] == row["promised_date"] == datetime.date(2024, 1, 5)


@pytest.mark.parametrize("raw, flag", [(" YES ", True), ("true", True), ("1", True), ("no", False), (None, False)])
def test_repairable(spark, raw, flag):
    df = silver.stg_parts_master(frame(spark, "parts_master", part(is_repairable=raw)))
    assert df.first()["is_repairable"] is flag


def test_deduplicate_keeps_the_smallest_row(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", None, "z"), ("a", 1, "y"), ("b", 5, "q")], "k string, n int, t string")
    rows = {tuple(r) for r in silver.deduplicate(df, "k").collect()}
    assert rows == {("a", None, "z"), ("b", 5, "q")}


def expected(row):
    """The delivery rules in plain Python."""
    def day(text):
        try:
            return datetime.date.fromisoformat(text) if text else None
        except ValueError:
            return None

    promised, received = day(row["promised_date"]), day(row["receipt_date"])
    ordered_qty, received_qty = row["ordered_qty"], row["received_qty"]
    arrived = row["receipt_date"] is not None
    on_time = received is not None and promised is not None and received <= promised
    in_full = ordered_qty is not None and received_qty is not None and received_qty >= ordered_qty
    delay = (received - promised).days if received and promised else None
    return (arrived, delay if arrived else None, on_time if arrived else None,
            in_full if arrived else None, (on_time and in_full) if arrived else None)


def test_random_orders_against_plain_rules(spark):
    pick = random.Random(4)
    days = [None, "bad", ""] + [f"2024-01-{d:02d}" for d in range(1, 20)]
    amounts = [None, 0.0] + [float(i) for i in range(1, 8)]
    rows = [
        order(f"P{i}", promised_date=pick.choice(days), receipt_date=pick.choice(days),
              ordered_qty=pick.choice(amounts), received_qty=pick.choice(amounts))
        for i in range(800)
    ]
    got = {r["po_id"]: tuple(r[c] for c in ("is_delivered", "delay_days", "is_on_time", "is_in_full", "is_otif"))
           for r in silver.stg_purchase_orders(frame(spark, "purchase_orders", *rows)).collect()}
    names = list(BRONZE["purchase_orders"])
    assert got == {r[0]: expected(dict(zip(names, r))) for r in rows}
