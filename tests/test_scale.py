"""Building blocks for skewed and large inputs, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from punctual.functions import joins
from punctual.functions.running import totals_before, with_sequence
from punctual.operators.features import split_exact


def skewed(spark, n=3000):
    """One key holds a third of the rows, another part of the rows has no key."""
    pick = random.Random(1)
    keys = ["hot"] * (n // 3) + [None] * (n // 10)
    keys += [f"k{pick.randrange(200)}" for _ in range(n - len(keys))]
    return spark.createDataFrame(list(enumerate(keys)), "id int, k string")


def lookup(spark):
    return spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(150)], "k string, v double")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_plain_join(spark, no_broadcast, how):
    left, right = skewed(spark), lookup(spark)
    joined = joins.lookup_join(left, right, "k", how)
    assert "__piece" in joined._jdf.queryExecution().optimizedPlan().toString()
    want = Counter(map(tuple, left.join(right, "k", how).collect()))
    assert Counter(map(tuple, joined.collect())) == want


def test_hot_key_is_cut_into_pieces(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the eight partitions apart
    try:
        plan = joins.lookup_join(skewed(spark), lookup(spark), "k")
        sizes = [len(p) for p in plan.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and sum(sizes) == 3000 and max(sizes) < 1000


def test_small_tables_are_broadcast(spark):
    plan = joins.lookup_join(skewed(spark), lookup(spark), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_table_behind_a_join_is_measured(spark, tmp_path):
    lookup(spark).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    right = stored.join(stored.select("k", F.length("k").alias("n")).hint("merge"), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        assert joins.estimated_bytes(right) > 20000 >= joins.measured_bytes(right)
        joined = joins.lookup_join(skewed(spark), right, "k")
        assert "__piece" not in joined._jdf.queryExecution().optimizedPlan().toString()
        # From large tables it is not: measuring would cost a pass over them.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
        joined = joins.lookup_join(skewed(spark), right, "k")
        assert "__piece" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_pick_rows(spark, how):
    table = lookup(spark).crossJoin(spark.range(1)).drop("id")
    keys = spark.createDataFrame([("k1",), ("nope",), ("k1",)], "k string")
    got = Counter(map(tuple, joins.pick_rows(keys, table, "k", how).collect()))
    want = Counter({("k1", 1.0): 2})
    if how == "left":
        want[("nope", None)] = 1
    assert got == want


def test_running_totals(spark):
    pick = random.Random(2)
    rows = [(g, float(v), pick.randrange(9)) for g in ("a", "b") for v in pick.sample(range(10000), 500)]
    got = totals_before(spark.createDataFrame(rows, "g string, v double, n int"), "g", "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_before"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"])
        assert r["n_total"] == sum(n for g, v, n in rows if g == r["g"])


def test_sequence_has_no_gap(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    numbered = with_sequence(df, "n").collect()
    assert sorted(r["n"] for r in numbered) == list(range(1, 335))


def test_exact_split(spark):
    df = spark.range(5003).select(
        F.col("id").cast("string").alias("po_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    first, second = (split_exact(df).cache() for _ in range(2))
    counts = {(r["label"], r["is_test"]): r["count"] for r in first.groupBy("label", "is_test").count().collect()}
    assert counts == {(1, True): 334, (1, False): 1334, (0, True): 667, (0, False): 2668}
    assert first.exceptAll(second).isEmpty()


def test_keys_alone_are_looked_up_once(spark, no_broadcast):
    keys = ["hot"] * 2000 + [None] * 500 + [f"k{i}" for i in range(500)] + ["absent"]
    left = spark.createDataFrame([(k,) for k in keys], "k string")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 500, 2)]], "k string, v int")
    for how in ("left", "inner"):
        got = joins.lookup_join(left, right, "k", how)
        want = left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = joins.lookup_join(left, right, "k")._jdf.queryExecution().optimizedPlan().toString()
    # The keys are counted below the join and repeated above it.
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")


def test_a_class_without_a_cut_keeps_its_rows(spark):
    rows = [(f"a{i}", 1) for i in range(2)] + [(f"b{i}", 0) for i in range(10)] + [("n", None)]
    df = spark.createDataFrame(rows, "po_id string, label int")
    got = split_exact(df, test_share=0.8).collect()
    assert len(got) == 13
    assert sum(r.is_test for r in got if r.label == 1) == 2
    assert sum(r.is_test for r in got if r.label == 0) == 8


def test_a_chain_reads_its_base_once_more(spark, no_broadcast):
    """Three lookups, one by a key that another brings in: the same rows as plain joins, with a
    hot key in each, from two passes over the base."""
    n, seen = 4000, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = spark.range(0, n, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 500).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.concat(F.lit("y"), F.col("id") % 300)).alias("b"), "id",
    ).mapInArrow(counted, "a bigint, b string, id bigint")
    first = spark.range(400).select(F.col("id").alias("a"), F.when(F.col("id") < 200, F.lit(7)).otherwise(F.col("id")).alias("c"))
    second = spark.range(300).select(F.concat(F.lit("y"), "id").alias("b"), F.col("id").alias("d")).union(spark.sql("select 'x', -1L"))
    third = spark.range(390).select(F.col("id").alias("c"), (F.col("id") * 2).alias("e"))
    steps = [(first, "a", "inner"), (third, "c", "left"), (second, "b", "left")]
    joined = joins.lookup_chain(base, steps)
    assert seen.value == n
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__piece") > 3
    got = Counter(map(tuple, joined.select("id", "a", "b", "c", "d", "e").collect()))
    assert seen.value == 2 * n
    want = base.join(first, "a").join(third, "c", "left").join(second, "b", "left")
    assert got == Counter(map(tuple, want.select("id", "a", "b", "c", "d", "e").collect()))


def test_a_chain_of_small_tables_is_broadcast(spark):
    joined = joins.lookup_chain(skewed(spark), [(lookup(spark), "k", "left"), (lookup(spark).withColumnRenamed("v", "w"), "k", "inner")])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and set(joined.columns) == {"id", "k", "v", "w"}


def test_hot_keys_come_from_a_sketch(spark, no_broadcast):
    """Keys are not shuffled to be counted; a table without hot keys is joined as it is."""
    assert dict(joins._hot_keys(skewed(spark, 30000), ["k"])["k"]) == {"hot": 11}
    assert set(dict(joins._hot_keys(skewed(spark, 30000).withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k"))), ["k"])["k"])) == {None}
    even = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("k"), "id", F.lit("wide").alias("w"))
    joined = joins.lookup_join(even, lookup(spark), "k")
    assert "__piece" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 5000 and joined.filter("v is not null").count() == 1500


def test_a_joined_table_is_not_joined_twice(spark, no_broadcast):
    """Counting the keys of a join's result would run the join; hot keys are split as it runs."""
    jobs = spark.sparkContext.statusTracker()
    left = skewed(spark).join(lookup(spark).withColumnRenamed("v", "w"), "k", "left").withColumn("key", F.col("k"))
    spark.sparkContext.setJobGroup("joined", "joined")
    joined = joins.lookup_join(left, lookup(spark).withColumnRenamed("k", "key"), "key")
    assert not jobs.getJobIdsForGroup("joined")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.count() == 3000 and joined.filter("v is not null").count() == left.filter("w is not null").count()
