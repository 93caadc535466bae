"""Model inputs from the order mart."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.functions.ranges import order_statistics
from punctual.functions.scalars import category_code
from punctual.schemas import AFTER_DELIVERY, CATEGORIES, FEATURES, SEED, TARGET, TEST_SHARE


def build_features(df: DataFrame, require_target: bool = True) -> DataFrame:
    """Add category codes, make flags numeric and fill empty features with zero.

    All other columns stay. Rows without an outcome are dropped only when the
    target is required: open orders are scored too.
    """
    codes = {
        code: category_code(F.col(name)) if name in df.columns else F.lit(0).cast("bigint")
        for name, code in CATEGORIES.items()
    }
    out = df.withColumns(codes)
    if "is_repairable" in df.columns:
        out = out.withColumn("is_repairable", F.col("is_repairable").cast("int"))
    out = out.fillna(0, [name for name in FEATURES if name in out.columns])
    if require_target and TARGET in df.columns:
        out = out.filter(F.col(TARGET).isNotNull())
    return out


def feature_matrix(df: DataFrame, *keep: str) -> DataFrame:
    """The nine features in fixed order plus an integer label; absent features are zero."""
    leaked = AFTER_DELIVERY.intersection(FEATURES)
    if leaked:
        raise ValueError(f"known only after delivery: {sorted(leaked)}")
    columns = [F.col(f) if f in df.columns else F.lit(0).alias(f) for f in FEATURES]
    label = [F.col(TARGET).cast("int").alias("label")] if TARGET in df.columns else []
    return df.select(*keep, *columns, *label)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def class_distribution(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def describe_features(matrix: DataFrame) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per feature.

    Moments of all features come from one pass over the rows as they are. Quartiles interpolate
    between neighbours, which are selected by counting in value ranges.
    """
    numbers = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = matrix.agg(*[
        F.struct(F.lit(f).alias("feature"), *[
            measure(F.col(f).cast("double")).alias(name) for name, measure in numbers.items()
        ]).alias(f)
        for f in FEATURES
    ])
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = order_statistics(matrix, list(shares.values()), FEATURES)
    rows = matrix.sparkSession.createDataFrame(
        [(f, *quartiles[f]) for f in FEATURES], "feature string, " + ", ".join(f"{name} double" for name in shares)
    )
    return wide.select(F.inline(F.array(*FEATURES))).join(F.broadcast(rows), "feature").select(
        "feature", "count", "mean", "stddev", "min", *shares, "max"
    )


# --- split ------------------------------------------------------------------

# Bits of the order hash, and how many of them number the ranges of the exact
# split: 65,536, so the range that gets numbered is a small part of any table.
HASH_BITS, RANGE_BITS = 60, 16


def _shuffled(key: str) -> Column:
    """Hash of the key that any engine can repeat: 15 hex digits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.col(key), F.lit(f"#{SEED}")), 256), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def split(df: DataFrame, key: str = "po_id", test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by a hash of the key: reproducible, without a shuffle.

    Every class is cut at the same share up to chance.
    """
    in_test = F.pmod(_shuffled(key), F.lit(1000)) < int(round(test_share * 1000))
    return df.filter(~in_test), df.filter(in_test)


def split_exact(
    df: DataFrame, label: str = "label", key: str = "po_id", test_share: float = TEST_SHARE
) -> DataFrame:
    """Add is_test so that each class gives exactly round(share x its rows) test rows;
    the share lies below 1.

    Rows are ordered by hash within their class. The hash ranges that lie wholly
    on one side of the cut need only their counts; rows are numbered only in the
    one range per class the cut falls into, to find the last test row. ``key`` must be unique.
    """
    # The top bits of the hash number its range.
    placed = df.withColumn("__hash", _shuffled(key)).withColumn(
        "__range", F.shiftright("__hash", HASH_BITS - RANGE_BITS)
    )
    counts = placed.groupBy(label, "__range").agg(F.count(F.lit(1)).alias("__n"))
    of_class = Window.partitionBy(label)
    before = of_class.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2^bits rows per class, of which the one with the cut is kept.
    cut = counts.select(
        label, F.col("__range").alias("__cut"), "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.round(F.sum("__n").over(of_class) * F.lit(float(test_share))).cast("bigint").alias("__want"),
    ).filter("__before <= __want and __want < __before + __n").drop("__n")
    cut = cut.withColumnRenamed(label, "__label")
    same_label = F.col(label).eqNullSafe(F.col("__label"))
    # The last test row of each class, from the rows of its cut's range alone.
    order = Window.partitionBy("__label").orderBy("__hash", key)
    last = (
        placed.join(F.broadcast(cut), same_label).filter("__range = __cut")
        .withColumn("__place", F.col("__before") + F.row_number().over(order)).filter("__place = __want")
        .select(F.col("__label").alias("__of"), F.struct("__hash", F.col(key).alias("__key")).alias("__last"))
    )
    # One row per class.
    cut = cut.join(last, F.col("__label").eqNullSafe(F.col("__of")), "left").drop("__of")
    here = F.struct("__hash", F.col(key).alias("__key"))
    is_test = (
        F.when(F.col("__cut").isNull(), True)  # as many test rows as rows
        .when(F.col("__range") == F.col("__cut"), F.coalesce(here <= F.col("__last"), F.lit(False)))
        .otherwise(F.col("__range") < F.col("__cut"))
    )
    return placed.join(F.broadcast(cut), same_label, "left").withColumn("is_test", is_test).select(*df.columns, "is_test")
