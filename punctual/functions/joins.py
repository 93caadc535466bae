"""Lookup joins that hold when the looked-up table is large and keys are skewed."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from punctual.session import stored

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20,
          "g": 2**30, "gb": 2**30}


def broadcast_limit(df: DataFrame) -> int:
    """Spark's own broadcast threshold in bytes (negative when switched off)."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-zA-Z]*)", text.strip()).groups()
    return int(number) * _UNITS[unit.lower()]


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimizer expects for the DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """Size of all tables the DataFrame is computed from, leaving out rows handed over
    by the driver, for which Spark has only its default."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    return sum(size for size in sizes if size < unknown)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows themselves, counted by one pass: text as it is, the rest at 8 bytes."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if not isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            text = F.col(f"`{field.name}`")
            if not isinstance(field.dataType, T.StringType):
                text = F.to_json(F.struct(text))
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).cast("bigint")).first()[0]


def lookup_join(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Equi-join a large table with a table of attributes (``how``: left or inner).

    A table the optimizer sees below the broadcast threshold is broadcast by
    Spark. The optimizer multiplies sizes at joins, so a right side that looks
    larger but comes from small tables is measured before it is given up. With a
    broadcast the large side is not shuffled and skew cannot arise. Otherwise the join is
    shuffled; a key of the left side that would fill more than two shuffle
    partitions is cut into pieces and its right rows are repeated per piece.
    A stream's left side is one micro-batch, whose size the reader bounds.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join does not support {how!r}")
    small = _if_small(right, broadcast_limit(left))
    if small is not None or left.isStreaming:
        return left.join(right if small is None else small, on, how)
    return _split_join(left, right, on, how)


def _if_small(right: DataFrame, limit: int) -> DataFrame | None:
    """The table as it is to be joined if it can be broadcast, else None."""
    if estimated_bytes(right) <= limit:
        return right
    if source_bytes(right) <= limit and measured_bytes(right) <= limit:
        return F.broadcast(right)
    return None


def lookup_chain(base: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``lookup_join`` of one table with several: ``(right, on, how)`` each, in order.

    Frequent keys have to be known before a join is split; those of the base come from one pass
    over its keys (``_hot_keys``). Where an earlier lookup brings in a later one's key, the pass keeps
    a stored histogram instead, and that key is counted from the histogram of the earlier lookup's own
    key, so the base is read once more at most, however many lookups there are. A key must be unique
    in its lookup table for that.
    """
    if any(how not in ("left", "inner") for _, _, how in steps):
        raise ValueError("lookup_chain supports left and inner joins")
    limit = broadcast_limit(base)
    small = [_if_small(right, limit) for right, _, _ in steps]
    if base.isStreaming:
        small = [right if own is None else own for own, (right, _, _) in zip(small, steps)]

    def source(i: int) -> int | None:
        """The earlier lookup that brings in the key of lookup i, None for the base."""
        on = steps[i][1]
        return None if on in base.columns else next(j for j in range(i) if on in steps[j][0].columns)

    def root(i: int) -> str:
        earlier = source(i)
        return steps[i][1] if earlier is None else root(earlier)

    large = [i for i, own in enumerate(small) if own is None]
    columns = sorted({root(i) for i in large})
    # Keys of the base itself need no histogram.
    plain = all(source(i) is None for i in large)
    hot = _hot_keys(base, columns) if plain and columns else {}
    histogram = _histogram(base, columns) if not plain else None

    def counts(i: int) -> DataFrame:
        earlier, on = source(i), steps[i][1]
        if earlier is None:
            return histogram.filter(F.col("__of") == on).select(F.col(on), "__rows")
        right, key, _ = steps[earlier]
        return counts(earlier).join(right.select(key, on), key).groupBy(on).agg(F.sum("__rows").alias("__rows"))

    joined = base
    for i, ((right, on, how), own) in enumerate(zip(steps, small)):
        if own is not None:
            joined = joined.join(own, on, how)
        else:
            joined = _split_join(joined, right, on, how, hot[on] if plain else _hot_of(joined, on, counts(i)))
    return joined


def _histogram(base: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each value of each column, stored: ``__of`` names the column."""
    own = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    sets = base.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    return stored(sets.agg(F.count(F.lit(1)).alias("__rows"), own.alias("__of")), "key-histogram")


def pick_rows(keys: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Attach to every asked key its row of a large table.

    Few keys are broadcast to the table's scan, so only the rows asked for are
    shuffled; otherwise both sides are, with frequent keys cut into pieces.
    """
    limit = broadcast_limit(table)
    if estimated_bytes(table) <= limit:
        return keys.join(table, on, how)
    if estimated_bytes(keys) <= limit:
        return keys.join(table.join(keys.select(on), on, "left_semi"), on, how)
    return _split_join(keys, table, on, how)


#: A hot key is cut into this many pieces per partition that it would fill.
CUTS = 4


#: Keys that a sketch of the frequent ones keeps track of per shuffle partition: its counts are
#: wrong by a small part of what makes a key hot.
TRACKED = 32


def _pieces(rows: int, total: int, partitions: int) -> int:
    """Pieces of a key: one, or some if it is hot.

    A key counts as hot above 2/partitions of all rows, so there are fewer than partitions/2 of
    them: their list is bounded whatever the data.
    """
    return math.ceil(CUTS * rows * partitions / total) if rows * partitions > total * 2 else 1


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _hot_keys(df: DataFrame, columns: list[str]) -> dict[str, list[tuple]]:
    """The hot keys of each column and their pieces, from sketches of bounded size: nothing but
    these is shuffled. A key that is missed or cut for nothing changes no row."""
    partitions = _partitions(df)
    tracked = min(1_000_000, max(4096, TRACKED * partitions))
    sketches = [F.expr(f"approx_top_k(`{c}`, {max(1, partitions // 2)}, {tracked})").alias(f"k{i}") for i, c in enumerate(columns)]
    found = df.agg(F.count(F.lit(1)).alias("total"), *sketches).first()
    return {
        c: [(r["item"], n) for r in found[f"k{i}"] if (n := _pieces(r["count"], found["total"], partitions)) > 1]
        for i, c in enumerate(columns)
    }


def _hot_of(df: DataFrame, on: str, counts: DataFrame) -> list[tuple]:
    """The same from the rows of each key (``on, __rows``). The total is observed while the
    largest counts are taken, in one pass over the keys."""
    seen, partitions = Observation(), _partitions(df)
    counts = counts.observe(seen, F.coalesce(F.sum("__rows"), F.lit(0)).alias("total"))
    largest = counts.orderBy(F.desc("__rows")).limit(partitions).collect()
    pieces = [(r[on], _pieces(r["__rows"], seen.get["total"], partitions)) for r in largest]
    return [(key, n) for key, n in pieces if n > 1]


def _split_at_run_time(left: DataFrame) -> bool:
    """Whether Spark's adaptive execution is to split hot keys: counting those of a table that is a
    join itself would run that join twice."""
    conf = left.sparkSession.conf
    on = all(
        conf.get(f"spark.sql.adaptive.{name}", "true").lower() == "true" for name in ("enabled", "skewJoin.enabled"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    return on and re.search(r"^\W*Join ", plan, re.MULTILINE) is not None


def _split_join(left: DataFrame, right: DataFrame, on: str, how: str, hot: list[tuple] | None = None) -> DataFrame:
    """``hot`` has the hot keys and their pieces where they are known already."""
    if hot is None and left.columns == [on]:
        # Keys alone: each is looked up once and repeated afterwards.
        once = left.groupBy(on).agg(F.count(F.lit(1)).alias("__rows"))
        found = once.join(right, on, how)
        return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__rows")))).drop("__rows", "__copy")
    if hot is None:
        hot = [] if _split_at_run_time(left) else _hot_keys(left, [on])[on]
    if not hot:
        # Nothing to cut: columns that nobody asks for need not be shuffled.
        return left.join(right, on, how)
    partitions = _partitions(left)
    hot = left.sparkSession.createDataFrame(
        [(key, n) for key, n in hot if key is not None], f"`{on}` {left.schema[on].dataType.simpleString()}, __pieces int")
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in left.columns])
    # Rows without a key match nothing; spread them so they share no task.
    pieces = F.when(F.col(on).isNull(), F.lit(CUTS * partitions)).otherwise(
        F.coalesce(F.col("__pieces"), F.lit(1))
    )
    left_cut = left.join(F.broadcast(hot), on, "left").withColumn(
        "__piece", F.pmod(spread, pieces).cast("int")
    ).drop("__pieces")
    right_cut = right.join(F.broadcast(hot), on, "left").withColumn(
        "__piece",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1)),
    ).drop("__pieces")
    return left_cut.join(right_cut, [on, "__piece"], how).drop("__piece")
