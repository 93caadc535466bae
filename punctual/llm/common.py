"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.session import scratch_path, shared_root, stored

__all__ = ["join_spread", "read", "rows_in", "scratch_path", "shared_root", "slices", "stored", "text_column"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_column(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, by fixed names, so that no other
    column of the input can clash with one that the operator adds."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )


def rows_in(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of one piece hold about ``most_bytes``
    (one longer string stays whole): bounds the memory that a piece's arrays take."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = sizes.cast(pa.int64()).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: A very frequent key is cut into this many pieces for each partition that it would fill.
CUTS = 4


def join_spread(rows: DataFrame, counted: DataFrame, key: list[str], by: str) -> DataFrame:
    """Inner join with ``counted``, which has one row per key and in ``n`` the number of its rows. A
    key with more than two partitions' share of all rows is cut into pieces by the column ``by``
    (long). There are fewer such keys than partitions, so the list of them is bounded."""
    partitions = rows_in(rows.sparkSession)
    total = counted.agg(F.sum("n")).first()[0] or 1
    hot = counted.filter(F.col("n") * partitions > 2 * total).select(
        *key, F.ceil(F.col("n") * (CUTS * partitions / total)).cast("int").alias("__pieces")
    )
    pieces = F.coalesce("__pieces", F.lit(1))
    cut = rows.join(F.broadcast(hot), key, "left").withColumn("__piece", F.pmod(F.col(by), pieces).cast("int"))
    copies = counted.join(F.broadcast(hot), key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return cut.drop("__pieces").join(copies.drop("__pieces"), [*key, "__piece"])
