"""Bronze scans, Silver views and Gold tables."""

from __future__ import annotations

import hashlib
import itertools
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from punctual.functions.running import with_sequence
from punctual.session import scratch_path, shuffles_freed, stored


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system itself: nothing below the path is listed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


#: Tables that may get a row again: their key, and the column whose value closes a row.
LIVE_KEYS = {"purchase_orders": ("po_id", "receipt_date")}
#: Such a table lies in this many buckets by the hash of its key.
BUCKETS = 32
BUCKET = "__bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _dealt(df: DataFrame, name: str) -> DataFrame:
    """Ranges of bucket and id: a large bucket is written by several tasks, a task writes few
    files. All rows of an id are in one range."""
    return df.repartitionByRange(BUCKET, LIVE_KEYS[name][0])


def _in_order(df: DataFrame, name: str) -> DataFrame:
    """Each file sorted, so that a lookup by id reads few row groups."""
    return df.sortWithinPartitions(BUCKET, LIVE_KEYS[name][0])


def write_bronze(
    df: DataFrame, path: str, name: str, buckets: int = BUCKETS, seen: Observation | None = None
) -> None:
    """Write a Bronze table; one that may get rows again is dealt into buckets of its key. ``seen``
    observes ``n_rows``, the rows written."""
    dealt = name in LIVE_KEYS
    if dealt:
        df = _in_order(_dealt(df.select("*", _bucket(LIVE_KEYS[name][0], buckets)), name), name)
    if seen is not None:
        # Behind the ranges: rows that are sampled for them are not counted.
        df = df.observe(seen, F.count(F.lit(1)).alias("n_rows"))
    if not dealt:
        df.write.mode("overwrite").parquet(path)
        return
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(path)
    put_text(df.sparkSession, f"{path}/_buckets", str(buckets))


def read_bronze(spark: SparkSession, bronze_folder: str, name: str) -> DataFrame:
    """One Bronze table. Rows that arrived as a stream have been merged into it."""
    return spark.read.parquet(f"{bronze_folder.rstrip('/')}/{name}").drop(BUCKET)


def newest(base: DataFrame, live: DataFrame, name: str) -> DataFrame:
    """Base rows with those of ``live`` instead where they have the same id, both with their buckets.
    A closed row beats an open one, a live row one of the base; ties go to the largest row. Base rows of
    other ids stay as they are, and all rows without an id.

    Every row is shuffled once, into the ranges that the table is written in.
    """
    key, closed = LIVE_KEYS[name]
    both = base.withColumn("__live", F.lit(False)).unionByName(live.withColumn("__live", F.lit(True)))
    rank = F.struct(F.col(closed).isNotNull(), "__live", *[c for c in base.columns if c != key])
    of_id = Window.partitionBy(BUCKET, key).orderBy(rank.desc())
    # The rows of one id, or those without one, which need not be told apart.
    whole = of_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = _dealt(both, name).withColumns({"__place": F.row_number().over(of_id), "__again": F.max("__live").over(whole)})
    kept = ranked.filter(F.col(key).isNull() | ~F.col("__again") | (F.col("__place") == 1))
    return _in_order(kept.select(base.columns), name)


def merge_rows(spark: SparkSession, bronze_folder: str, name: str, live: DataFrame, step: str) -> None:
    """Merge rows into a Bronze table: only the buckets that they fall into are read and
    written again. ``step`` names the batch: one that broke off is taken up where it was.

    The new buckets are written beside the table first. They take the places of the old ones only when
    all are there, so a run that ends in between, or is repeated, finds those that are left and moves them.
    """
    root, key = bronze_folder.rstrip("/"), LIVE_KEYS[name][0]
    path, beside = f"{root}/{name}", f"{root}/_merging/{name}/{step}"
    if not path_exists(spark, f"{beside}/_SUCCESS"):
        table = _bucketed(spark, path, name, live)
        buckets = int(get_text(spark, f"{path}/_buckets"))
        arrived = scratch_path(spark, "arrived")
        dealt = live.select(*[c for c in table.columns if c != BUCKET], _bucket(key, buckets))
        dealt.write.option("compression", "zstd").parquet(arrived)
        dealt = spark.read.schema(dealt.schema).parquet(arrived)
        # At most one row per bucket.
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]
        if touched:
            merged = newest(table.filter(F.col(BUCKET).isin(touched)), dealt.select(table.columns), name)
            with shuffles_freed(spark):
                merged.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(beside)
        remove(spark, arrived)
        if not touched:
            return
    replace_folders(spark, beside, path)
    remove(spark, beside)


def _bucketed(spark: SparkSession, path: str, name: str, live: DataFrame) -> DataFrame:
    """The table with its buckets; one written without them is dealt out first, one that is not
    there yet begins without rows."""
    there = path_exists(spark, path)
    if not there or not path_exists(spark, f"{path}/_buckets"):
        rows = spark.read.parquet(path) if there else spark.createDataFrame([], live.schema)
        dealt = f"{path.rsplit('/', 1)[0]}/_dealt-{uuid.uuid4().hex}"
        write_bronze(rows, dealt, name)
        swap(spark, [(dealt, path)])
        if not there:
            return rows.withColumn(BUCKET, F.lit(0))
    return spark.read.parquet(path)


# --- files -------------------------------------------------------------------
def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    store, target = _file_system(spark, path)
    store.delete(target, True)


def replace_folders(spark: SparkSession, new: str, path: str) -> None:
    """Move every folder inside ``new`` into ``path``, in the place of the one of its name. Each is moved
    by itself: after a run that broke off, those that are left are still to be moved."""
    store, source = _file_system(spark, new)
    for status in store.listStatus(source):
        if status.isDirectory():
            target = spark._jvm.org.apache.hadoop.fs.Path(path, status.getPath().getName())
            store.delete(target, True)
            if not store.rename(status.getPath(), target):
                raise OSError(f"{target} cannot be replaced")


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of that name; tells whether it was written."""
    store, target = _file_system(spark, path)
    store.mkdirs(target.getParent())
    try:
        out = store.create(target, False)
    except Exception as error:  # the file system's own kind of error
        if store.exists(target):
            return False
        raise error
    out.write(text.encode())
    out.close()
    return True


def get_text(spark: SparkSession, path: str) -> str:
    store, target = _file_system(spark, path)
    stream = store.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def swap(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Rename each folder to its final name, all or none: what was there before is moved aside,
    and moved back if one of the renames fails."""
    done = []
    try:
        for new, final in pairs:
            store, source = _file_system(spark, new)
            target = _file_system(spark, final)[1]
            aside = spark._jvm.org.apache.hadoop.fs.Path(f"{new}-before")
            store.mkdirs(target.getParent())
            had = store.exists(target)
            if had and not store.rename(target, aside):
                raise OSError(f"{final} cannot be moved")
            done.append((store, target, aside if had else None))
            if not store.rename(source, target):
                raise OSError(f"{new} cannot be moved")
    except Exception:
        for store, target, aside in reversed(done):
            store.delete(target, True)
            if aside is not None:
                store.rename(aside, target)
        raise
    for store, _, aside in done:
        if aside is not None:
            store.delete(aside, True)


# --- open orders -------------------------------------------------------------
def append_open_orders(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base orders followed by new ones without receipt; ids continue after the largest.

    ``new`` needs no po_id. Only the new rows are numbered.
    """
    return base.unionByName(number_open_orders(base, new), allowMissingColumns=True)


def largest_number(base: DataFrame) -> DataFrame:
    digits = F.nullif(F.regexp_extract("po_id", r"(\d+)", 1), F.lit(""))
    return base.agg(F.coalesce(F.max(digits.try_cast("bigint")), F.lit(0).cast("bigint")))


def number_open_orders(base: DataFrame, new: DataFrame, after: Column | None = None) -> DataFrame:
    """The new orders with their ids: PO and six zero-padded digits, from ``after`` on (else after
    the largest number there is)."""
    after = largest_number(base).scalar() if after is None else after
    numbered = with_sequence(new.drop("po_id", "receipt_date"), "__n")
    receipt = F.lit(None).cast(base.schema["receipt_date"].dataType)
    return numbered.withColumns(
        {"po_id": F.format_string("PO%06d", after + F.col("__n")), "receipt_date": receipt}
    ).select([c for c in base.columns if c in new.columns or c in ("po_id", "receipt_date")])


def store_open_orders(spark: SparkSession, bronze_folder: str, new: DataFrame, batch: str) -> bool:
    """Add open orders to the Bronze order table under numbers of their own, once per ``batch``.

    A batch takes its range of numbers by a small file that only one run can create, keeps its
    numbered rows in a folder and then merges them. A repeated run finds the folder: it adds
    nothing, or goes on with the same numbers where the first one broke off. Two runs at a time
    get different ranges. Tells whether rows were added.
    """
    root = bronze_folder.rstrip("/")
    own = f"{root}/_batches/{hashlib.sha256(batch.encode()).hexdigest()[:32]}"
    if path_exists(spark, f"{own}/done"):
        return False
    if not path_exists(spark, f"{own}/rows/_SUCCESS"):
        base, rows = read_bronze(spark, root, "purchase_orders"), stored(new, "open-orders")
        after = F.lit(_take_numbers(spark, root, base, rows.count()))
        numbered = number_open_orders(base, rows, after)
        missing = {c: F.lit(None).cast(base.schema[c].dataType) for c in base.columns if c not in numbered.columns}
        numbered.withColumns(missing).select(base.columns).write.mode("overwrite").parquet(f"{own}/rows")
    merge_rows(spark, root, "purchase_orders", spark.read.parquet(f"{own}/rows"), f"batch-{own.rsplit('/', 1)[-1]}")
    put_text(spark, f"{own}/done", batch)
    return True


def _take_numbers(spark: SparkSession, root: str, base: DataFrame, rows: int) -> int:
    """The number before a range of ``rows`` that no other run gets."""
    folder = f"{root}/_numbers"
    largest = largest_number(base).first()[0]
    for turn in itertools.count():
        # Each file holds the last number of its range; the next one begins after it.
        taken = f"{folder}/{turn:08d}"
        if put_text(spark, taken, str(largest + rows)):
            return largest
        largest = max(largest, int(_written(spark, taken)))


def _written(spark: SparkSession, path: str, waits: int = 50) -> str:
    """The text of a file that another run may just be writing."""
    for _ in range(waits):
        if text := get_text(spark, path):
            return text
        time.sleep(0.2)
    raise RuntimeError(f"{path} is empty: the run that made it broke off; delete it")


def publish_silver(views: dict[str, DataFrame]) -> None:
    """Silver relations stay views: consumers get one plan down to the Bronze scan."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


def write_gold(
    df: DataFrame, name: str, database: str = "gold", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (),
    dealt: bool = False,
) -> None:
    """Materialise one Gold table. With ``sort_by`` the rows are dealt out by ranges, unless they are ``dealt``
    so already, so that a task writes few files, a large partition is written by several tasks, and the files of one hold
    different ranges: readers leave out files and row groups by their smallest and largest value."""
    create_database(df.sparkSession, database)
    if sort_by:
        order = [*partition_by, *sort_by]
        df = (df if dealt else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(f"{database}.{name}")


def read_gold(spark: SparkSession, name: str, database: str = "gold") -> DataFrame:
    return spark.table(f"{database}.{name}")
