"""Raw CSV extracts to Bronze Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from punctual.schemas import BRONZE
from punctual.sources import lake


class MissingSource(FileNotFoundError):
    """A raw extract that the strict load needs is not there."""


def read_raw(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """Scan one CSV extract by column name.

    The header is the only thing looked at beforehand: columns are read as text
    and cast, so no inference pass over the data is needed, their order in the
    file does not matter, and a value of the wrong type fails the load. Fields may be
    quoted, with quotes doubled, and whole numbers may be written as ``10.0``. A large file is
    read in splits; ``multiLine=True`` reads one with line breaks inside of fields, as a whole.
    """
    dialect = {"header": True, "nullValue": "", "quote": '"', "escape": '"'}
    text = (
        spark.read.options(**{**dialect, **options})
        .csv(f"{folder.rstrip('/')}/{name}.csv")
    )
    return text.select([_typed(c, t).alias(c) for c, t in BRONZE[name].items()])


def _typed(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind not in ("int", "bigint"):
        return value.cast(kind)
    # Digits are cast as they are: a double would not hold every bigint.
    plain = F.regexp_replace(F.trim(value), r"\.0*$", "")
    return plain.cast(kind)


def _is_missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def load_bronze(
    spark: SparkSession,
    raw_folder: str,
    bronze_folder: str,
    names: Iterable[str] = tuple(BRONZE),
    on_missing: str = "error",
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Write every extract to ``bronze_folder/<name>`` and return the manifest.

    ``on_missing="error"`` stops at an absent extract before anything is written,
    ``"skip"`` leaves it out. ``options`` are the reader's, by extract. Rows are counted while
    they are written. All extracts are written beside the tables first and take their places
    together, so a value that cannot be read leaves every table as it was.
    Manifest: name, n_rows, n_cols, path.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError("on_missing is 'error' or 'skip'")
    found = []
    for name in names:
        try:
            found.append((name, read_raw(spark, raw_folder, name, **(options or {}).get(name, {}))))
        except AnalysisException as error:
            if not _is_missing(error):
                raise
            if on_missing == "error":
                raise MissingSource(f"{raw_folder}/{name}.csv") from error
    root = bronze_folder.rstrip("/")
    beside = f"{root}/_loading-{uuid.uuid4().hex}"
    manifest = []
    try:
        for name, frame in found:
            seen = Observation(f"load_{name}")
            lake.write_bronze(frame, f"{beside}/{name}", name, seen=seen)
            manifest.append((name, seen.get["n_rows"], len(frame.columns), f"{root}/{name}"))
        lake.swap(spark, [(f"{beside}/{name}", f"{root}/{name}") for name, _ in found])
    finally:
        lake.remove(spark, beside)
    return spark.createDataFrame(manifest, "name string, n_rows bigint, n_cols int, path string")


def row_total(manifest: DataFrame) -> DataFrame:
    """Files and rows of a load in one row."""
    return manifest.agg(
        F.array_sort(F.collect_list("path")).alias("files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("row_count"),
    )
