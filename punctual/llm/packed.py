"""Numbers of many rows packed into one binary value: bytes plane by plane, compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from punctual.llm.common import rows_in, slices

#: Text of a chunk.
CHUNK_BYTES = 4 << 20


def numbers_out(values: np.ndarray, size: int = 8) -> bytes:
    planes = np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def numbers_in(data: bytes, n: int, size: int = 8) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=size * n)
    planes = np.frombuffer(raw, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1)


def ascending_out(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, whose upper bytes are nearly zero."""
    return numbers_out(np.diff(values, prepend=np.uint64(0)))


def ascending_in(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(numbers_in(data, n), dtype=np.uint64)


def texts_out(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def texts_in(data: bytes, sizes: list[int]) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(sum(sizes), 1))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of a partition with numbers that are the same whenever the table is read. The
    column ``part`` is the partition's number."""
    for number, batch in enumerate(slices(batches, most_bytes=CHUNK_BYTES)):
        yield (batch.column("part")[0].as_py() << 32) + number, batch


def hash_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def range_groups(df: DataFrame, ranges: int):
    """Rows grouped by their ``range``, with as many tasks as there are ranges: a task's share does
    not grow with the table."""
    return df.repartition(max(ranges, rows_in(df.sparkSession)), "range").groupBy("range")


def by_range(ascending: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """``(range, from, to)`` of the ranges that ascending hashes fall into."""
    where = hash_range(ascending, ranges)
    starts = np.flatnonzero(np.diff(where, prepend=np.uint64(1 << 63)) != 0) if len(where) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(where))
    return list(zip(where[starts].tolist(), starts.tolist(), stops.tolist()))
