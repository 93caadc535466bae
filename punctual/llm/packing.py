"""Token sequences of near-equal length by Karmarkar-Karp differencing.

A document's ids (its end id among them) are cut into whole sequences and a rest, the rest
into pieces of at most ``piece`` ids. Pieces are dealt into groups of bounded size by a hash
of their document. In a group, multiway differencing starts with one partial partition for
each piece - the piece in one window, all other windows empty - and always merges the two with
the largest imbalance, the fullest window of one with the emptiest of the other, until one
partition is left. Its windows are near-equal. If any is over the capacity, the group is
partitioned anew into more windows.

Nulls and edges: a null or empty text is the end id alone. Rows with the same ``doc_id`` (or
null) are documents of their own. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import slices, stored, text_column
from punctual.llm.tokens import tokens

CAPACITY = 1024
#: Largest piece of a rest: with several pieces to a window, windows come out near-equal.
PIECE = 256
#: Pieces that meet in one group, on average.
GROUP = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def differencing(sizes: list[int], windows: int) -> list[int]:
    """For each size the window it goes to: near-equal totals by largest differencing.

    A partial partition is kept without the level that all its windows share, so only windows
    above its emptiest one are listed: ``(sum, members)``, fullest first.
    """
    if windows == 1:
        return [0] * len(sizes)
    # Members are kept as a tree of merges: (left, right) or a piece.
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # The fullest windows of a meet the emptiest of b: its unlisted ones come first.
        room = windows - len(b)
        merged = a[:room] + b[: max(0, windows - len(a))]
        for (x, left), (y, right) in zip(a[room:], reversed(b[max(0, windows - len(a)):])):
            merged.append((x + y, (left, right)))
        merged.sort(key=lambda w: -w[0])
        if len(merged) == windows:
            level = merged[-1][0]
            # The emptiest window's members stay, at no imbalance.
            merged = [(x - level, members) for x, members in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)), made, merged))
        made += 1
    out = [0] * len(sizes)
    for window, (_, members) in enumerate(heap[0][2] if heap else []):
        stack = [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out[x] = window
    return out


def windows_of(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size; none holds more than the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        chosen = differencing(sizes, windows)
        if np.bincount(chosen, sizes, minlength=1).max(initial=0) <= capacity:
            return chosen
        windows += 1


def pieces_of(docs: DataFrame, tokenizer: str, end: int, capacity: int, piece: int) -> DataFrame:
    """Every document's pieces; ``salt`` tells rows with the same ``doc_id`` apart."""
    rows = text_column(docs).withColumn("salt", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(tokenizer)
        for batch in slices(batches):
            ids, lengths = coder.encode(batch.column("text"), end)
            ids = ids.astype("<u4", copy=False)
            columns: list[list] = [[] for _ in range(6)]
            at = 0
            keys, salts = batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist()
            for doc, salt, n in zip(keys, salts, lengths.tolist()):
                whole = n - n % capacity
                starts = [*range(0, whole, capacity), *range(whole, n, piece)]
                for a, b in zip(starts, [*starts[1:], n]):
                    for column, value in zip(columns, (doc, a, b - a, zlib.crc32(ids[at + a : at + b]), n, salt)):
                        column.append(value)
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")]
            )

    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, piece: int = PIECE,
         group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, padding`` (of its sequence: up to the capacity, none at a power of two)."""
    pieces = stored(pieces_of(docs, tokenizer, end, capacity, piece), "pieces")
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group))
    # A document is dealt out as a whole: few pieces need a window, whole sequences need none.
    keyed = pieces.withColumn(
        "bin", F.pmod(F.xxhash64("doc_id", "salt", F.when(F.col("length") == capacity, F.col("start"))), F.lit(groups))
    )

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["salt", "doc_id", "start"], kind="stable").reset_index(drop=True)
        short = (rows["length"] < capacity).to_numpy()
        sequence = np.zeros(len(rows), np.int64)
        sequence[short] = windows_of(rows.loc[short, "length"].tolist(), capacity) if short.any() else []
        used = int(sequence[short].max()) + 1 if short.any() else 0
        sequence[~short] = used + np.arange(int((~short).sum()))
        totals = rows["length"].groupby(sequence).transform("sum").to_numpy()
        rows["offset"] = rows["length"].groupby(sequence).cumsum() - rows["length"]
        # The bin in the upper bits: no sequence of another group has the same number.
        rows["sequence_id"] = rows["bin"].to_numpy() * (1 << 32) + sequence
        rows["padding"] = np.where(totals & (totals - 1) == 0, 0, capacity - totals)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]]

    return keyed.groupBy("bin").applyInPandas(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, padding long",
    )
