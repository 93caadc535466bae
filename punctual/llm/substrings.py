"""Repeated byte strings removed by refining the windows of shards together.

This stands in for merging the shards' Burrows-Wheeler transforms: no transform of a whole shard is
built, as its refinement would pass over all text once for each of the 200 symbols. Anchors leave
out what cannot repeat, and the rows that are refined are windows.

A shard is a chunk of the table (a few MB of text). The question is which strings of ``length``
bytes start more than once; matches do not cross documents. It is asked in three rounds.

1. Anchors. In every window of ``length`` bytes the substring of ``ANCHOR`` bytes with the
   smallest hash is its anchor: equal windows have equal anchors at equal places. Shards send
   the distinct anchors with their counts to hash ranges and get the corpus counts back. A
   window whose anchor occurs once cannot repeat.
2. Merge. Successive windows with one anchor form a string. A shard's distinct strings with a
   repeated anchor go to the anchor's hash range, where the shards' windows meet. A row is
   a window, at first known only by its anchor and where it stands. Then the rows of all shards
   are refined column by column from the windows' ends: the symbols before the known part are
   stably partitioned, so rows stay sorted by what is known, and a block whose symbols differ
   splits. Rows alone in their block leave. Blocks
   that still hold two rows after ``length`` bytes are the repeated intervals. No suffix is
   sorted again, and nothing rests on a hash of what is removed.
3. Removal. The repeated windows go back to the shards as byte spans of their documents.

An anchor with more than ``HOT`` occurrences would bring all its strings to one task. Its
windows are sent one by one, by a hash of the whole window: equal ones still meet, distinct
ones are spread.

Nulls and edges: a null or empty text has no bytes. Texts under ``length`` bytes repeat nothing.
Repeated rows are documents of their own: all bytes of theirs, ``length`` at least, go. Cuts may
fall within a character, so the kept text is bytes. A table without rows gives none. Other
columns are not read. The table is read three times and must give the same rows in the same
order, as stored files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import text_column
from punctual.llm.packed import (
    ascending_in, ascending_out, by_range, chunks, hash_range, numbers_in, numbers_out, range_groups,
    texts_in, texts_out,
)
from punctual.llm.words import MULTIPLIER, mixed

LENGTH = 200
ANCHOR = 80
HOT = 50_000
#: Text per hash range.
RANGE_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        # A chunk's size and some more, so that it is made once.
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(int(MULTIPLIER), n), out=sums[1:])
    back = _power(pow(int(MULTIPLIER), -1, 1 << 64), n - size + 1)
    return mixed((sums[size:] - sums[:-size]) * back)


class Shard:
    """The strings of a chunk: ``start`` and ``stop`` in its joined bytes, the ``anchor``'s
    hash and its place in the string."""

    def __init__(self, texts: list[bytes], length: int, anchor: int):
        self.raw = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.length = length
        found = []
        # In steps, so that the arrays of a very long text stay bounded.
        step = 1 << 20
        for at in range(0, max(len(self.data) - length + 1, 0), step):
            found.append(self._strings(at, min(at + step, len(self.data) - length + 1), anchor))
        joined = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.start, self.stop, self.anchor, self.place = joined

    def _strings(self, low: int, high: int, anchor: int) -> tuple:
        """Those whose windows start in [low, high)."""
        width = self.length - anchor + 1
        hashes = _hashes(self.data[low : high + self.length - 1], anchor)
        # The place in the low bits: of equal hashes the first counts.
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.append(keys, np.full(-len(keys) % width, ~np.uint64(0))).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = high - low
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        # Windows within one document.
        inside = np.zeros(n + 1, np.int32)
        starts = np.append(0, self.ends[:-1])
        long = self.ends - starts >= self.length
        np.add.at(inside, np.clip(starts[long] - low, 0, n), 1)
        np.add.at(inside, np.clip(self.ends[long] - self.length + 1 - low, 0, n), -1)
        window = np.flatnonzero(np.cumsum(inside[:n]) > 0)
        if not len(window):
            return window, window, np.zeros(0, np.uint64), window
        own = place[window]
        new = np.append(True, (own[1:] != own[:-1]) | (np.diff(window) != 1))
        first = window[new]
        last = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1]
        # Anchors have small hashes; mixed again, they fill all ranges alike.
        return first + low, last + low + self.length, mixed(hashes[own[new]] + MULTIPLIER), own[new] - first


def merge(strings: list[bytes], anchors: np.ndarray, places: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct string, of all shards, which of its windows occur elsewhere: in another
    string, or in a copy of it (``copies``: how often it occurs)."""
    sizes = np.array([len(s) for s in strings], np.int64)
    windows = sizes - length + 1
    ends = np.cumsum(windows)
    repeated = np.repeat(copies > 1, windows)
    text = np.frombuffer(b"".join(strings), np.uint8)
    pairs = (text[:-1].astype(np.uint16) << 8) | text[1:]
    begins = np.repeat(np.cumsum(sizes) - sizes - (ends - windows), windows) + np.arange(int(windows.sum()))
    inside = np.arange(int(windows.sum())) - np.repeat(ends - windows, windows)
    # Before the first column a row's block is its anchor and where it stands in the window.
    block = mixed(np.repeat(anchors, windows) + (np.repeat(places, windows) - inside).astype(np.uint64) * MULTIPLIER)
    rows = np.argsort(block, kind="stable")
    block = block[rows]
    rows, block = _together(rows, block[1:] != block[:-1])
    columns = [*range(length - 2, -1, -2), *([0] if length % 2 else [])]
    for column in columns:
        if not len(rows):
            break
        symbol = pairs[begins[rows] + column]
        order = np.argsort(symbol, kind="stable")
        rows, symbol, block = rows[order], symbol[order], block[order]
        rows, block = _together(rows, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
    repeated[rows] = True
    return np.split(repeated, ends[:-1])


def _together(rows: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and blocks without the rows that are alone in theirs."""
    if not len(rows):
        return rows, np.zeros(0, np.int32)
    left = np.append(True, turns)
    alone = left & np.append(turns, True)
    block = np.cumsum(left, dtype=np.int32)
    return rows[~alone], block[~alone]


ASK = "range long, chunk long, n long, hashes binary, counts binary"
CHUNK = "chunk long, range long, n long, counts binary, sizes binary, ids array<long>"
STRINGS = "range long, chunk long, n long, anchors binary, places binary, sizes binary, strings binary, uses long, owners binary, docs binary, starts binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, batch in chunks(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([-1]), pa.array([len(texts)]), pa.array([texts_out(texts)], pa.binary()),
            pa.array([numbers_out(np.array([len(t) for t in texts]))], pa.binary()),
            pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
        ], ["chunk", "range", "n", "counts", "sizes", "ids"])


def _open(table: pa.Table) -> tuple[list[bytes], list[int | None], pa.Table]:
    """A chunk's texts, their ids, and its other rows in the order of their ranges."""
    table = table.sort_by("range")
    first = table.slice(0, 1).to_pylist()[0]
    sizes = numbers_in(first["sizes"], first["n"]).tolist()
    return texts_in(first["counts"], sizes), first["ids"], table.slice(1)


def _ask(length: int, anchor: int, ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in chunks(batches):
            shard = Shard([(t or "").encode() for t in batch.column("text").to_pylist()], length, anchor)
            hashes, times = np.unique(shard.anchor, return_counts=True)
            rows = by_range(hashes, ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
                pa.array([b - a for _, a, b in rows], pa.int64()),
                pa.array([ascending_out(hashes[a:b]) for _, a, b in rows], pa.binary()),
                pa.array([numbers_out(times[a:b]) for _, a, b in rows], pa.binary()),
            ], ["range", "chunk", "n", "hashes", "counts"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: the corpus count of every anchor, to each chunk that asked."""
    sizes = table.column("n").to_pylist()
    hashes = np.concatenate([ascending_in(h.as_py(), n) for h, n in zip(table.column("hashes"), sizes)])
    times = np.concatenate([numbers_in(c.as_py(), n) for c, n in zip(table.column("counts"), sizes)])
    known, places = np.unique(hashes, return_inverse=True)
    totals = np.bincount(places, times, len(known)).astype(np.int64)[places]
    ends = np.cumsum(sizes).tolist()
    return pa.table({
        "chunk": table.column("chunk"), "range": table.column("range"), "n": table.column("n"),
        "counts": pa.array([numbers_out(totals[e - n : e]) for e, n in zip(ends, sizes)], pa.binary()),
        "sizes": pa.nulls(len(sizes), pa.binary()), "ids": pa.nulls(len(sizes), pa.list_(pa.int64())),
    })


def _send(length: int, anchor: int, ranges: int, hot: int):
    def send(table: pa.Table) -> pa.Table:
        texts, _, answers = _open(table)
        number = table.column("chunk")[0].as_py()
        shard = Shard(texts, length, anchor)
        hashes = np.unique(shard.anchor)
        counts = [numbers_in(c.as_py(), n) for c, n in zip(answers.column("counts"), answers.column("n").to_pylist())]
        total = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
        total = total[np.searchsorted(hashes, shard.anchor)] if len(hashes) else total
        few = np.flatnonzero((total > 1) & (total <= hot))
        start, stop, key, place = (x[few] for x in (shard.start, shard.stop, shard.anchor, shard.place))
        if len(many := np.flatnonzero(total > hot)):
            # Each window of a hot anchor for itself.
            windows = shard.stop[many] - shard.start[many] - length + 1
            own = np.repeat(shard.start[many] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            start, stop = np.append(start, own), np.append(stop, own + length)
            key = np.append(key, _hashes(shard.data, length)[own])
            place = np.append(place, np.zeros(len(own), np.int64))
        firsts = np.append(0, shard.ends[:-1])
        doc = np.searchsorted(shard.ends, start, side="right")
        where = hash_range(key, ranges)
        out: list[dict] = []
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order], prepend=np.uint64(1 << 63)) != 0) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            seen: dict[bytes, int] = {}
            owners, kept = [], []
            for i, x, y in zip(order[a:b].tolist(), start[order[a:b]].tolist(), stop[order[a:b]].tolist()):
                owner = seen.setdefault(shard.raw[x:y], len(seen))
                if owner == len(kept):
                    kept.append(i)
                owners.append(owner)
            rows = order[a:b]
            out.append({
                "range": int(where[rows[0]]), "chunk": number, "n": len(kept),
                "anchors": numbers_out(key[kept]), "places": numbers_out(place[kept], 2),
                "sizes": numbers_out(stop[kept] - start[kept], 2), "strings": texts_out(list(seen)),
                "uses": len(rows), "owners": numbers_out(np.array(owners), 4),
                "docs": numbers_out(doc[rows], 4), "starts": numbers_out(start[rows] - firsts[doc[rows]], 4),
            })
        kinds = {"range": pa.int64(), "chunk": pa.int64(), "n": pa.int64(), "uses": pa.int64()}
        return pa.table({
            c: pa.array([r[c] for r in out], kinds.get(c, pa.binary())) for c in (f.split()[0] for f in STRINGS.split(", "))
        })

    return send


def _merge_range(length: int):
    def merge_range(table: pa.Table) -> pa.Table:
        """One hash range: the rows of all shards are merged, each shard gets its spans."""
        found: dict[bytes, int] = {}
        strings, anchors, places, copies, shards = [], [], [], [], []
        for row in table.to_pylist():
            n, uses = row["n"], row["uses"]
            sizes = numbers_in(row["sizes"], n, 2).tolist()
            owners = numbers_in(row["owners"], uses, 4).astype(np.int64)
            times = np.bincount(owners, minlength=n)
            own = []
            for text, a, p, t in zip(texts_in(row["strings"], sizes), numbers_in(row["anchors"], n).tolist(), numbers_in(row["places"], n, 2).tolist(), times.tolist()):
                at = found.setdefault(text, len(strings))
                if at == len(strings):
                    strings.append(text)
                    anchors.append(a)
                    places.append(p)
                    copies.append(0)
                copies[at] += t
                own.append(at)
            shards.append((row["chunk"], np.array(own)[owners], numbers_in(row["docs"], uses, 4), numbers_in(row["starts"], uses, 4)))
        windows = merge(strings, np.array(anchors, np.uint64), np.array(places, np.int64), np.array(copies), length)
        runs = []
        for own in windows:
            turns = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            # Bytes of the first to the last window of a run.
            runs.append((turns[::2], turns[1::2] + length - 1))
        out = []
        number = np.array([len(a) for a, _ in runs])
        low = np.concatenate([a for a, _ in runs])
        high = np.concatenate([b for _, b in runs])
        first = np.cumsum(number) - number
        for chunk, own, docs, starts in shards:
            many = number[own]
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            doc, base = np.repeat(docs, many), np.repeat(starts, many).astype(np.int64)
            out.append((chunk, len(at), np.concatenate([doc.astype(np.int64), base + low[at], base + high[at]])))
        return pa.table({
            "chunk": pa.array([c for c, _, _ in out], pa.int64()), "range": pa.array([0] * len(out), pa.int64()),
            "n": pa.array([n for _, n, _ in out], pa.int64()),
            "counts": pa.array([numbers_out(x, 4) for _, _, x in out], pa.binary()),
            "sizes": pa.nulls(len(out), pa.binary()), "ids": pa.nulls(len(out), pa.list_(pa.int64())),
        })

    return merge_range


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"


def _remove(table: pa.Table) -> pa.Table:
    texts, ids, rest = _open(table)
    spans = [numbers_in(c.as_py(), 3 * n, 4).astype(np.int64).reshape(3, n) for c, n in zip(rest.column("counts"), rest.column("n").to_pylist())]
    doc, low, high = np.concatenate(spans, axis=1) if spans else np.zeros((3, 0), np.int64)
    order = np.lexsort((low, doc))
    by_doc: dict[int, list[list[int]]] = {}
    for d, a, b in zip(doc[order].tolist(), low[order].tolist(), high[order].tolist()):
        own = by_doc.setdefault(d, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    gone, kept, found = [], [], []
    for i, text in enumerate(texts):
        own, at, parts = by_doc.get(i, []), 0, []
        for a, b in own:
            parts.append(text[at:a])
            at = b
        kept.append(b"".join([*parts, text[at:]]) if own else text)
        gone.append(len(text) - len(kept[-1]))
        found.append([{"start": a, "stop": b} for a, b in own])
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
        "n_removed": pa.array(gone, pa.int64()),
        "spans": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        "kept": pa.array(kept, pa.binary()),
    })


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans`` (removed, ascending) and ``kept`` of every row."""
    if not 1 <= anchor <= length:
        raise ValueError("an anchor is a part of the string")
    rows = text_column(docs).withColumn("text", F.col("text").cast("string")).withColumn("part", F.spark_partition_id())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-size // RANGE_BYTES))
    texts = rows.mapInArrow(_texts, CHUNK)
    asked = rows.mapInArrow(_ask(length, anchor, ranges), ASK)
    answers = range_groups(asked, ranges).applyInArrow(_answer, CHUNK)
    sent = texts.unionByName(answers).groupBy("chunk").applyInArrow(_send(length, anchor, ranges, hot), STRINGS)
    spans = range_groups(sent, ranges).applyInArrow(_merge_range(length), CHUNK)
    return texts.unionByName(spans).groupBy("chunk").applyInArrow(_remove, KEPT)
