"""Exact order statistics and distribution gaps by counting in value ranges.

Every pass is one aggregate over the rows as they are, of all columns at once: a task counts how
many values lie between neighbouring cuts and how many equal a cut, and sends only these numbers.
The first cuts come from a quantile sketch. Ranges that can still hold the answer are then cut
finer, or, once they hold few rows, their values are counted singly. So nothing of the size of
the table is written, sorted or shuffled, and what reaches the driver is bounded by the number
of cuts and by ``EXACT_ROWS``.

Nulls and NaN count for no column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Ranges of the first pass, and the parts that an open range is cut into afterwards.
RANGES, PARTS = 512, 64
#: Values of all open ranges together that are counted singly.
EXACT_ROWS = 100_000
_SIGN = np.uint64(1 << 63)


def _key(values) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _double(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _SIGN, keys & ~_SIGN, ~keys).view(np.float64)


def cuts_between(low: float, high: float, parts: int = PARTS) -> np.ndarray:
    """Doubles between two others, so that a range loses most of its doubles with every cut,
    wherever its values lie: 64 bits are used up after a few rounds."""
    a, b = (int(k) for k in _key([low, high]))
    if b - a < 2:
        return np.zeros(0)
    inner = sorted({a + (b - a) * i // parts for i in range(1, parts)} - {a, b})
    # Half of the cuts in equal steps: most columns are spread like that.
    even = np.linspace(low, high, parts + 1)[1:-1] if np.isfinite([low, high]).all() else np.zeros(0)
    both = np.unique(np.append(_double(np.array(inner, np.uint64)), even))
    return both[(both > low) & (both < high)]


def first_cuts(df: DataFrame, columns: list[str], ranges: int = RANGES) -> dict[str, np.ndarray]:
    """About equally filled ranges of each column from one sketch pass."""
    shares = [i / ranges for i in range(ranges + 1)]
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(usable(c), shares, 4 * ranges).alias(c) for c in columns]).first()
    return {c: np.unique(np.array(row[c] or [], np.float64)) for c in columns}


def _columns(df: DataFrame, columns: list[str], group: str | None) -> DataFrame:
    own = F.col(group).cast("int") if group else F.lit(0)
    return df.select(own.alias("__group"), *[F.col(c).cast("double").alias(c) for c in columns]).filter("__group is not null")


def range_counts(df: DataFrame, cuts: dict[str, np.ndarray], group: str | None = None) -> dict[str, np.ndarray]:
    """Per column ``counts[g, cell]`` for the two values of ``group`` (or one): cell ``2 i`` lies
    below cut i and above the one before, cell ``2 i + 1`` is the cut itself."""
    groups, names = 2 if group else 1, list(cuts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {c: np.zeros(groups * (2 * len(cuts[c]) + 1), np.int64) for c in names}
        for batch in batches:
            own = batch.column("__group").to_numpy().astype(np.int64)
            for c in names:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                known = ~np.isnan(values)
                values, width = values[known], 2 * len(cuts[c]) + 1
                place = np.searchsorted(cuts[c], values)
                equal = np.append(cuts[c], np.nan)[place] == values
                totals[c] += np.bincount(own[known] * width + 2 * place + equal, minlength=groups * width)
        for number, c in enumerate(names):
            cells = np.flatnonzero(totals[c])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), number, np.int32)), pa.array(cells), pa.array(totals[c][cells])],
                ["number", "cell", "n"],
            )

    found = _columns(df, names, group).mapInArrow(count, "number int, cell long, n long")
    out = {c: np.zeros((groups, 2 * len(cuts[c]) + 1), np.int64) for c in names}
    for number, cell, n in found.groupBy("number", "cell").agg(F.sum("n")).collect():
        out[names[number]].reshape(-1)[cell] = n
    return out


def value_counts(df: DataFrame, ranges: dict[str, list[tuple[float, float]]], group: str | None = None) -> dict[str, dict]:
    """``{value: counts per group}`` of the values strictly inside the ranges of each column."""
    groups, names = 2 if group else 1, list(ranges)
    bounds = {c: np.array(sorted(ranges[c]), np.float64).reshape(-1, 2) for c in names}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("__group").to_numpy()
            for number, c in enumerate(names):
                values, (low, high) = batch.column(c).to_numpy(zero_copy_only=False), bounds[c].T
                place = np.searchsorted(low, values) - 1
                inside = (place >= 0) & (values < np.append(high, np.nan)[place])
                for g in range(groups):
                    value, n = np.unique(values[inside & (own == g)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(value), number, np.int32)), pa.array(np.full(len(value), g, np.int32)),
                        pa.array(value, pa.float64()), pa.array(n, pa.int64()),
                    ], ["number", "g", "value", "n"])

    found = _columns(df, names, group).mapInArrow(count, "number int, g int, value double, n long")
    out: dict[str, dict] = {c: {} for c in names}
    for number, g, value, n in found.groupBy("number", "g", "value").agg(F.sum("n")).collect():
        out[names[number]].setdefault(value, [0] * groups)[g] = n
    return out


def _edges(cuts: np.ndarray) -> np.ndarray:
    return np.concatenate([[-np.inf], cuts, [np.inf]])


def order_statistics(df: DataFrame, shares: list[float], columns: list[str]) -> dict[str, list[float | None]]:
    """Quantiles of each column, interpolated between neighbours, by selection: the range that
    holds a position is cut finer until its value is a cut or its values are few."""
    cuts = first_cuts(df, columns)
    counts = {c: n[0] for c, n in range_counts(df, cuts).items()}
    total = {c: int(n.sum()) for c, n in counts.items()}
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    wanted = {}
    for c in columns:
        where = [(total[c] - 1) * s for s in shares] if total[c] else []
        wanted[c] = {int(p) for w in where for p in (np.floor(w), np.ceil(w))}
    # Rows below each open range, which is ``(low, high): (rows below, rows inside, positions)``.
    open_ranges: dict[str, dict] = {c: {} for c in columns}

    def settle(c: str, positions, below: int, edges: np.ndarray, cells: np.ndarray) -> None:
        upto = below + np.cumsum(cells)
        for p in positions:
            cell = int(np.searchsorted(upto, p, side="right"))
            if cell % 2:
                found[c][p] = float(edges[cell // 2 + 1])
            else:
                key = (float(edges[cell // 2]), float(edges[cell // 2 + 1]))
                start = int(upto[cell] - cells[cell])
                open_ranges[c].setdefault(key, (start, int(cells[cell]), set()))[2].add(p)

    for c in columns:
        settle(c, wanted[c], 0, _edges(cuts[c]), counts[c])
    while any(open_ranges.values()):
        left = {c: r for c, r in open_ranges.items() if r}
        if sum(rows for r in left.values() for _, rows, _ in r.values()) <= EXACT_ROWS:
            values = value_counts(df, {c: list(r) for c, r in left.items()})
            for c, r in left.items():
                for (low, high), (below, _, positions) in r.items():
                    own = sorted((v, n[0]) for v, n in values[c].items() if low < v < high)
                    upto = below + np.cumsum([n for _, n in own])
                    for p in positions:
                        found[c][p] = own[int(np.searchsorted(upto, p, side="right"))][0]
            break
        finer = {c: np.unique(np.concatenate([[x for x in key if np.isfinite(x)] + cuts_between(*key).tolist() for key in r])) for c, r in left.items()}
        again = {c: n[0] for c, n in range_counts(df, finer).items()}
        open_ranges = {c: {} for c in columns}
        for c, r in left.items():
            edges = _edges(finer[c])
            for (low, high), (below, _, positions) in r.items():
                a, b = np.searchsorted(edges, [low, high])
                # From the range above ``low`` to the one below ``high``, without both ends.
                settle(c, positions, below, edges[a : b + 1], again[c][2 * a : 2 * b - 1])
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for s in shares:
            if not total[c]:
                out[c].append(None)
                continue
            where = (total[c] - 1) * s
            low, high = found[c][int(np.floor(where))], found[c][int(np.ceil(where))]
            out[c].append(float(low + (high - low) * (where - np.floor(where))))
    return out


def largest_gap(df: DataFrame, columns: list[str], group: str) -> dict[str, float | None]:
    """Largest distance of the distribution functions of the two groups, per column. At cuts it
    is known; inside a range it is at most what it would be if one group's rows all came first.
    Only ranges where that exceeds the largest known distance are looked into."""
    cuts = first_cuts(df, columns)
    counts = range_counts(df, cuts, group)
    total = {c: n.sum(axis=1) for c, n in counts.items()}
    best: dict[str, float | None] = {c: 0.0 if total[c].all() else None for c in columns}
    open_ranges: dict[str, dict] = {c: {} for c in columns if total[c].all()}

    def settle(c: str, below: np.ndarray, edges: np.ndarray, cells: np.ndarray) -> None:
        """Look at the cells of neighbouring ranges from ``below`` rows of each group on."""
        upto = below[:, None] + np.cumsum(cells, axis=1)
        share = upto / total[c][:, None]
        # A range's own end says nothing yet: only what lies at a cut is a value's share.
        known = np.abs(share[0] - share[1])[1::2]
        best[c] = max(best[c], float(known.max(initial=0.0)))
        start = np.hstack([below[:, None], upto[:, :-1]])
        for i in range(0, cells.shape[1], 2):
            if cells[:, i].sum() > 0:
                a, b = start[:, i] / total[c], share[:, i]
                bound = max(b[0] - a[1], b[1] - a[0])
                open_ranges[c][(float(edges[i // 2]), float(edges[i // 2 + 1]))] = (start[:, i], int(cells[:, i].sum()), bound)

    for c in list(open_ranges):
        settle(c, np.zeros(2, np.int64), _edges(cuts[c]), counts[c])
    while True:
        left = {c: {k: r for k, r in own.items() if r[2] > best[c]} for c, own in open_ranges.items()}
        left = {c: r for c, r in left.items() if r}
        if not left:
            return best
        if sum(rows for r in left.values() for _, rows, _ in r.values()) <= EXACT_ROWS:
            values = value_counts(df, {c: list(r) for c, r in left.items()}, group)
            for c, r in left.items():
                for (low, high), (below, _, _) in r.items():
                    own = sorted((v, n) for v, n in values[c].items() if low < v < high)
                    upto = below[:, None] + np.cumsum(np.array([n for _, n in own]).T, axis=1)
                    share = upto / total[c][:, None]
                    best[c] = max(best[c], float(np.abs(share[0] - share[1]).max()))
            return best
        finer = {c: np.unique(np.concatenate([[x for x in key if np.isfinite(x)] + cuts_between(*key).tolist() for key in r])) for c, r in left.items()}
        again = range_counts(df, finer, group)
        open_ranges = {c: {} for c in left}
        for c, r in left.items():
            edges = _edges(finer[c])
            for (low, high), (below, _, _) in r.items():
                a, b = np.searchsorted(edges, [low, high])
                settle(c, below, edges[a : b + 1], again[c][:, 2 * a : 2 * b - 1])
