"""Whitening of vectors by eigenvectors in mixed precision.

Entries become whole numbers, so that counts and sums are exact. Every task adds up the products
of its centred vectors; only these sums, one matrix for all rows, reach the driver. There the
covariance is solved in float32, and its eigenvectors are corrected in the highest precision at
hand by the iteration of Ogita and Aishima, which needs matrix products only: from
``R = I - X'X`` and ``S = X'AX`` the correction ``E`` of ``X <- X + XE`` has

    E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i])   for separated eigenvalues,
    E[i, j] = R[i, j] / 2                                otherwise,

and the error is squared by each step. Eigenvalues closer than the error bound are a cluster:
their vectors span the right space, and inside it they are found by a small problem of their own,
shifted by the cluster's mean, so that its size is that of the differences to be told apart.

Nulls and edges: vectors that are null or hold null or non-finite entries give no rows. Rows with
the same id (or none) are separate. Vectors of different lengths are fitted apart, each length
as a list of its own; lengths are taken to be few. Directions without variance (up to
``NEGLIGIBLE`` of the whole) are no components: a single vector, or copies of one, give no rows, nor
does an empty table. ``deviation`` is null where it exceeds a long; an entry beyond 2^42 raises an
error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 8
#: Fixed values of the mapping to whole numbers.
SCALE, OFFSET = 1024, 100_000
#: Entries whose whole number a double holds exactly.
LARGEST_ENTRY = 2.0**42
#: Share of the variance below which a direction has none.
NEGLIGIBLE = 1e-10
MOST_STEPS = 30
HIGH = np.longdouble
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenvectors ------------------------------------------------------------
def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of the ascending values, a new list wherever two are further apart than the gap."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > gap) + 1)


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that are nearly orthonormal, made so: the error is squared."""
    return x + x @ (np.eye(x.shape[1], dtype=HIGH) - x.T @ x) / 2


def refine(matrix: np.ndarray, vectors: np.ndarray, most_steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of a symmetric matrix from approximate vectors."""
    a, x = matrix.astype(HIGH), vectors.astype(HIGH)
    one, norm = np.eye(len(a), dtype=HIGH), lambda m: float(np.linalg.norm(m.astype(float), 2))
    size, last = norm(a), np.inf
    for _ in range(most_steps):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        gap = 2 * (norm(s - np.diag(values)) + size * norm(r))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        step = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ step
        changed = norm(step)
        for own in clusters(values, gap):
            if len(own) > 1:
                # Shifted by its mean, the cluster's block is as small as its differences.
                part = x[:, own]
                middle = values[own].mean()
                block = part.T @ (a @ part) - middle * (part.T @ part)
                turn = np.linalg.eigh(((block + block.T) / 2).astype(float))[1].astype(HIGH)
                x[:, own] = part @ orthonormal(turn)
        if changed <= 4 * np.finfo(HIGH).eps or changed >= last and changed < 1e-15:
            break
        last = changed
    x = orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a covariance."""
    scale = max(float(np.trace(matrix)), np.finfo(float).tiny)
    scaled = matrix.astype(HIGH) / HIGH(scale)
    start = np.linalg.eigh(scaled.astype(np.float32))[1]
    values, vectors = refine(scaled, start)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    return (values[::-1] * HIGH(scale)).astype(float), vectors[:, ::-1].astype(float)


# --- passes over the rows ----------------------------------------------------
def _rows(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    own = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), own.alias("v")).filter(
        F.col("v").isNotNull() & finite
    )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of the vectors of one length."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("v")
        offsets = lists.offsets.to_numpy()
        values, starts, sizes = lists.values.to_numpy(), offsets[:-1], np.diff(offsets)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            entries = values[starts[own][:, None] + np.arange(size)]
            if np.abs(entries).max(initial=0) > LARGEST_ENTRY:
                raise ValueError("an entry is too large for a whole number")
            yield ids.take(pa.array(own)), np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and the sum of each dimension, exactly."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for _, x in _matrices(batches):
            n, sums = totals.get(x.shape[1], (0, 0))
            totals[x.shape[1]] = (n + len(x), sums + x.sum(axis=0))
        for size, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))],
                ["size", "n", "sums"],
            )

    found = rows.mapInArrow(add, "size int, n long, sums array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    added = found.select("size", "n", F.posexplode("sums").alias("place", "value")).groupBy("size", "place").agg(
        wide("n").alias("n"), wide("value").alias("value")
    )
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(added.collect()):
        out.setdefault(row.size, (int(row.n), []))[1].append(int(row.value))
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``: the whole part is taken off exactly, so no digits are lost."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], float) / n
    return (x - whole) - rest


def _products(rows: DataFrame, fits: dict, columns: int | None = None) -> dict[int, np.ndarray]:
    """For each length the sum over all vectors of ``y y'``, where y is the centred vector or, with
    ``columns``, that vector times the fit's weights and a one (which gives the sums of y)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, x in _matrices(batches):
            size = x.shape[1]
            if size not in fits:
                continue
            y = _centred(x, *fits[size][:2])
            if columns is not None:
                y = np.hstack([y @ fits[size][2], np.ones((len(y), 1))])
            totals[size] = totals.get(size, 0) + y.T @ y
        for size, total in totals.items():
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                ["size", "line", "cells"],
            )

    def total(key, group):
        cells = group.column("cells").combine_chunks()
        lines = cells.values.to_numpy()[cells.offsets[0].as_py() : cells.offsets[-1].as_py()].reshape(len(cells), -1)
        # One line per task, each of as many numbers as there are dimensions.
        return pa.table({
            "size": pa.array([key[0].as_py()], pa.int32()), "line": pa.array([key[1].as_py()], pa.int32()),
            "cells": pa.array([lines.astype(HIGH).sum(axis=0).astype(float).tolist()], pa.list_(pa.float64())),
        })

    kind = "size int, line int, cells array<double>"
    found = rows.mapInArrow(add, kind).groupBy("size", "line").applyInArrow(total, kind)
    out: dict[int, list] = {}
    for row in sorted(found.collect()):
        out.setdefault(row.size, []).append(row.cells)
    return {size: np.array(lines) for size, lines in out.items()}


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of ``(n x - S)^2`` per row, exactly; None beyond a long."""
    wide = max((max(abs(n * int(x.max()) - s), abs(n * int(x.min()) - s)) for s in sums), default=0) if x.size else 0
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and wide * wide * max(1, len(sums)) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (off * off).sum(axis=1)]


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. The last is measured on the whitened values of all rows."""
    rows = _rows(table, id_column, vector)
    sums = {size: fit for size, fit in _sums(rows).items()}
    fits = {}
    for size, products in _products(rows, sums).items():
        n, own = sums[size]
        covariance = (products + products.T) / (2 * n)
        values, vectors = eigenvectors(covariance)
        whole = float(np.trace(covariance))
        kept = int((values[:components] > NEGLIGIBLE * whole).sum())
        if kept:
            fits[size] = (n, own, vectors[:, :kept] / np.sqrt(values[:kept]), (values[:kept] / whole).tolist())
    errors = {}
    for size, products in _products(rows, fits, components).items():
        n = fits[size][0]
        mean = products[-1, :-1] / n
        errors[size] = float(np.abs(products[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WHITENED.split(", ")]
        for ids, x in _matrices(batches):
            if (size := x.shape[1]) not in fits:
                continue
            n, own, weights, explained = fits[size]
            found, k = _centred(x, n, own) @ weights, len(explained)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n)), pa.array(_deviations(x, n, own), pa.int64()).take(pa.array(rows)),
                pa.array(found.reshape(-1)), pa.array(np.tile(explained, len(x)), pa.float64()),
                pa.array(np.full(len(rows), errors[size])),
            ], names)

    return rows.mapInArrow(project, WHITENED)
