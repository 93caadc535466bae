"""Whitened vectors next to double-precision linear algebra on all rows at once."""

import numpy as np
import pytest

from punctual.llm import whitening

CLASHING = "vec_id long, embedding array<float>, v string, n string, whitened string, size string, component string"


def spectrum(values, seed=1):
    """A symmetric matrix with the given eigenvalues, and its eigenvectors."""
    random = np.random.default_rng(seed).normal(size=(len(values), len(values))).astype(whitening.HIGH)
    q = np.zeros_like(random)
    for j in range(len(values)):
        own = random[:, j]
        for _ in range(3):
            own = own - q[:, :j] @ (q[:, :j].T @ own)
        q[:, j] = own / np.sqrt(own @ own)
    values = np.array(values, whitening.HIGH)
    return (q * values) @ q.T, values, q


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40),
    [1.0] * 10 + [2.0] * 10,
    [1.0, 1 + 1e-9, 1 + 2e-9, 2.0, 2 + 1e-11, 3.0],
    [0.0] * 5 + [1e-9, 1.0, 1.0, 5.0],
    [7.0],
    np.repeat([1.0, 1 + 1e-8, 1.5], 12),
])
def test_refined_vectors(values):
    matrix, values, q = spectrum(values)
    start = np.linalg.eigh(matrix.astype(np.float32))[1]
    found, x = whitening.refine(matrix, start)
    size = float(np.abs(values).max())
    assert np.abs(np.sort(values) - found).max() <= 1e-17 * size * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17 * len(values)
    assert np.abs(matrix @ x - x * found).max() < 1e-17 * size * len(values)
    # Vectors of different eigenvalues, however close, are told apart.
    for i in range(len(values)):
        other = np.abs(found - values[i]) > 1e-12 * size
        gaps = np.abs(found - values[i])[other]
        assert (np.abs(q[:, i] @ x[:, other]) <= 1e-17 * len(values) * size / gaps).all()


def test_float32_alone_is_not_enough():
    matrix, values, _ = spectrum([1.0, 1 + 1e-9, 2.0, 4.0])
    start = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    assert np.abs(matrix @ start - start * np.diag(start.T @ matrix @ start)).max() > 1e-9


def brute(vectors, components):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, q = np.linalg.eigh(covariance)
    values, q = values[::-1], q[:, ::-1]
    keep = [i for i in range(min(components, len(values))) if values[i] > 1e-10 * np.trace(covariance)]
    return n, deviation, centred @ q[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(covariance)


def test_whiten(spark):
    random = np.random.default_rng(5)
    good = (random.normal(size=(300, 12)) * np.linspace(1, 3, 12)).tolist()
    good += good[:3]
    short = [[1.0, 2.0], [2.0, 2.5], [0.5, 0.25]]
    bad = [None, [None] * 12, [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("inf")], []]
    ids = [None if i == 7 else i for i in range(300)] + [0, 1, 2]
    rows = [*zip(ids, good), *zip(range(1000, 1003), short), *zip(range(2000, 2005), bad)]
    table = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], CLASHING).repartition(4)
    got = whitening.whiten(table).collect()
    n, deviation, whitened, explained = brute(good, 8)
    assert {r.component for r in got} == set(range(1, 9))
    own = [r for r in got if r.n == 303]
    assert len(own) == 303 * 8 and max(r.identity_error for r in got) < 1e-10
    by_id = {}
    for r in own:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = {c: np.sign(by_id[299, c + 1][0].whitened * whitened[299, c]) for c in range(8)}
    for i, vec_id in enumerate(ids):
        for c in range(8):
            for r in by_id[vec_id, c + 1]:
                assert r.deviation == deviation[i]
                assert abs(r.whitened - signs[c] * whitened[i, c]) < 1e-9
                assert abs(r.explained - explained[c]) < 1e-12
    assert sum(len(x) for x in by_id.values()) == len(own)
    two = [r for r in got if r.n == 3]
    n, deviation, whitened, explained = brute(short, 8)
    assert sorted({(r.vec_id, r.deviation) for r in two}) == list(zip(range(1000, 1003), deviation))
    assert len(two) == 3 * len(explained)


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], CLASHING)
    assert whitening.whiten(none).collect() == []
    one = spark.createDataFrame([(i, [1.0, 2.0], *["x"] * 5) for i in range(4)] + [(9, None, *["x"] * 5)], CLASHING)
    assert whitening.whiten(one).collect() == []


def test_entries_out_of_range(spark):
    rows = [(1, [1e30, 0.0], *["x"] * 5), (2, [0.0, 0.0], *["x"] * 5)]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame(rows, CLASHING)).collect()


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [5, 7]], np.int64)
    sums = [(1 << 40) + 5, 7]
    assert whitening._deviations(x, 2, sums) == [None if (v := sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums))) >= 1 << 63 else v for r in x]
    small = np.array([[5, 7], [1, 1]], np.int64)
    assert whitening._deviations(small, 2, [6, 8]) == [(10 - 6) ** 2 + (14 - 8) ** 2, 16 + 36]
