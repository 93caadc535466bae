"""Order statistics and distribution gaps next to numpy on all values."""

import numpy as np
import pytest

from punctual.functions import ranges


def columns(seed, n):
    draw = np.random.default_rng(seed)
    return {
        "even": draw.uniform(-5, 5, n), "tail": draw.lognormal(0, 12, n), "few": draw.integers(0, 4, n).astype(float),
        "one": np.full(n, -0.0), "mixed": np.where(draw.random(n) < 0.4, 7.5, draw.normal(0, 1e-9, n)),
        "wide": draw.choice([-1e300, 1e-300, 0.0, 2.0**53, 1.0], n),
    }


def frame(spark, values, group=None):
    names = list(values)
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) + ((bool(g),) if group is not None else ())
            for r, g in zip(zip(*values.values()), group if group is not None else range(len(values[names[0]])))]
    kind = ", ".join(f"{c} double" for c in names) + (", is_reference boolean" if group is not None else "")
    return spark.createDataFrame(rows, kind).repartition(5)


@pytest.fixture(params=[(4, 3, 0), (4, 3, 40), (512, 64, 100_000)])
def sizes(request, monkeypatch):
    for name, value in zip(("RANGES", "PARTS", "EXACT_ROWS"), request.param):
        monkeypatch.setattr(ranges, name, value)
    monkeypatch.setattr(ranges.first_cuts, "__defaults__", (request.param[0],))
    monkeypatch.setattr(ranges.cuts_between, "__defaults__", (request.param[1],))


def test_order_statistics(spark, sizes):
    values = columns(1, 400)
    values["gaps"] = np.where(np.arange(400) % 3 == 0, np.nan, values["even"])
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ranges.order_statistics(frame(spark, values), shares, list(values))
    for c, own in values.items():
        assert got[c] == pytest.approx(np.nanquantile(own, shares).tolist(), rel=1e-12, abs=0), c


def brute_gap(values, group):
    known = ~np.isnan(values)
    a, b = (np.sort(values[known & (group == g)]) for g in (True, False))
    at = np.unique(values[known])
    return np.abs(np.searchsorted(a, at, side="right") / len(a) - np.searchsorted(b, at, side="right") / len(b)).max()


@pytest.mark.parametrize("shift", [0.0, 0.4])
def test_largest_gap(spark, sizes, shift):
    values = columns(2, 400)
    group = np.random.default_rng(3).random(400) < 0.3
    values = {c: np.where(group, v, v + shift * (c != "wide")) for c, v in values.items()}
    values["gaps"] = np.where(np.arange(400) % 5 == 0, np.nan, values["even"])
    got = ranges.largest_gap(frame(spark, values, group), list(values), "is_reference")
    for c, own in values.items():
        assert got[c] == pytest.approx(brute_gap(own, group), abs=1e-12), c


def test_without_values(spark):
    df = spark.createDataFrame([(None, True), (None, False), (1.0, True)], "x double, is_reference boolean")
    assert ranges.largest_gap(df, ["x"], "is_reference") == {"x": None}
    assert ranges.order_statistics(df.filter("x is null"), [0.5], ["x"]) == {"x": [None]}
    assert ranges.order_statistics(df, [0.5], ["x"]) == {"x": [1.0]}


def test_cuts_close_in_on_any_value():
    for target in (0.0, -3.5, 1e-300, 12345.678, -1e300):
        low, high, rounds = -np.inf, np.inf, 0
        while True:
            cuts = ranges.cuts_between(low, high, 64)
            rounds += 1
            if target in cuts:
                break
            edges = np.concatenate([[low], cuts, [high]])
            i = np.searchsorted(edges, target)
            low, high = edges[i - 1], edges[i]
        assert rounds <= 16
