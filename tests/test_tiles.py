"""Distances of many cycles by tiles, and percentiles of many values."""

import numpy as np
import pytest

from mainswatt.functions.columns import percentiles
from mainswatt.operators import washer

SCHEMA = "site string, channel int, idx long, active_power double"


def test_tiles_hold_a_part_of_a_channels_cycles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    watts = rng.integers(0, 9, 400).astype(float)
    watts[::10] = 0.1  # one place of all cycles has no spread
    samples = spark.createDataFrame([("a", 1, k + 1, float(w)) for k, w in enumerate(watts)], SCHEMA)
    starts = list(range(1, 401, 10))
    cyc = spark.createDataFrame([("a", 1, s) for s in starts], "site string, channel int, start_idx long")
    sizes = spark.sparkContext.accumulator(0)
    make = washer._tile_distances

    def counted(places):
        tile = make(places)

        def f(table):
            assert table.num_rows < 20  # of 40 cycles
            sizes.add(1)
            return tile(table)

        return f

    monkeypatch.setattr(washer, "_tile_distances", counted)
    got = {(r.i, r.j): r.d for r in washer.cycle_distances(samples, cyc, 3, 12, tile=4).collect()}
    assert sizes.value > 10
    full = np.array([[watts[s + c - 1] if 1 <= s + c <= 400 else np.nan for c in range(-3, 13)] for s in starts])
    sd = np.nanstd(full, axis=0, ddof=1)
    z = np.where(sd > 1e-9, (full - np.nanmean(full, axis=0)) / np.where(sd > 1e-9, sd, 1), np.nan)
    want = {}
    for i in range(len(starts)):
        for j in range(i + 1, len(starts)):
            ok = ~np.isnan(z[i]) & ~np.isnan(z[j])
            want[starts[i], starts[j]] = np.sqrt(((z[i] - z[j])[ok] ** 2).sum() * 16 / ok.sum())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    held = {1: rng.random(1000), 2: np.r_[np.full(300, 2.0), 1e9], 3: np.array([4.0]), 4: np.repeat([1.0, 2.0, 7.0], [5, 3, 4])}
    rows = spark.createDataFrame([("a", c, float(v)) for c, x in held.items() for v in x] + [("a", 5, None)], "site string, channel int, v double")
    got = {r.channel: (r.lo, r.hi, r.p0, r.p1) for r in percentiles(rows, "v", (0.25, 0.75), bins=8).collect()}
    assert got.keys() == held.keys()
    for c, x in held.items():
        assert got[c] == pytest.approx((x.min(), x.max(), *np.quantile(x, [0.25, 0.75])))
