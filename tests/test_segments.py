"""Passes that go segment by segment give what one pass over the whole channel gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mainswatt.operators import lumps, signal
from mainswatt.sources import power

WHOLE = 10**15


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for site in ("a", "b"):
        for channel in (1, 2):
            us, p = 0, 100.0
            for _ in range(300):
                us += int(rng.choice([0, 0, 100_000, 400_000, 900_000, 5_000_000], p=[0.15, 0.05, 0.3, 0.3, 0.15, 0.05]))
                if rng.random() < 0.4:
                    p = float(rng.integers(0, 5) * 100)
                rows.append((site, channel, us, p, float(rng.integers(0, 4))))
    rows += [("c", 1, k * 1_000_000, 50.0 + 10 * k * k, 1.0) for k in range(40)]  # one state over many segments
    rows += [("d", 1, 5, 1.0, 1.0), ("e", 1, 5, 1.0, 1.0), ("e", 1, 5, 2.0, 1.0)]
    rows += [("f", 1, 7, None, 1.0), ("f", None, 7, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "site string, channel int, at long, active_power double, reactive_power double")
    return frame.withColumn("timestamp", F.timestamp_micros("at")).withColumn("order", F.monotonically_increasing_id()).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_equal(a, b):
    a, b = rows_of(a), rows_of(b)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, nan_ok=True) if all(isinstance(v, (int, float)) for v in x) else list(map(str, x[:2])) == list(map(str, y[:2])) and [v for v in x[2:] if v is not None] == pytest.approx([v for v in y[2:] if v is not None])


@pytest.mark.parametrize("span", [1_000_000, 7_000_000, power.SEGMENT_US])
def test_numbers_go_on_over_segments(samples, span):
    got = power.normalise(samples, "order", span=span)
    whole = samples.dropna().withColumn("idx", F.row_number().over(Window.partitionBy("site", "channel").orderBy("at", "order")).cast("long"))
    assert rows_of(got) == rows_of(whole.select("site", "channel", F.col("at").alias("us"), "idx", "active_power", "reactive_power"))
    assert got.filter("site = 'f'").count() == 0  # no reading without a channel or a power


@pytest.mark.parametrize("span", [500_000, 3_000_000])
def test_slopes_states_and_runs_go_on_over_segments(samples, span):
    held = signal.with_signal(power.normalise(samples, "order"))
    cut, whole = (signal.repaired(signal.slopes(held, s)) for s in (span, WHOLE))
    columns = ["site", "channel", "idx", "v1", "us1", "speed"]
    near_equal(cut.select(columns), whole.select(columns))
    near_equal(signal.states(cut).select("site", "channel", "idx", "state"), signal.states(whole).select("site", "channel", "idx", "state"))
    cut, whole = (signal.run_rows(power.normalise(samples, "order"), span=s) for s in (span, WHOLE))
    near_equal(cut, whole)
    long = cut.filter("site = 'c'").agg(F.max(F.col("us_past") - F.col("us_at"))).first()[0]
    assert long > 3 * span  # a run over several borders


def test_prefix_sums_go_on_over_segments(samples):
    held = power.normalise(samples, "order")
    near_equal(signal.prefix_sums(held, "active", "reactive", 800_000), signal.prefix_sums(held, "active", "reactive", WHOLE))
    edges = signal.falling_edges(held)
    near_equal(signal.consistent_edges(held, edges, 2, span=800_000).select("site", "channel", "start_idx", "flag", "h2"), signal.consistent_edges(held, edges, 2, span=WHOLE).select("site", "channel", "start_idx", "flag", "h2"))


@pytest.mark.parametrize("block", [3, 4, 1 << 16])
def test_neighbours_are_found_beyond_blocks(samples, block):
    held = power.normalise(samples, "order").select("site", "channel", "idx", "active_power")
    got = power.with_neighbours(held, {"a": ("active_power", 3), "b": ("active_power", -2), "c": ("idx", 0)}, block=block)
    w = Window.partitionBy("site", "channel").orderBy("idx")
    assert rows_of(got) == rows_of(held.withColumns({"a": F.lead("active_power", 3).over(w), "b": F.lag("active_power", 2).over(w), "c": F.col("idx")}))


def test_no_window_sees_a_whole_channel(samples):
    """Windows over samples or runs are within a segment or a block; those over a channel read one row a segment."""
    held = power.normalise(samples, "order")
    for frame in (signal.states(signal.repaired(signal.slopes(signal.with_signal(held)))), signal.falling_edges(held), signal.prefix_sums(held, "active", "reactive")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all(any(k in line for k in ("seg#", "__seg#", "__block#")) for line in windows)


def test_edges_meet_extents_by_size_class(spark):
    rng = np.random.default_rng(9)
    edges = [("a", 1, int(s), int(s + rng.integers(1, 40))) for s in rng.integers(0, 200_000, 400)]
    spans = [("a", 1, k, int(lo), int(lo + n)) for k, (lo, n) in enumerate(zip(rng.integers(0, 200_000, 60), rng.choice([5, 300, 5000, 70_000, 150_000], 60)))]
    spans += [("a", 2, 99, 0, 10**9), ("a", 1, 100, 50, 40)]
    got = lumps.within_extents(spark.createDataFrame(edges, "site string, channel int, start_idx long, end_idx long"), spark.createDataFrame(spans, "site string, channel int, lump_idx long, lo_idx long, hi_idx long"))
    want = sorted((*e, k) for e in edges for _, c, k, lo, hi in spans if c == 1 and e[2] >= lo and e[3] <= hi)
    assert sorted(map(tuple, got.select("site", "channel", "start_idx", "end_idx", "lump_idx").collect())) == want
