"""Operators on hand-made frames and planted waveforms, and every SQL-expressible query against DuckDB."""

import duckdb
import numpy as np
import pytest

from mainswatt.operators import energy, groups, lumps, signal, washer
from mainswatt.params import Rice, Washer
from mainswatt.plans import rice
from mainswatt.plans import washer as plan_washer
from mainswatt.queries import oracle_sql, queries
from mainswatt.sources import power

SF = "/root/testdata/sf0.001"
FEW = ["samples", "shift", "slope", "slope_repair", "state_runs", "falling_edges", "rising_edges", "edge_consistency", "edge_consistency_zero_sub", "contingency", "two_peaks", "washer_reliability", "lump_summary", "cell_summary", "particle_summary", "washer_power"]


def series(spark, values, us=None):
    rows = [("a", 1, (us[i] if us else i * 1_000_000), i + 1, float(v), 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, channel int, us long, idx long, active_power double, reactive_power double")


@pytest.mark.parametrize("name", FEW)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    theirs = sorted(con.sql("select " + ",".join(f'"{c}"' for c in columns) + f" from ({oracle_sql()[name]})").fetchall(), key=str)
    assert ours == theirs


def test_equal_times_are_repaired(spark):
    df = signal.repaired(signal.slopes(signal.with_signal(series(spark, [0, 1, 5, 6, 8], [0, 0, 1_000_000, 1_000_000, 2_000_000]))))
    assert [r.speed for r in df.orderBy("idx").collect()] == [4.0, 4.0, 3.0, 2.0, None]


def test_states_and_falling_edge(spark):
    samples = series(spark, [10, 10, 10, 2, 2, 2])
    runs = [(r.str, r.end, r.val) for r in signal.run_rows(samples).orderBy("str").collect()]
    assert runs == [(1, 1, 0), (2, 2, 2), (3, 3, 3), (4, 4, 1), (5, 5, 2)]
    (e,) = signal.falling_edges(samples).collect()
    assert (e.start_idx, e.end_idx, e.h1, e.h2, e.delta) == (3, 4, 0.0, -8.0, -8.0)


def test_signed_signal(spark):
    (e,) = signal.rising_edges(series(spark, [10, 10, 10, 2, 2, 2]), main="-active").collect()
    assert e.delta == -8.0


def test_equal_signals_leave_no_sub_columns(spark):
    samples = series(spark, [10, 10, 10, 2, 2, 2])
    assert "sub_delta" not in signal.falling_edges(samples, "active", "active").columns
    assert "sub_delta" in signal.falling_edges(samples, "active", "-active").columns


def test_contingency_of_too_many_zeros(spark):
    rows = series(spark, [1, -1, 0, 0, 2, -2, 3, -3]).withColumnRenamed("active_power", "x")
    assert [tuple(r)[3:] for r in washer.contingency(rows, "x", 4, 5).collect()] == [(3, 1, 2, 2)]
    assert [tuple(r)[3:] for r in washer.contingency(rows, "x", 4, 1).collect()] == [(0, 0, 0, 0)]
    assert [r.two_peaks for r in washer.peaks(washer.contingency(rows, "x", 4, 5), 0).collect()] == [True]


def test_frames_are_normalised(spark):
    df = spark.createDataFrame([(2, "2024-01-01 00:00:01", 5, 1.0), (2, "2024-01-01 00:00:00", 3, 2.0)], "channel long, timestamp string, active_power int, reactive_power double")
    assert [tuple(r) for r in power.normalise(df).orderBy("idx").collect()] == [("s0", 2, 1704067200000000, 1, 3.0, 2.0), ("s0", 2, 1704067201000000, 2, 5.0, 1.0)]


def test_hot_keys_are_split(spark):
    from mainswatt.sources import shared

    many = spark.range(5000).selectExpr("if(id < 4500, 0, id) k", "id v")
    one = spark.range(5000).selectExpr("id k", "id * 2 w")
    got = shared.join_split(many, one, "k", many.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n"), 5000)
    assert sorted(map(tuple, got.collect())) == sorted((0 if i < 4500 else i, i, 0 if i < 4500 else 2 * i) for i in range(5000))
    with shared.scratch(spark) as keep:
        gone, kept = shared.materialise(one), shared.materialise(many)
        keep.append(kept)
    import os
    assert kept.count() == 5000 and not os.path.exists(gone._shared_path)


def test_single_run_has_no_edges(spark):
    assert signal.falling_edges(series(spark, [1.0])).count() == 0


def test_lump_boundary(spark):
    df = spark.createDataFrame([("a", 1, i, t * 1_000_000) for i, t in enumerate([0, 3599, 7199])], "site string, channel int, start_idx long, start_us long")
    assert [r.lump_idx for r in lumps.sessionise(df, 3600.0).orderBy("start_idx").collect()] == [1, 1, 2]


def test_planted_cook(spark):
    home = power.planted(spark, "cook")
    edges = signal.falling_edges(home).cache()
    assert edges.count() == 78 and {(r.h2, r.sub_delta) for r in edges.collect()} == {(-1000.0, -15.0)}
    _, held = rice.candidates(edges, Rice())
    assert {(r.db_time, r.lump_idx, r["count"]) for r in held.groupBy("db_time", "lump_idx").count().collect()} == {(16.0, k, 25) for k in (1, 2, 3)}
    first = energy.cook_energy(home, held.filter("lump_idx = 1"), 10.0, 2400.0, 360.0).filter("edge_pos = 0").first()
    assert first.sec_on == 700.0 and round(first.start_time, 3) == 200.1 and round(first.end_time, 3) == 699.8 and round(first.wh_on, 2) == -194.44


def test_planted_warm(spark):
    home = power.planted(spark, "warm")
    edges = signal.falling_edges(home)
    got = energy.warm_energy(energy.warm_slots(home, edges, 10.0, 5.0)).first()
    assert (got.sec, got.watt) == (20.0, 400.0)


def test_planted_wash(spark):
    p = Washer()
    home = power.planted(spark, "wash")
    boxes = washer.flagged(washer.box_features(home, p.box), p)
    assert boxes.filter("flag = 1").count() == 112
    begun = washer.starts(washer.votes(boxes, p), p)
    (c,) = washer.cycles(begun, home, p).collect()
    assert (c.start_idx, c.end_idx) == (54900, 99900)


def test_walls_take_the_lower_of_equal_gaps():
    assert groups._walls(np.array([0.0, 1.0, 2.0, 9.0]), 2).tolist() == [0.5, 5.5]


def test_dip():
    rng = np.random.default_rng(2)
    two = np.r_[rng.normal(0, 1, 100), rng.normal(12, 1, 100)]
    assert washer.dip_p_value(two) < 0.05 < washer.dip_p_value(rng.normal(0, 1, 200))


def test_strict_slopes_fail_on_equal_times(spark):
    rows = [("a", 1, 1, 0, 1.0, 1.0), ("a", 1, 2, 10**6, 3.0, 1.0), ("a", 1, 3, 2 * 10**6, 2.0, 1.0)]
    frame = lambda r: spark.createDataFrame(r, "site string, channel int, idx long, us long, active_power double, reactive_power double")
    good = signal.strict(signal.slopes(signal.with_signal(frame(rows))))
    assert [r.speed for r in good.orderBy("idx").collect()] == [2.0, -1.0, None]
    with pytest.raises(Exception, match="one time"):
        signal.strict(signal.slopes(signal.with_signal(frame([*rows, ("a", 1, 4, 2 * 10**6, 5.0, 1.0)])))).collect()


def test_washer_config_states_every_field(spark):
    samples = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "site string, channel int")
    rows = plan_washer.meta(samples, end_delay=2000).collect()
    assert sorted((r.site, r.channel) for r in rows) == [("a", 1), ("a", 2)] and rows[0].config == rows[1].config
    assert rows[0].config.spin_dry.end_delay == 2000 and rows[0].config.active_power.min_usage == 50.0 and rows[0].config.generation_info.sampling_rate == 15
    assert plan_washer.force_meta(samples).first().config.generation_info.sampling_rate == 10
    with pytest.raises(ValueError, match="no such field"):
        plan_washer.meta(samples, endDelay=1)
