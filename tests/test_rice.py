"""The rice cooker's model and usage on the planted home, against figures derived by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mainswatt.operators import annihilation, energy, groups, washer
from mainswatt.params import Rice, Washer
from mainswatt.plans import rice
from mainswatt.sources import power, sinks
from mainswatt.sources.shared import materialise


@pytest.fixture(scope="module")
def home(spark):
    return materialise(power.homes(spark.createDataFrame([(k, k, 0.0) for k in ("cook", "warm", "extra", "keep")], "site string, kind string, more double")))


def test_train_and_predict(home):
    meta = rice.train(home)
    rows = {r.site: r for r in meta.collect()}
    assert set(rows) == {"cook", "warm", "extra", "keep"}
    cook, warm = rows["cook"], rows["warm"]
    assert (cook.general_info.Cook, cook.general_info.Warm) == (True, False)
    assert (warm.general_info.Cook, warm.general_info.Warm) == (False, True)
    c, w = cook.cook_info, warm.warm_info
    assert (c.lumps, c.min_flucs_proper_lump, c.db_time_sec, c.min_h2, c.max_sub) == (3, 25, 16.0, -1000.0, -15.0)
    assert c.usage_start_time == pytest.approx(200.1) and c.usage_end_time == pytest.approx(699.8)
    assert c.usage_sec_on == pytest.approx(700.0) and c.usage_wh_on == pytest.approx(-194.44444, abs=1e-4)
    assert (w.type, w.samples, w.lumps, w.db_time_sec, w.usage_sec_on, w.usage_watt) == (0, 150, 1, 60.0, 20.0, 400.0)
    k = rows["keep"].warm_info  # no period of the table fits its pulses; they follow cooking and never precede it
    assert (k.type, k.samples, k.lumps, k.min_h2, k.max_h2, k.db_time_sec, k.usage_sec_on, k.usage_watt) == (1, 60, 2, -400.0, -400.0, 0.0, 20.0, 400.0)
    assert rows["keep"].cook_info.proper_lumps == 2 and rows["extra"].warm_info.samples == 165
    assert cook.generation_info.data_used.start == "2024-01-01 00:00:00" and len(cook.generation_info.computed) == 19
    usage, known = rice.predict_all(home, meta)
    assert {r.site: (r["count"], round(r.confidence, 6), r.sampling_rate) for r in known.select("site", F.col("count").alias("count"), "confidence", "sampling_rate").collect()} == {"cook": (3, 0.6, 1.0), "warm": (0, 0.4, 1.0), "extra": (0, 0.4, 1.0), "keep": (2, 0.8, 1.0)}
    used = {r.site: r for r in usage.groupBy("site").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.count_if(F.col("p") > 0).alias("on")).collect()}
    assert used["cook"].n == used["warm"].n == 21600  # every second of six hours
    assert used["cook"].on == 3 * 900  # 200 + 700 seconds around each of three lumps
    assert used["cook"].p == pytest.approx(2700 * 194.44444 * 3600 / (200.1 + 699.8), rel=1e-6)  # painted seconds are whole, the rate is not rounded
    assert used["warm"].on == 150 * 20
    assert used["extra"].on == (150 + 15) * 20  # fifteen pulses lie off the period and come in by extension
    assert used["keep"].on == 2 * 900 + 60 * 20
    assert used["warm"].p == pytest.approx(150 * 20 * 400 * Rice().power_adjust)


@pytest.fixture(scope="module")
def models(home):
    return materialise(rice.train(home))


def test_nothing_found_gives_no_model_and_keeps_the_prior(spark, home, models):
    flat = home.filter("site = 'cook'").withColumns({"active_power": F.lit(100.0), "reactive_power": F.lit(20.0)}).filter("idx <= 3000")
    assert rice.train(flat).count() == 0
    prior = models.filter("site in ('cook', 'warm')")
    kept = {r.site: r.reliability for r in rice.train(flat, prior=prior).collect()}
    assert kept == {r.site: r.reliability for r in prior.collect()}  # the other site has no samples at all


def test_priors_compete_channel_by_channel(spark, home, models):
    """A home whose channel 1 keeps warm and whose channel 2 finds nothing: the prior stands in channel 2's place."""
    flat = home.filter("site = 'cook' and idx <= 3000").withColumns({"active_power": F.lit(100.0), "channel": F.lit(2)})
    named = lambda df, name: df.withColumn("site", F.lit(name))
    two = named(home.filter("site = 'warm'"), "h").unionByName(named(flat, "h"))
    prior = lambda site: named(models.filter(F.col("site") == site).withColumn("channel", F.lit(7)), "h")
    won = rice.train(two, prior=prior("cook")).collect()
    assert [(r.channel, r.general_info.Cook, r.general_info.Warm) for r in won] == [(7, True, False)]  # cooking beats warm, and the prior's channel stays
    lost = rice.train(named(home.filter("site = 'cook'"), "h").unionByName(named(flat, "h")), prior=prior("warm")).collect()
    assert [(r.channel, r.general_info.Cook) for r in lost] == [(1, True)]
    both = rice.train(named(home.filter("site = 'warm'"), "h"), prior=prior("cook")).collect()
    assert [(r.channel, r.general_info.Warm) for r in both] == [(1, True)]  # no channel fails, so no prior stands


def test_each_site_is_judged_by_its_own_parameters(home):
    own = Rice(db_times=(61.0,), db_tolerance=2.0)
    warm = home.filter("site = 'warm'")
    meta = rice.train(warm, own).unionByName(rice.train(home.filter("site = 'cook'")))
    assert {r.site: (r.db_times, r.parameter.db_tolerance) for r in meta.collect()} == {"warm": ([61.0], 2.0), "cook": (list(Rice().db_times), 0.4)}
    used = {r.site: r.on for r in rice.predict(home.filter("site in ('warm', 'cook')"), meta).groupBy("site").agg(F.count_if(F.col("p") > 0).alias("on")).collect()}
    assert used == {"warm": 3000, "cook": 2700}


def test_levels_follow_the_ends_of_intervals(spark):
    rng = np.random.default_rng(2)
    spans = {k: [(s, int(lo), int(lo + n)) for s, lo, n in zip(rng.choice(["a", "b"], 30), rng.integers(-500, 200_000, 30), rng.choice([-1, 0, 5, 900, 90_000], 30))] for k in ("x", "y")}
    bounds = {"a": (0, 180_000), "b": (86_399, 86_400), "c": (5, 5)}
    frame = lambda rows: spark.createDataFrame(rows, "site string, lo long, hi long")
    power_of = spark.createDataFrame([("a", 10.0, 0.5), ("b", 3.0, None)], "site string, x double, y double")
    got = rice.levels(frame([(s, *b) for s, b in bounds.items()]), {k: frame(v) for k, v in spans.items()}, power_of)
    value = {"a": (10.0, 0.5), "b": (3.0, 0.0), "c": (0.0, 0.0)}
    want = {s: np.zeros(hi - lo + 1) for s, (lo, hi) in bounds.items()}
    for k, name in enumerate(("x", "y")):
        for s, (lo, hi) in bounds.items():
            held = np.zeros(hi - lo + 1, bool)
            for site, a, b in spans[name]:
                if site == s and b >= a:
                    held[max(a - lo, 0) : max(b - lo + 1, 0)] = True
            want[s] += held * value[s][k]
    seen = {s: np.full(len(v), np.nan) for s, v in want.items()}
    for r in got.collect():
        assert np.isnan(seen[r.site][r.sec - bounds[r.site][0]])  # each second once
        seen[r.site][r.sec - bounds[r.site][0]] = r.p
    assert all((seen[s] == want[s]).all() for s in want)


def test_no_row_grows_to_more_than_a_day(spark):
    spans = spark.createDataFrame([(-5, 200_000), (7, 7), (9, 8)], "lo long, hi long")
    assert sorted(r.sec for r in power.seconds(spans).collect()) == sorted([*range(-5, 200_001), 7])


def test_slots_go_on_over_blocks(spark):
    rng = np.random.default_rng(6)
    watts = rng.integers(0, 60, 500).astype(float)
    marks = sorted(rng.choice(np.arange(1, 500), 25, replace=False).tolist())
    samples = spark.createDataFrame([("a", 1, k + 1, float(w)) for k, w in enumerate(watts)], "site string, channel int, idx long, active_power double")
    edges = spark.createDataFrame([("a", 1, int(m), float(watts[m - 1])) for m in marks + marks[:3]], "site string, channel int, end_idx long, end_v double")
    want = []
    for m, n in zip(marks, marks[1:]):
        over = [w - watts[m - 1] for w in watts[m:n] if w - watts[m - 1] > 5]
        want.append((m, len(over), pytest.approx(np.mean(over)) if over else None))
    for block in (7, 64, 1 << 14):
        got = energy.warm_slots(samples, edges, 10.0, 5.0, block=block).orderBy("slot").collect()
        assert [(r.slot, r.len, r.watt) for r in got] == want


def test_every_channel_has_a_confidence_and_distances_skip_what_is_missing(spark):
    rng = np.random.default_rng(7)
    n, length = 6, 2500
    watts = rng.integers(0, 9, n * length).astype(float)
    samples = spark.createDataFrame([("a", 1, k + 1, float(w)) for k, w in enumerate(watts)] + [("a", 2, k + 1, 1.0) for k in range(50)], "site string, channel int, idx long, active_power double")
    starts = [300 + k * length for k in range(n)]
    p = Washer(fs=1, span_min=(10, 30))
    cyc = spark.createDataFrame([("a", 1, s) for s in starts], "site string, channel int, start_idx long")
    got = {r.channel: (r["count"], r.confidence) for r in washer.reliability(samples, cyc, p).collect()}
    assert got[2] == (0, 0.5)
    full = np.full((n, 2401), np.nan)
    for k, s in enumerate(starts):
        for c in range(-600, 1801):
            if 1 <= s + c <= len(watts):
                full[k, c + 600] = watts[s + c - 1]
    z = (full - np.nanmean(full, axis=0)) / np.nanstd(full, axis=0, ddof=1)
    d = []
    for i in range(n):
        for j in range(i + 1, n):
            ok = ~np.isnan(z[i]) & ~np.isnan(z[j])
            d.append(np.sqrt(((z[i] - z[j])[ok] ** 2).sum() * 2401 / ok.sum()))
    q = np.quantile(d, [0.25, 0.75])
    assert got[1] == (n, pytest.approx((q[1] - q[0]) / (max(d) - min(d))))


def test_models_and_usage_survive_the_sinks(spark, home, tmp_path):
    meta = spark.createDataFrame([("a", 1, (1.5, None), "x")], "site string, channel int, cook_info struct<a:double,b:double>, meta_version string")
    sinks.write_models(meta, f"{tmp_path}/models")
    assert sinks.read_models(spark, f"{tmp_path}/models", meta.schema).collect() == meta.collect()
    assert sinks.model_json(meta).first().model == '{"site":"a","channel":1,"cook_info":{"a":1.5,"b":null},"meta_version":"x"}'
    sinks.write_usage(spark.createDataFrame([("a", 5, 1.0, 0.0)], "site string, sec long, p double, q double"), f"{tmp_path}/usage")
    assert spark.read.parquet(f"{tmp_path}/usage").filter("site = 'a'").count() == 1


def plain_search(pool, iterations, size, good, q):
    """The group search as it is stated: everything anew in each iteration."""

    def walls(x, n):
        x = np.sort(x)
        gap = np.diff(x)
        top = np.argsort(-gap, kind="stable")[:n]
        return np.sort((x[top] + x[top + 1]) / 2)

    r, number = 1, 0
    for _ in range(iterations):
        if len(pool) + 1 <= r or len(pool) < 2:
            return
        x, y = pool["delta"].to_numpy(float), pool["sub_delta"].to_numpy(float)
        pool = pool.assign(x_division=np.searchsorted(walls(x, r), x, "right"), y_division=np.searchsorted(walls(y, r), y, "right"))
        held = pool.groupby(["x_division", "y_division"])["delta"].transform("size")
        dropped = pool[held < size].groupby(["x_division", "y_division"]).ngroups
        pool = pool[held >= size]
        r = max(r - dropped, 1)
        if not len(pool):
            r += 1
            continue
        found = []
        for (xd, _), cell in pool.groupby(["x_division", "y_division"], sort=True):
            info = groups._times(cell["start_us"].to_numpy(), q)
            if xd != 0 and good(cell, info):
                found.append(cell)
                number += 1
                yield number, cell, info
        if found:
            pool = pool.drop(pd.concat(found).index)
        r = max(r - len(found) + 1, 1)


def test_search_finds_the_groups_of_the_plain_search():
    rng = np.random.default_rng(12)
    groups_found = 0
    for trial in range(60):
        n, rows = int(rng.integers(0, 250)), []
        for _ in range(int(rng.integers(1, 5))):  # periodic clusters, some on a grid with ties
            k, at, period = int(rng.integers(5, 40)), rng.integers(0, 50, 2) * 20, float(rng.choice([15, 30, 60]))
            noise = rng.normal(0, 1, (k, 2)).round(int(rng.integers(0, 3)))
            rows += [(at[0] + a, at[1] + b, int((t * period + rng.random()) * 1e6)) for t, (a, b) in enumerate(noise)]
        rows += [(float(a), float(b), int(t)) for a, b, t in zip(rng.integers(0, 1000, n), rng.integers(0, 1000, n), rng.integers(0, 10**10, n))]
        pool = pd.DataFrame(rows, columns=["delta", "sub_delta", "start_us"]).sort_values("start_us").reset_index(drop=True)
        good = lambda cell, info: 10 <= info["med_t"] <= 700 and info["min_med_rate2"] >= 0.2
        size, iterations = int(rng.integers(2, 9)), int(rng.choice([1, 20, 200]))
        got = [(k, cell.index.tolist(), info) for k, cell, info in groups.search(pool, iterations, size, good, 0.25)]
        want = [(k, cell.index.tolist(), info) for k, cell, info in plain_search(pool, iterations, size, good, 0.25)]
        assert [g[:2] for g in got] == [w[:2] for w in want] and repr([g[2] for g in got]) == repr([w[2] for w in want])
        groups_found += len(got)
    assert groups_found > 40


def test_cuts_at_the_median_take_the_lower_side():
    cell = pd.DataFrame({"delta": [1.0, 2.0, 3.0, 4.0, 5.0], "sub_delta": [0.0, 0.0, 0.0, 0.0, 0.0], "particle_position": [-1.0, 1.0, -1.0, 1.0, 1.0]})
    wide = cell.assign(sub_delta=[-9.0, -3.0, 0.0, -4.0, -5.0])
    assert annihilation._refine(cell, 3).equals(cell)  # too few anti-particles
    kept = annihilation._refine(wide, 1)
    # Medians 3 and -4. The proposal (1, -9) keeps what is above both: all but itself, at no cost.
    assert kept["delta"].tolist() == [2.0, 3.0, 4.0, 5.0]
    at_median = annihilation._refine(wide.iloc[1:].reset_index(drop=True).assign(delta=[2.0, 3.0, 3.0, 5.0], sub_delta=[-3.0, -1.0, -4.0, -5.0]), 1)
    # The one proposal (3, -1) stands at the median 3: below it, and below -1, only (2, -3) stays.
    assert at_median["delta"].tolist() == [2.0]
