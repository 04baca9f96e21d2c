"""Washing cycles: box features, votes, starts, power above the baseline, reliability."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import percentiles
from ..params import Washer
from ..sources.power import KEY
from ..sources.shared import materialise


def box_features(samples: DataFrame, size: int) -> DataFrame:
    """Per complete box of ``size`` rows: the spread of both powers (20 to 80 per cent), reactive modes and range."""
    boxes = samples.withColumn("b", F.floor((F.col("idx") - 1) / size).cast("long"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = boxes.groupBy(*KEY, "b").agg(
        F.count("*").alias("n"), F.max("idx").alias("last_idx"), (q("active_power", 0.8) - q("active_power", 0.2)).alias("ap_diff"), (q("reactive_power", 0.8) - q("reactive_power", 0.2)).alias("rp_diff"),
        F.countDistinct(F.bround("reactive_power", -1)).alias("modes"), F.min("reactive_power").alias("rp_min"), F.max("reactive_power").alias("rp_max"),
    )
    return out.filter(F.col("n") == size).drop("n")


def dip_statistic(x: np.ndarray) -> float:
    """Hartigans' dip: the least largest distance of the empirical distribution from a unimodal one.

    For every interval of the sorted sample as modal interval the distribution is convex before (greatest convex
    minorant) and concave after (least concave majorant); the modal interval shrinks until it stands.
    """
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 1 / (2 * n) if n else 0.0

    def hull(lo: int, hi: int, convex: bool) -> list[int]:
        out: list[int] = []
        for i in range(lo, hi + 1):
            while len(out) > 1:
                a, b = out[-2], out[-1]
                turn = (x[b] - x[a]) * (i - b) - (b - a) * (x[i] - x[b])
                if turn <= 0 if convex else turn >= 0:
                    out.pop()
                else:
                    break
            out.append(i)
        return out

    def line(knots: list[int], i: np.ndarray) -> np.ndarray:
        kx, ky = x[knots], np.array(knots, float)
        return np.interp(x[i], kx, ky)

    lo, hi, dip = 0, n - 1, 1.0
    while True:
        below, above = hull(lo, hi, True), hull(lo, hi, False)
        at = np.unique(np.r_[below, above])
        gap = line(above, at) - line(below, at)
        far = int(gap.argmax())
        d = float(gap[far])
        if d <= dip:
            break
        spot = at[far]
        left = max(k for k in below if k <= spot)
        right = min(k for k in above if k >= spot)
        if left >= right:
            left, right = max(k for k in above if k <= spot), min(k for k in below if k >= spot)
        for knots, part, convex in ((below, [k for k in below if k <= left], True), (above, [k for k in above if k >= right], False)):
            for a, b in zip(part[:-1], part[1:]):
                i = np.arange(a, b + 1)
                if x[b] > x[a]:
                    slope = a + (x[i] - x[a]) * (b - a) / (x[b] - x[a])
                    dip = max(dip, float((i + 1 - slope).max() if convex else (slope - i + 1).max()))
        if (left, right) == (lo, hi):
            break
        lo, hi = left, right
        if hi - lo < 1:
            break
    return dip / (2 * n)


@lru_cache(maxsize=16)
def _null_dips(n: int, draws: int = 400) -> tuple[float, ...]:
    rng = np.random.default_rng(17)
    return tuple(sorted(dip_statistic(rng.random(n)) for _ in range(draws)))


def dip_p_value(x: np.ndarray) -> float:
    """Share of uniform samples of the same size with a larger dip (seeded simulation)."""
    null = _null_dips(len(x))
    return float(1 - np.searchsorted(null, dip_statistic(x), "left") / len(null))


def dip_test(samples: DataFrame, size: int) -> DataFrame:
    """site, channel, b, dip, p_val of the reactive power of each complete box."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [np.array(x) for x in batch.column("x").to_pylist()]
            out = {c: batch.column(c) for c in (*KEY, "b")}
            yield pa.RecordBatch.from_pydict(out | {"dip": pa.array([dip_statistic(x) for x in boxes], pa.float64()), "p_val": pa.array([dip_p_value(x) for x in boxes], pa.float64())})

    boxes = samples.groupBy(*KEY, F.floor((F.col("idx") - 1) / size).cast("long").alias("b")).agg(F.collect_list("reactive_power").alias("x"))  # at most ``size`` each
    return boxes.filter(F.size("x") == size).mapInArrow(test, "site string, channel int, b long, dip double, p_val double")


def flagged(features: DataFrame, p: Washer = Washer()) -> DataFrame:
    """``flag``: the box looks like washing. Features without p_val are judged on the other conjuncts."""
    ok = (F.col("ap_diff") > p.ap_range[0]) & (F.col("ap_diff") < p.ap_range[1]) & (F.col("rp_diff") > p.rp_range[0]) & (F.col("rp_diff") < p.rp_range[1]) & F.col("modes").between(*p.modes)
    if "p_val" in features.columns:
        ok = ok & (F.coalesce("p_val", F.lit(0.0)) <= p.dip_p)
    return features.withColumn("flag", ok.cast("int"))


def votes(boxes: DataFrame, p: Washer = Washer()) -> DataFrame:
    """Every ``vote_step``-th box at which more than ``vote_over`` of the last ``vote_boxes`` are flagged."""
    w = Window.partitionBy(*KEY).orderBy("b").rowsBetween(1 - p.vote_boxes, 0)
    out = boxes.withColumn("vote", F.sum("flag").over(w))
    place = F.col("b") + 1
    return out.filter((place >= p.vote_boxes) & (place % p.vote_step == 0) & (F.col("vote") > p.vote_over)).select(*KEY, "b", "last_idx", "vote")


def starts(voted: DataFrame, p: Washer = Washer()) -> DataFrame:
    """Cycle starts: voted rows moved back by three kernels; of more than two, only those far from the one before."""
    first = F.greatest(F.col("last_idx") - 3 * p.kernel * p.fs, F.lit(p.box))
    w = Window.partitionBy(*KEY)
    rows = voted.select(*KEY, first.cast("long").alias("start_idx")).withColumns({"n": F.count("*").over(w), "before": F.lag("start_idx").over(w.orderBy("start_idx"))})
    keep = (F.col("n") <= 2) | F.col("before").isNull() | (F.col("start_idx") - F.col("before") > 30 * 60 * p.fs)
    return rows.filter(keep).select(*KEY, "start_idx")


def cycles(begun: DataFrame, samples: DataFrame, p: Washer = Washer()) -> DataFrame:
    """start_idx, end_idx of cycles that end within the channel."""
    size = samples.groupBy(*KEY).agg(F.max("idx").alias("n"))
    return begun.withColumn("end_idx", F.col("start_idx") + p.end_delay * p.fs).join(size, list(KEY)).filter("end_idx <= n").drop("n")


def calendar(begun: DataFrame, samples: DataFrame) -> DataFrame:
    at = begun.join(samples.select(*KEY, F.col("idx").alias("start_idx"), F.timestamp_micros("us").alias("t")), [*KEY, "start_idx"])
    return at.select(*KEY, "start_idx", F.hour("t").alias("hour"), F.dayofmonth("t").alias("day"), F.month("t").alias("month"), F.dayofweek("t").alias("weekday"))


def block_center(samples: DataFrame, size: int, q: float = 0.01) -> DataFrame:
    """Active power less its block's mean (x_mean) and less its block's low quantile (x_low), and the block's variance."""
    b = samples.withColumn("block", F.floor((F.col("idx") - 1) / size).cast("long"))
    w = Window.partitionBy(*KEY, "block")
    ap = F.col("active_power")
    return b.select(*KEY, "idx", "block", (ap - F.avg("active_power").over(w)).alias("x_mean"), F.var_samp("active_power").over(w).alias("x_var"), (ap - F.percentile("active_power", F.lit(q)).over(w)).alias("x_low"))


def washer_power(samples: DataFrame, cyc: DataFrame, p: Washer = Washer()) -> DataFrame:
    """p and q of every sample: within a cycle, active power over its block's baseline and reactive power; else 0. Later cycles win."""
    span = p.end_delay * p.fs
    spread = cyc.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_idx") / span), F.floor(F.col("end_idx") / span))))
    rows = samples.select(*KEY, "idx", "us", "active_power", "reactive_power", F.floor(F.col("idx") / span).alias("bucket"))
    met = rows.join(spread, [*KEY, "bucket"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    met = met.withColumn("block", F.floor((F.col("idx") - F.col("start_idx")) / (p.block_sec * p.fs)))
    low = F.percentile("active_power", F.lit(p.quantile)).over(Window.partitionBy(*KEY, "start_idx", "block"))
    met = met.withColumn("p", F.greatest(F.col("active_power") - low, F.lit(0.0)))
    last = met.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "idx").orderBy(F.desc("start_idx")))).filter("r = 1")
    out = samples.select(*KEY, "idx", "us").join(last.select(*KEY, "idx", "p", F.col("reactive_power").alias("q")), [*KEY, "idx"], "left")
    return out.withColumns({"p": F.coalesce("p", F.lit(0.0)), "q": F.coalesce("q", F.lit(0.0))})


def channel_sum(usage: DataFrame) -> DataFrame:
    """p and q of a site at each time, summed over channels; a channel without the time adds nothing."""
    return usage.groupBy("site", "us").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def contingency(rows: DataFrame, name: str, size: int, most_zeros: int = 500) -> DataFrame:
    """Signs of a centred column in each segment of ``size`` rows and the next: segment, neg_1, pos_1, neg_2, pos_2.

    Values of zero or less count as negative. Where either segment has more than ``most_zeros`` zeros all counts are 0.
    """
    x = F.col(name)
    each = rows.withColumn("segment", (F.floor((F.col("idx") - 1) / size) + 1).cast("long"))
    each = each.groupBy(*KEY, "segment").agg(F.count_if(x <= 0).alias("neg"), F.count_if(x > 0).alias("pos"), F.count_if(x == 0).alias("zero"))
    w = Window.partitionBy(*KEY).orderBy("segment")
    both = each.withColumns({f"{c}_2": F.lead(c).over(w) for c in ("neg", "pos", "zero")}).filter("neg_2 is not null")
    flat = F.greatest("zero", "zero_2") > most_zeros
    count = lambda c: F.when(flat, 0).otherwise(F.col(c)).cast("long")
    return both.select(*KEY, "segment", count("neg").alias("neg_1"), count("pos").alias("pos_1"), count("neg_2").alias("neg_2"), count("pos_2").alias("pos_2"))


def peaks(tables: DataFrame, least: int) -> DataFrame:
    """``two_peaks``: whether both signs occur more than ``least`` times in both segments."""
    return tables.withColumn("two_peaks", F.least("neg_1", "neg_2", "pos_1", "pos_2") > least)


COLUMNS = 1024
"""Places of a cycle in one product."""
TILE = 1024
"""Cycles in a tile, about; all pairs of two tiles are one task."""
TILE_VALUES = 1 << 23
"""Values of a tile, about: cycles of more places make smaller tiles."""


def _dense(places: int):
    """Packs a cycle's places and values into the doubles of all places, NaN where it has none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("held"):
                v = np.full(places, np.nan)
                v[row.values.field("col").to_numpy()] = row.values.field("z").to_numpy(zero_copy_only=False)
                out.append(v.tobytes())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (*KEY, "tiles", "start_idx")} | {"z": pa.array(out, pa.binary())})

    return pack


def _tile_distances(places: int):
    """The distances of the pairs of two tiles ``a`` and ``b`` (or of one) over the places that both cycles have.

    Three matrix products a block of places: squares by presence, presence by squares, values by values.
    """

    def tile(table: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray]:
        rows = table.filter(pa.compute.equal(table.column("tile"), number))
        z = [np.frombuffer(x.as_buffer(), float) for x in rows.column("z")]
        return rows.column("start_idx").to_numpy(), np.array(z).reshape(len(z), places)

    def distances(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        start, left = tile(table, a)
        other, right = (start, left) if a == b else tile(table, b)
        sums, both = np.zeros((2, len(start), len(other)))
        for lo in range(0, places, COLUMNS):
            x, y = left[:, lo : lo + COLUMNS], right[:, lo : lo + COLUMNS]
            p, q = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            sums += (x * x) @ q.T + p @ (y * y).T - 2 * (x @ y.T)
            both += p @ q.T
        i, j = np.nonzero(both)
        if a == b:
            i, j = i[start[i] < start[j]], j[start[i] < start[j]]
        d = np.sqrt(np.maximum(sums[i, j], 0) * places / both[i, j])
        one = lambda c: pa.repeat(table.column(c)[0], len(i))
        return pa.table({"site": one("site"), "channel": one("channel"), "i": np.minimum(start[i], other[j]), "j": np.maximum(start[i], other[j]), "d": d})

    return distances


def cycle_distances(samples: DataFrame, cyc: DataFrame, before: int, after: int, tile: int = TILE) -> DataFrame:
    """site, channel, i, j (start indexes, i before j), d: distance of standardised cycles over the places both have, scaled to all places.

    Places are standardised over all cycles of the channel; one without spread is missing. A channel's cycles are dealt to tiles, and a
    task takes the pairs of two tiles, whatever the number of cycles; a cycle is sent once to each tile of its channel.
    """
    span = before + after
    tile = max(1, min(tile, TILE_VALUES // (span + 1)))
    number = cyc.groupBy(*KEY).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    spread = cyc.select(*KEY, "start_idx").join(F.broadcast(number), list(KEY))  # one row a channel
    spread = spread.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start_idx") - before) / span), F.floor((F.col("start_idx") + after) / span))))
    rows = samples.select(*KEY, "idx", "active_power", F.floor(F.col("idx") / span).alias("bucket"))
    met = rows.join(spread, [*KEY, "bucket"]).filter(F.col("idx").between(F.col("start_idx") - before, F.col("start_idx") + after))
    met = met.select(*KEY, "start_idx", "tiles", (F.col("idx") - F.col("start_idx") + before).cast("int").alias("col"), "active_power")
    level = met.groupBy(*KEY, "col").agg(F.avg("active_power").alias("mean"), F.stddev_samp("active_power").alias("sd")).filter("sd > 0")
    z = met.join(level, [*KEY, "col"]).withColumn("z", (F.col("active_power") - F.col("mean")) / F.col("sd"))
    held = z.groupBy(*KEY, "tiles", "start_idx").agg(F.collect_list(F.struct("col", "z")).alias("held"))
    packed = held.mapInArrow(_dense(span + 1), "site string, channel int, tiles int, start_idx long, z binary").withColumn("tile", F.pmod(F.xxhash64("start_idx"), F.col("tiles")).cast("int"))
    dealt = packed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*KEY, F.least("tile", "__other").alias("a"), F.greatest("tile", "__other").alias("b"), "tile", "start_idx", "z")
    return dealt.groupBy(*KEY, "a", "b").applyInArrow(_tile_distances(span + 1), "site string, channel int, i long, j long, d double")


def reliability(samples: DataFrame, cyc: DataFrame, p: Washer = Washer()) -> DataFrame:
    """count and confidence of every channel of the samples: 0.5 below three cycles; else the interquartile range of the distances between standardised cycles over their range."""
    d = cycle_distances(samples, cyc, p.span_min[0] * 60 * p.fs, p.span_min[1] * 60 * p.fs)
    # Pairs are many: no task holds a channel's distances.
    score = percentiles(materialise(d.select(*KEY, "d")), "d", (0.25, 0.75)).select(*KEY, F.try_divide(F.col("p1") - F.col("p0"), F.col("hi") - F.col("lo")).alias("score"))
    count = samples.select(*KEY).distinct().join(cyc.groupBy(*KEY).agg(F.count("*").alias("count")), list(KEY), "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return count.join(score, list(KEY), "left").select(*KEY, "count", F.when(F.col("count") >= 3, F.col("score")).otherwise(F.lit(0.5)).alias("confidence"))
