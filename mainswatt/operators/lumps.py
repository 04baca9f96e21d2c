"""Periods and sessions of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lost_signals
from ..sources.power import KEY


def _order(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("start_us", "start_idx")


def watt_band(edges: DataFrame, low: Column | float, high: Column | float, closed: bool = True) -> DataFrame:
    """Drops of ``low`` to ``high``. Here and below a bound is a number, or a column of the edges."""
    h = F.col("h2")
    return edges.filter(h.between(-high, -low) if closed else (h > -high) & (h < -low))


def envelope(edges: DataFrame, meta: DataFrame, ap_margin: float, rp_margin: float) -> DataFrame:
    """Edges within a meta's bounds and margins; ``meta`` has site, channel, min_h2, max_h2, min_sub, max_sub, one row a channel."""
    near = F.col("h2").between(F.col("min_h2") - ap_margin, F.col("max_h2") + ap_margin) & F.col("sub_delta").between(F.col("min_sub") - rp_margin, F.col("max_sub") + rp_margin)
    return edges.join(meta, list(KEY)).filter(near).select(*edges.columns)


def period_match(edges: DataFrame, db_times: Column | tuple[float, ...], tolerance: Column | float, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Both ends of every gap that fits a period, for each period: the edges with ``db_time``."""
    w = _order(keys)
    gaps = edges.withColumns({"gap": (F.col("start_us") - F.lag("start_us").over(w)) / 1e6, "next_gap": (F.lead("start_us").over(w) - F.col("start_us")) / 1e6})
    each = gaps.withColumn("db_time", F.explode(db_times if isinstance(db_times, Column) else F.array(*[F.lit(float(t)) for t in db_times])))
    fits = lambda c: F.coalesce(F.col(c).between(F.col("db_time") - tolerance, F.col("db_time") + tolerance), F.lit(False))
    return each.filter(fits("gap") | fits("next_gap")).drop("gap", "next_gap")


def sessionise(edges: DataFrame, gap: Column | float, keys: tuple[str, ...] = KEY) -> DataFrame:
    """``lump_idx`` from 1: a new lump begins where the gap to the edge before is ``gap`` seconds or more."""
    w = _order(keys)
    new = F.coalesce((F.col("start_us") - F.lag("start_us").over(w)) / 1e6 >= gap, F.lit(False))
    return edges.withColumn("lump_idx", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def summarise(lumps: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The measures of each lump."""
    by = (*keys, "lump_idx")
    gaps = lumps.withColumn("gap", (F.col("start_us") - F.lag("start_us").over(_order(by))) / 1e6)
    gaps = gaps.withColumn("lump_med", F.median("gap").over(Window.partitionBy(*by))).withColumn("lost", lost_signals("gap", "lump_med"))
    out = gaps.groupBy(*by).agg(
        F.count("*").alias("sum"), F.min("start_us").alias("lump_start"), F.max("end_us").alias("lump_end"),
        F.min("gap").alias("min_t"), F.first("lump_med").alias("med_t"), F.max("gap").alias("max_t"), F.percentile("gap", F.lit(0.05)).alias("q05"),
        F.median("h1").alias("med_h1"), F.min("delta").alias("min_d"), F.median("delta").alias("med_d"), F.max("delta").alias("max_d"), F.stddev_samp("delta").alias("sd_d"),
        F.median("sub_delta").alias("med_sub_d"), F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost_sig_num"),
    )
    return out.withColumns({
        "lump_duration": (F.col("lump_end") - F.col("lump_start")) / 1e6, "min_med_rate2": F.try_divide(F.col("q05"), F.col("med_t")),
        "lost_sig_rate": F.try_divide(F.col("lost_sig_num") * 100, F.col("sum") + F.col("lost_sig_num")),
    }).drop("q05")


def big_enough(lumps: DataFrame, size: Column | int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Lumps of at least ``size`` edges."""
    return lumps.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "lump_idx"))).filter(F.col("__n") >= size).drop("__n")


def extents(lumps: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return lumps.groupBy(*keys, "lump_idx").agg(F.min("start_idx").alias("lo_idx"), F.max("end_idx").alias("hi_idx"))


_CLASSES = tuple(1 << (8 * k) for k in range(5))
"""Widths of cells of indexes; an interval is filed in cells of the greatest width that is no longer than itself."""


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """``points`` with the columns of each of the ``spans`` of their keys with lo <= at <= hi (whole numbers from 0).

    A span is filed in the cells of its size class that it touches, 257 at most, and a point looks into its own cell of
    each class; so a span meets points of at most three times its length, and no more pairs are made.
    """
    length = F.col(hi) - F.col(lo) + 1
    size = F.lit(_CLASSES[0])
    for width in _CLASSES[1:]:
        size = F.when(length >= width, width).otherwise(size)
    filed = spans.filter(length > 0).withColumn("__width", size.cast("long"))
    filed = filed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / F.col("__width")), F.floor(F.col(hi) / F.col("__width")))))
    dealt = points.withColumn("__width", F.explode(F.array(*[F.lit(w).cast("long") for w in _CLASSES]))).withColumn("__cell", F.floor(F.col(at) / F.col("__width")))
    return dealt.join(filed, [*keys, "__width", "__cell"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("__width", "__cell")


def within_extents(edges: DataFrame, spans: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Edges inside a lump's first to last index, with the lump's number."""
    return interval_join(edges, spans, "start_idx", "lo_idx", "hi_idx", keys).filter(F.col("end_idx") <= F.col("hi_idx")).drop("lo_idx", "hi_idx")


def except_edges(edges: DataFrame, other: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges that the other table has not, by position, time and height; ``more`` columns follow from these."""
    columns = [*KEY, "start_idx", "end_idx", "start_us", "end_us", "h2", "sub_delta", *more]
    return edges.select(columns).subtract(other.select(columns))
