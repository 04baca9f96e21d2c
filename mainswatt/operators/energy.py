"""Energy of cooking and of keeping warm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.power import KEY


def lump_ends(lumps: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """First and last edge of each lump (edge_pos 0 and 1; both the same edge in a lump of one) and the middle of their end times."""
    by = (*keys, "lump_idx")
    w = Window.partitionBy(*by)
    up, down = w.orderBy("start_us", "start_idx"), w.orderBy(F.desc("start_us"), F.desc("start_idx"))
    marked = lumps.withColumns({"a": F.row_number().over(up) == 1, "z": F.row_number().over(down) == 1}).filter("a or z")
    both = marked.withColumn("edge_pos", F.explode(F.filter(F.array(F.when(F.col("a"), 0), F.when(F.col("z"), 1)), lambda x: x.isNotNull())))
    return both.withColumn("mid_us", F.avg("end_us").over(w.partitionBy(*by))).drop("a", "z")


def validity(energy: DataFrame, sizes: DataFrame, min_on: float, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Metrics of each candidate (``keys``): of all its lumps' ends and of the proper ones, on for ``min_on`` seconds or more.

    ``energy`` is that of cooking, ``sizes`` has keys, lump_idx and sig, the edges of a lump. A candidate without a proper end has zeros
    and nulls for these. Each lump has two ends, so ``lumps`` and ``proper_lumps`` are halves of the counts.
    """
    rows = energy.join(sizes, [*keys, "lump_idx"])
    of = lambda c: F.when(F.col("sec_on") >= min_on, F.col(c))
    return rows.groupBy(*keys).agg(
        F.min("sig").alias("least_sig"), F.count("*").alias("ends"), F.count(of("sig")).alias("proper_ends"), (F.count("*") / 2).alias("lumps"), (F.count(of("sig")) / 2).alias("proper_lumps"),
        F.coalesce(F.min(of("sig")), F.lit(0)).alias("min_flucs_proper_lump"), F.coalesce(F.max(of("sig")), F.lit(0)).alias("max_flucs_proper_lump"),
        F.median(of("start_time")).alias("usage_start_time"), F.median(of("end_time")).alias("usage_end_time"), F.median(of("sec_on")).alias("usage_sec_on"), F.stddev_samp(of("sec_on")).alias("sd_sec_on"),
        F.median(of("wh_on")).alias("usage_wh_on"), F.median(of("ap_on")).alias("usage_ap_on"),
    )


BUCKET_US = 600_000_000
"""Width of the time buckets in which edges meet the samples around them."""


def cook_energy(samples: DataFrame, lumps: DataFrame, hz: Column | float, max_sec: Column | float, island_gap: Column | float, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Two rows per lump: how long power stayed above half way down the edge around it, and its energy (negative).

    The half way level is that of the edge's own ends (``start_v``, ``end_v``), so samples are read once: they meet an
    edge in the time buckets that its window touches. ``hz``, ``max_sec`` and ``island_gap`` are numbers or columns of the lumps.
    """
    by = [*keys, "lump_idx", "edge_pos"]
    value = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    span = (value(max_sec) * 1e6).cast("long")
    ends = lump_ends(lumps, keys).select(*by, "end_us", "mid_us", "h2", ((F.col("start_v") + F.col("end_v")) / 2).alias("thr"), value(hz).alias("hz"), span.alias("span"), value(island_gap).alias("island_gap"))
    bucket = lambda t: F.floor(t / BUCKET_US)
    spread = ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("end_us") - F.col("span")), bucket(F.col("end_us") + F.col("span")))))
    rows = samples.select(*KEY, "us", F.col("active_power").alias("ap"), bucket(F.col("us")).alias("bucket"))
    met = spread.join(rows, [*KEY, "bucket"]).filter(F.col("us").between(F.col("end_us") - F.col("span"), F.col("end_us") + F.col("span")) & (F.col("ap") >= F.col("thr")))
    w = Window.partitionBy(*by).orderBy("us")
    new = F.coalesce((F.col("us") - F.lag("us").over(w)) / 1e6 >= F.col("island_gap"), F.lit(False))
    met = met.withColumn("island", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isle = met.groupBy(*by, "island").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), *[F.first(c).alias(c) for c in ("mid_us", "h2", "hz")])
    every = Window.partitionBy(*by)
    isle = isle.withColumns({"total": F.sum("n").over(every), "all_lo": F.min("lo").over(every), "all_hi": F.max("hi").over(every), "rank": F.row_number().over(every.orderBy(F.desc(F.col("hi") - F.col("lo")), "island"))})
    best = isle.filter("rank = 1").withColumn("sec_on", F.col("total") / F.col("hz"))
    whole = (F.col("hi") - F.col("lo")) / 1e6 < F.col("sec_on")
    lo, hi = F.when(whole, F.col("all_lo")).otherwise(F.col("lo")), F.when(whole, F.col("all_hi")).otherwise(F.col("hi"))
    return best.select(*by, ((F.col("mid_us") - lo) / 1e6).alias("start_time"), ((hi - F.col("mid_us")) / 1e6).alias("end_time"), "sec_on", (F.col("sec_on") * F.col("h2") / 3600).alias("wh_on"), F.col("h2").alias("ap_on"))


def warm_slots(samples: DataFrame, edges: DataFrame, hz: float, ignore: float, keys: tuple[str, ...] = KEY, block: int = 1 << 14) -> DataFrame:
    """Per slot between consecutive edges' ends: samples over the slot's first power by more than ``ignore``, seconds, watt-seconds.

    An as-of merge: a mark for each slot, with the power at it (``end_v`` of its edge), goes into every block of indexes
    that the slot touches, samples into the one they lie in; in order of index, a sample belongs to the last mark before it.
    Samples are read once, and a block holds ``block`` of them at most.
    """
    w = Window.partitionBy(*keys).orderBy("end_idx")
    slots = edges.groupBy(*keys, "end_idx").agg(F.first("end_v").alias("base")).withColumn("next_idx", F.lead("end_idx").over(w)).filter("next_idx is not null")
    first = lambda c: F.floor(F.col(c) / block)
    spread = slots.withColumn("block", F.explode(F.sequence(F.floor((F.col("end_idx") + 1) / block), first("next_idx"))))
    marks = spread.select(*keys, "block", F.greatest(F.col("end_idx"), F.col("block") * block - 1).alias("at"), F.col("end_idx").alias("slot"), "base", "next_idx", F.lit(None).cast("double").alias("ap"))
    wanted = spread.select(*keys, "block").distinct()
    rows = samples.select(*KEY, first("idx").alias("block"), F.col("idx").alias("at"), F.col("active_power").alias("ap"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("slot", "long"), ("base", "double"), ("next_idx", "long"))]
    read = rows.join(wanted, [*KEY, "block"]).select(*keys, "block", "at", *none, "ap")
    # At one index the sample comes first: it still belongs to the slot before.
    order = Window.partitionBy(*keys, "block").orderBy("at", F.col("slot").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(read).withColumn("mark", F.last(F.when(F.col("slot").isNotNull(), F.struct("slot", "base", "next_idx")), ignorenulls=True).over(order))
    over = merged.withColumn("over", F.col("ap") - F.col("mark.base")).withColumn("counts", (F.col("at") <= F.col("mark.next_idx")) & (F.col("over") > ignore))
    out = over.filter("mark is not null").groupBy(*keys, F.col("mark.slot").alias("slot")).agg(F.count_if("counts").alias("len"), F.avg(F.when(F.col("counts"), F.col("over"))).alias("watt"))
    return out.withColumns({"sec": F.greatest(F.floor(F.col("len") / hz), F.lit(1)).cast("double"), "watt_sec": F.coalesce(F.col("len") * F.col("watt") / hz, F.lit(0.0))})


def warm_energy(slots: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    out = slots.groupBy(*keys).agg(F.median("sec").alias("sec"), F.median("watt_sec").alias("ws"), F.count("*").alias("slots"))
    return out.withColumn("watt", F.try_divide("ws", "sec")).drop("ws")
