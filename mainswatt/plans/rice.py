"""Rice cooker: learn one model a site from its better channel, and predict usage by the second.

The model is a DataFrame of one row per (site, channel) all the way; nothing is collected. Edges, groups, lumps
and the parts of the model are each read by several branches and are written to the shared folder between steps.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import annihilation, energy, groups, lumps
from ..operators.signal import falling_edges
from ..params import META_VERSION, SHAPE_TYPE, Rice
from ..sources.power import KEY, seconds, site_range
from ..sources.shared import materialise

COOK_USAGE = ("min_flucs_proper_lump", "proper_lumps", "usage_start_time", "usage_end_time", "usage_sec_on", "usage_wh_on", "usage_ap_on")
CAND = (*KEY, "cand_rank", "db_time")


def clock(t: Column) -> Column:
    """A time as text, to the second."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def best_channel(metas: DataFrame) -> DataFrame:
    """The better channel of each site: cooking, then warm, then the larger metric, then the lower channel."""
    order = Window.partitionBy("site").orderBy(F.desc("cook"), F.desc("warm"), F.desc("metric"), "channel")
    return metas.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def merged(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The union of intervals of whole seconds (keys, lo, hi) as disjoint ones, those that touch made one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.coalesce(F.col("lo") > F.col("reach") + 1, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.filter("hi >= lo").withColumn("reach", reach).withColumn("part", part).groupBy(*keys, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def around(spans: DataFrame, before: Column, after: Column) -> DataFrame:
    """site, channel, lo, hi around the middle of each lump: ``before`` seconds ahead of it to ``after`` less one."""
    mid = F.floor(F.col("lump_start") / 1e6 + (F.col("lump_end") - F.col("lump_start")) / 2e6)
    return spans.select(*KEY, (mid - F.bround(before).cast("long")).alias("lo"), (mid + F.bround(after).cast("long") - 1).alias("hi"))


def painted(spans: DataFrame, before: Column, after: Column) -> DataFrame:
    """Distinct site, channel, sec around the middle of each lump: ``before`` seconds ahead of it to ``after`` less one."""
    return seconds(merged(around(spans, before, after), KEY)).select(*KEY, "sec")


def levels(bounds: DataFrame, parts: dict[str, DataFrame], power: DataFrame) -> DataFrame:
    """site, sec, p for every second of ``bounds`` (site, lo, hi): the sum of the parts' powers where they cover it.

    ``parts``: by name the intervals (site, lo, hi); ``power``: site and one column a part, null as 0. Each part's union changes
    the count of what covers a second at its ends only; the running sum of these changes gives stretches of one
    power, and only stretches are filled with seconds, a day at a time.
    """
    names = list(parts)
    change = lambda own: [F.lit(1 if k == own else 0).alias(k) for k in names]
    back = lambda own: [F.lit(-1 if k == own else 0).alias(k) for k in names]
    events = bounds.select("site", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("at"), *change(None))
    for name, spans in parts.items():
        own = merged(spans.select("site", "lo", "hi"), ("site",))
        events = events.unionByName(own.select("site", F.col("lo").alias("at"), *change(name))).unionByName(own.select("site", (F.col("hi") + 1).alias("at"), *back(name)))
    w = Window.partitionBy("site").orderBy("at")
    steps = events.groupBy("site", "at").agg(*[F.sum(k).alias(k) for k in names])
    steps = steps.select("site", F.col("at").alias("from"), (F.lead("at").over(w) - 1).alias("to"), *[F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in names])
    held = steps.join(power.select("site", *[F.col(k).alias(f"__{k}") for k in names]), "site", "left")
    total = reduce(add, [F.when(F.col(k) > 0, F.coalesce(f"__{k}", F.lit(0.0))).otherwise(0.0) for k in names])
    cut = held.join(bounds, "site").select("site", F.greatest("from", "lo").alias("lo"), F.least("to", "hi").alias("hi"), total.alias("p"))
    return seconds(cut).select("site", "sec", "p")


def candidates(edges: DataFrame, p: Rice) -> tuple[DataFrame, DataFrame]:
    """Groups (members), and the lumps of each group and period."""
    members = materialise(groups.detect_groups(lumps.watt_band(edges, p.min_watt, p.max_watt), p.search_iter, p.eff_size, p.periodicity, p.quantile_prob, p.med_sec_min, p.med_sec_max))
    matched = lumps.period_match(members, p.db_times, p.db_tolerance, (*KEY, "cand_rank"))
    return members, lumps.big_enough(lumps.sessionise(matched, p.lump_gap, CAND), p.eff_size, CAND)


def _cook(samples: DataFrame, held: DataFrame, p: Rice) -> DataFrame:
    """The cook part of the model: the short candidate whose least proper lump is the largest."""
    e = energy.cook_energy(samples, held, p.hz, p.proper_cook_time, p.min_cook_on, CAND)
    size = held.groupBy(*CAND, "lump_idx").agg(F.count("*").alias("sig"))
    usage = energy.validity(e, size, p.min_cook_on, CAND).filter("proper_ends > 0").select(*CAND, *COOK_USAGE)
    order = Window.partitionBy(*KEY).orderBy(F.desc("min_flucs_proper_lump"), "cand_rank", "db_time")
    best = usage.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    shape = held.groupBy(*CAND).agg(F.countDistinct("lump_idx").alias("lumps"), F.min("h2").alias("min_h2"), F.max("h2").alias("max_h2"), F.min("sub_delta").alias("min_sub"), F.max("sub_delta").alias("max_sub"))
    return best.join(shape, list(CAND))


def _warm_long(samples: DataFrame, members: DataFrame, held: DataFrame, p: Rice) -> DataFrame:
    """The warm part from long candidates: the one whose extents hold most of its group's edges."""
    bounds = held.groupBy(*CAND).agg(F.min("h2").alias("lo_h2"), F.max("h2").alias("hi_h2"))
    spans = lumps.extents(held, CAND).join(bounds, list(CAND))
    refined = lumps.within_extents(members, spans, (*KEY, "cand_rank")).filter(F.col("h2").between(F.col("lo_h2"), F.col("hi_h2")))
    shape = refined.groupBy(*CAND).agg(F.count("*").alias("samples"), F.min("h2").alias("min_h2"), F.max("h2").alias("max_h2"), F.min("sub_delta").alias("min_sub"), F.max("sub_delta").alias("max_sub"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("samples"), "cand_rank", "db_time")
    best = shape.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    count = held.groupBy(*CAND).agg(F.countDistinct("lump_idx").alias("lumps"))
    use = energy.warm_energy(energy.warm_slots(samples, held, p.hz, p.ap_ignore, CAND), CAND)
    return best.join(count, list(CAND)).join(use, list(CAND)).select(*KEY, F.lit(0).alias("type"), "samples", "lumps", "min_h2", "max_h2", "min_sub", "max_sub", "db_time", F.col("sec").alias("usage_sec_on"), F.col("watt").alias("usage_watt"))


def _warm_annihilated(samples: DataFrame, edges: DataFrame, cook_lumps: DataFrame, p: Rice) -> DataFrame:
    """The warm part from edges that appear after cooking and not before, for channels with two or more cook lumps."""
    spans = cook_lumps.groupBy(*KEY, "lump_idx").agg(F.min("start_us").alias("lump_start"), F.max("end_us").alias("lump_end"))
    count = spans.groupBy(*KEY).agg(F.count("*").alias("n_lumps")).filter(F.col("n_lumps") >= p.ann_lumps)
    small = lumps.watt_band(edges, p.ann_min_watt, p.ann_max_watt, closed=False)
    tagged = annihilation.tag_particles(small, spans.join(count, list(KEY)).drop("n_lumps"), p.ann_span)
    found = annihilation.annihilation_edges(tagged, small, count, p.search_iter, p.eff_size, p.ann_prob, p.ann_max_gap, p.med_sec_min, p.med_sec_max, p.ann_coverage, p.ann_lump_size)
    held = lumps.big_enough(lumps.sessionise(lumps.except_edges(found, cook_lumps, ("start_v", "end_v")), p.lump_gap), p.ann_lump_size)
    shape = held.groupBy(*KEY).agg(F.count("*").alias("samples"), F.countDistinct("lump_idx").alias("lumps"), F.min("h2").alias("min_h2"), F.max("h2").alias("max_h2"), F.min("sub_delta").alias("min_sub"), F.max("sub_delta").alias("max_sub"))
    use = energy.warm_energy(energy.warm_slots(samples, held, p.hz, p.ap_ignore))
    return shape.join(use, list(KEY)).select(*KEY, F.lit(1).alias("type"), "samples", "lumps", "min_h2", "max_h2", "min_sub", "max_sub", F.lit(0.0).alias("db_time"), F.col("sec").alias("usage_sec_on"), F.col("watt").alias("usage_watt"))


def train_channels(samples: DataFrame, p: Rice = Rice()) -> DataFrame:
    """site, channel, cook (struct or null), warm (struct or null), start_us, end_us of every channel with either."""
    edges = materialise(falling_edges(samples))
    members, held = candidates(edges, p)
    spans = held.groupBy(*CAND, "lump_idx").agg(F.min("start_us").alias("a"), F.max("end_us").alias("z"))
    kind = spans.groupBy(*CAND).agg((F.max((F.col("z") - F.col("a")) / 1e6) >= p.long_lump).alias("long"))
    held = materialise(held.join(kind, list(CAND)))
    short, long = held.filter("not long").drop("long"), held.filter("long").drop("long")
    cook = materialise(_cook(samples, short, p))
    cook_lumps = short.join(cook.select(*CAND), list(CAND), "left_semi")
    warm_long = materialise(_warm_long(samples, members, long, p))
    no_long = cook_lumps.join(long.select(*KEY).distinct(), list(KEY), "left_anti")
    warm = warm_long.unionByName(materialise(_warm_annihilated(samples, edges, no_long, p)))
    cook_struct = F.struct("lumps", "proper_lumps", "min_h2", "max_h2", "min_sub", "max_sub", F.col("db_time").alias("db_time_sec"), "min_flucs_proper_lump", "usage_start_time", "usage_end_time", "usage_sec_on", "usage_wh_on", "usage_ap_on")
    warm_struct = F.struct("type", "samples", "lumps", "min_h2", "max_h2", "min_sub", "max_sub", F.col("db_time").alias("db_time_sec"), "usage_sec_on", "usage_watt")
    both = cook.select(*KEY, cook_struct.alias("cook_info")).join(warm.select(*KEY, warm_struct.alias("warm_info")), list(KEY), "full_outer")
    used = samples.groupBy(*KEY).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return both.join(used, list(KEY))


PARAMETERS = ("hz", "eff_size", "periodicity", "search_iter", "quantile_prob", "min_watt", "max_watt", "med_sec_min", "med_sec_max", "db_tolerance", "lump_gap", "proper_cook_time", "min_cook_on", "ann_lump_size")
"""What a model keeps of the parameters that it was trained with, beside the period table; prediction reads these."""


def train(samples: DataFrame, p: Rice = Rice(), prior: DataFrame | None = None) -> DataFrame:
    """One model a site: meta_version, shape_type, generation info, flags, cook and warm parts, parameters, reliability.

    With ``prior`` models (one a site), a channel that finds nothing stands with the prior in its place, and competes so: a
    prior that cooks beats a fresh model of the other channel that only keeps warm. A prior keeps its own channel. Sites
    without samples keep theirs.
    """
    parameter = F.struct(*[F.lit(float(getattr(p, k))).alias(k) for k in PARAMETERS])
    fresh = train_channels(samples, p).withColumns({"cook": F.col("cook_info").isNotNull(), "warm": F.col("warm_info").isNotNull()}).select(
        *KEY, F.lit(META_VERSION).alias("meta_version"), F.lit(SHAPE_TYPE).alias("shape_type"),
        F.struct(F.struct(clock(F.timestamp_micros("start_us")).alias("start"), clock(F.timestamp_micros("end_us")).alias("end"), F.lit(int(p.hz)).alias("sampling")).alias("data_used"), clock(F.current_timestamp()).alias("computed")).alias("generation_info"),
        F.struct(F.col("cook").alias("Cook"), F.col("warm").alias("Warm")).alias("general_info"), "cook_info", "warm_info", parameter.alias("parameter"),
        F.array(*map(F.lit, p.db_times)).alias("db_times"), (0.2 + F.when(F.col("cook"), 0.4).otherwise(0.0) + F.when(F.col("warm"), 0.2).otherwise(0.0)).alias("reliability"),
    )
    if prior is None:
        return _better(fresh.select("site", "channel", F.struct(*fresh.columns).alias("model")))
    fresh, prior = materialise(fresh), prior.select(fresh.columns)
    seen = samples.select(*KEY).distinct()
    own = fresh.select("site", "channel", F.struct(*fresh.columns).alias("model"))
    instead = seen.join(fresh, list(KEY), "left_anti").join(prior.select("site", F.struct(*prior.columns).alias("model")), "site")
    return _better(own.unionByName(instead.select("site", "channel", "model"))).unionByName(prior.join(seen.select("site").distinct(), "site", "left_anti").select(prior.columns))


def _better(places: DataFrame) -> DataFrame:
    """The better model of each site, of the ``places`` (site, channel) that a ``model`` stands in."""
    metric = F.coalesce("model.cook_info.min_flucs_proper_lump", "model.warm_info.lumps")
    ranked = places.withColumns({"cook": F.col("model.general_info.Cook"), "warm": F.col("model.general_info.Warm"), "metric": metric})
    return best_channel(ranked).select("model.*")


def _part(meta: DataFrame, part: str) -> DataFrame:
    return meta.filter(F.col(f"general_info.{part.title()}")).select(*KEY, f"{part}_info.*")


def _own(name: str) -> Column:
    """A parameter of the model that an edge or lump is judged by."""
    return F.col(f"parameter.{name}")


def _cooking(chosen: DataFrame, edges: DataFrame, cook: DataFrame, p: Rice) -> tuple[DataFrame, DataFrame]:
    """Edges of the cook lumps, and one row a lump: its extent, whether it is proper, its energy and the model's usage."""
    near = lumps.envelope(edges, cook.select(*KEY, "min_h2", "max_h2", "min_sub", "max_sub"), p.ap_margin, p.rp_margin)
    cook_lumps = materialise(lumps.big_enough(lumps.sessionise(_at_period(near, cook), _own("lump_gap")), _own("eff_size")))
    spans = cook_lumps.groupBy(*KEY, "lump_idx").agg(F.min("start_us").alias("lump_start"), F.max("end_us").alias("lump_end"), F.first("parameter.min_cook_on").alias("min_cook_on"))
    e = energy.cook_energy(chosen, cook_lumps, _own("hz"), _own("proper_cook_time"), _own("min_cook_on")).groupBy(*KEY, "lump_idx").agg(F.max("sec_on").alias("most_sec"), F.median("sec_on").alias("own_sec"), F.median("ap_on").alias("own_ap"))
    shaped = spans.join(e, [*KEY, "lump_idx"]).withColumn("proper", F.col("most_sec") >= F.col("min_cook_on"))
    return cook_lumps, shaped.join(cook.select(*KEY, "usage_start_time", "usage_end_time", "usage_wh_on"), list(KEY))


def predict(samples: DataFrame, meta: DataFrame, p: Rice = Rice()) -> DataFrame:
    """site, sec, p, q: the rice cooker's power at every second; zero for a site without a model."""
    return predict_all(samples, meta, p)[0]


def predict_all(samples: DataFrame, meta: DataFrame, p: Rice = Rice()) -> tuple[DataFrame, DataFrame]:
    """Usage (site, sec, p, q) and its summary (site, confidence, count of proper cook lumps, sampling_rate).

    Each site is judged by its own model's parameters and periods; of ``p`` only the margins and the power factor are read.
    """
    meta = materialise(meta)
    chosen = samples.join(meta.select(*KEY), list(KEY), "left_semi")
    edges = materialise(falling_edges(chosen)).join(meta.select(*KEY, "parameter", "db_times"), list(KEY))
    cook, warm = _part(meta, "cook"), _part(meta, "warm")
    cook_lumps, shaped = _cooking(chosen, edges, cook, p)
    shaped = materialise(shaped)
    minor = shaped.filter("not proper")
    held = materialise(_warm_edges(edges, warm, cook_lumps, p))
    first, length = F.floor(F.col("start_us") / 1000000), F.bround("usage_sec_on").cast("long")
    pulses = held.join(warm.select(*KEY, "usage_sec_on"), list(KEY)).select("site", first.alias("lo"), (first + length - 1).alias("hi"))
    parts = {
        "major": around(shaped.filter("proper"), F.col("usage_start_time"), F.col("usage_end_time")),
        "minor": around(minor, F.col("own_sec") / 2, F.col("own_sec") / 2), "pulse": pulses,
    }
    level = cook.select("site", (-F.col("usage_wh_on") * 3600 / (F.col("usage_start_time") + F.col("usage_end_time"))).alias("major"))
    level = level.join(minor.groupBy("site").agg((-F.median("own_ap")).alias("minor")), "site", "left")
    level = level.join(warm.select("site", (F.col("usage_watt") * p.power_adjust).alias("pulse")), "site", "full_outer")
    usage = levels(site_range(samples), parts, level).withColumn("q", F.lit(0.0))
    count = shaped.filter("proper").groupBy("site").agg(F.count("*").alias("count"))
    known = samples.select("site").distinct().join(meta.select("site", "reliability"), "site", "left").join(count, "site", "left")
    return usage, known.select("site", F.coalesce("reliability", F.lit(0.0)).alias("confidence"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.lit(1.0).alias("sampling_rate"))


def _at_period(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edges at the model's own period."""
    matched = lumps.period_match(edges, F.col("db_times"), _own("db_tolerance"))
    return matched.join(part.select(*KEY, F.col("db_time_sec").alias("db_time")), [*KEY, "db_time"], "left_semi").drop("db_time")


def _warm_edges(edges: DataFrame, warm: DataFrame, cook_lumps: DataFrame, p: Rice) -> DataFrame:
    """Warm edges: in the envelope, at the period (long type) or all (annihilated type), in lumps, extended within them, less cook edges.

    The extension takes, within the bounds of the edges found so far, the group with most edges, and of it those
    inside the lumps' extents.
    """
    inside = lumps.envelope(edges, warm.select(*KEY, "min_h2", "max_h2", "min_sub", "max_sub"), 0.0, 0.0)
    kind = lambda t: warm.filter(F.col("type") == t).select(*KEY)
    periodic = _at_period(inside.join(kind(0), list(KEY), "left_semi"), warm)
    held = materialise(lumps.big_enough(lumps.sessionise(periodic, _own("lump_gap")), _own("eff_size")).unionByName(lumps.big_enough(lumps.sessionise(inside.join(kind(1), list(KEY), "left_semi"), _own("lump_gap")), _own("ann_lump_size"))))
    bounds = held.groupBy(*KEY).agg(F.min("h2").alias("min_h2"), F.max("h2").alias("max_h2"), F.min("sub_delta").alias("min_sub"), F.max("sub_delta").alias("max_sub"))
    group = groups.detect_groups(lumps.watt_band(edges, _own("min_watt"), _own("max_watt")), *map(_own, ("search_iter", "eff_size", "periodicity", "quantile_prob", "med_sec_min", "med_sec_max")))
    near = materialise(lumps.envelope(group, bounds, 0.0, 0.0))
    rank = near.groupBy(*KEY, "group_id").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "group_id"))).filter("r = 1")
    more = lumps.within_extents(near.join(rank.select(*KEY, "group_id"), [*KEY, "group_id"], "left_semi"), lumps.extents(held))
    columns = [*KEY, "start_idx", "end_idx", "start_us", "end_us", "h2", "sub_delta"]
    every = held.select(*columns).withColumn("o", F.lit(0)).unionByName(more.select(*columns).withColumn("o", F.lit(1)))
    every = every.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "start_idx").orderBy("o", "end_idx"))).filter("r = 1").drop("o", "r")
    cooking = cook_lumps.join(kind(1), list(KEY), "left_semi")
    return lumps.except_edges(every, cooking)


def summary(samples: DataFrame, meta: DataFrame, p: Rice = Rice()) -> DataFrame:
    """site, confidence, count, sampling_rate: confidence and count 0 for a site without a model."""
    return predict_all(samples, meta, p)[1]
