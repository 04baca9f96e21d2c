"""Sample tables: one row per reading, keyed by (site, channel) and numbered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("site", "channel")
SEGMENT_US = 86_400_000_000
"""Length of a segment in microseconds: a day. Passes over a channel go segment by segment; what they carry over a border
comes from one row a segment."""
BLOCK = 1 << 16
"""Rows of a channel, by index, in a block."""


def segment_of(us: Column, span: int = SEGMENT_US) -> Column:
    """The number of the segment that a time lies in."""
    return ((us - F.pmod(us, F.lit(span))) / F.lit(span)).cast("long")


def numbered(rows: DataFrame, order: list[str], span: int = SEGMENT_US) -> DataFrame:
    """``idx`` from 1 within each channel by ``us``, then ``order``: segments count their rows, the counts' running sum is each one's offset."""
    rows = rows.withColumn("__seg", segment_of(F.col("us"), span))
    held = Window.partitionBy(*KEY).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*KEY, "__seg").agg(F.count("*").alias("__n")).select(*KEY, "__seg", F.coalesce(F.sum("__n").over(held), F.lit(0)).alias("__offset"))
    own = F.row_number().over(Window.partitionBy(*KEY, "__seg").orderBy("us", *order))
    return rows.join(offsets, [*KEY, "__seg"]).withColumn("idx", F.col("__offset") + own).drop("__seg", "__offset")


def with_neighbours(rows: DataFrame, moved: dict[str, tuple[str, int]], idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """``rows`` with columns from rows some places on in their channel: {new: (column, places)}, places below 0 are before.

    Rows are dealt to blocks by index, and those near a block's border to the block beyond it too, so none sees a whole channel.
    """
    after, before = max(0, *(n for _, n in moved.values())), max(0, *(-n for _, n in moved.values()))
    own = F.floor(F.col(idx) / block)
    place = F.pmod(F.col(idx), F.lit(block))
    to = F.array_compact(F.array(own, F.when(place < after, own - 1), F.when(place >= block - before, own + 1)))
    w = Window.partitionBy(*KEY, "__block").orderBy(idx)
    dealt = rows.withColumn("__block", F.explode(to)).withColumns({new: F.lead(c, n).over(w) if n >= 0 else F.lag(c, -n).over(w) for new, (c, n) in moved.items()})
    return dealt.filter(F.col("__block") == own).drop("__block")


def normalise(df: DataFrame, *tie: str, span: int = SEGMENT_US) -> DataFrame:
    """site, channel, us (microseconds), idx, active_power, reactive_power from a frame with ``timestamp`` and both powers.

    Channels are numbered by time, equal times by the ``tie`` columns (else by power). A frame without ``site`` is one home.
    Rows without a site, channel, time or either power are no readings and are left out.
    """
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    site = F.col("site") if "site" in df.columns else F.lit("s0")
    ties = [F.col(c).alias(f"__tie{k}") for k, c in enumerate(tie)]
    out = df.select(site.cast("string").alias("site"), F.col("channel").cast("int").alias("channel"), us.alias("us"), F.col("active_power").cast("double"), F.col("reactive_power").cast("double"), *ties)
    out = out.dropna(subset=[*KEY, "us", "active_power", "reactive_power"])
    return numbered(out, [f"__tie{k}" for k in range(len(tie))] or ["active_power", "reactive_power"], span).select(*KEY, "us", "idx", "active_power", "reactive_power")


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds from 1970 of a time column. A time without a zone is taken as it reads, as in SQL, whatever the session's zone: that one's clock may leave out or repeat an hour."""
    at = F.col(name)
    if rows.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def from_events(spark: SparkSession, sf_dir: str, coarse_us: int = 1) -> DataFrame:
    """An irregular series from the events table; ``coarse_us`` floors its times, to make equal ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = micros(e, "ts")
    rows = e.select(
        (F.col("user_id") % 2 + 1).alias("channel"), F.timestamp_micros(us - F.pmod(us, F.lit(coarse_us))).alias("timestamp"), us.alias("exact"), "event_id",
        F.round(F.col("value") * 500).cast("long").alias("active_power"), F.get_json_object("props", "$.k").cast("long").alias("reactive_power"),
    )
    return normalise(rows, "exact", "event_id")


SHAPES = {
    "cook": (1, "(id % 72000 between 6000 and 9999 and (id % 72000 - 6000) % 160 < 80) or id % 72000 between 10000 and 14999", 1000, 15),
    "warm": (1, "id between 50000 and 139999 and (id - 50000) % 600 < 200", 400, 10),
    "extra": (1, "id between 50000 and 139999 and ((id - 50000) % 600 < 200 or (id - 50000) % 6000 between 3300 and 3499)", 400, 10),
    "keep": (1, "id % 160000 between 20000 and 49999 and id % 1000 < 200", 400, 10),
    "wash": (2, "id between 60000 and 110000 and (id div 75) % 2 = 0", 300, 60),
    "idle": (1, "false", 0, 0),
}
"""Channel, when the appliance is on (``id`` counts tenths of a second), and its active and reactive power. A ``keep`` home cooks too."""
_COOKING = "kind = 'keep' and id % 160000 < 15000 and ((id % 160000 between 6000 and 9999 and (id % 160000 - 6000) % 160 < 80) or id % 160000 >= 10000)"


def homes(of: DataFrame, n: int = 216_000) -> DataFrame:
    """Noise-free waveforms at 10 Hz from 2024-01-01 for the homes ``of`` (site, kind, more); an appliance draws ``more`` watts on top of its usual power."""
    rows = of.select("site", "kind", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("id"))
    case = lambda part: " ".join(f"when kind = '{k}' and ({on}) then {part(ap, rp)}" for k, (_, on, ap, rp) in SHAPES.items())
    base = lambda wash, other: f"if(kind = 'wash', {wash}, {other})"
    return rows.selectExpr(
        "site", f"{base(2, 1)} channel", "1704067200000000 + id * 100000 us", "id + 1 idx",
        f"cast({base(60, 100)} + case {case(lambda ap, rp: f'{ap} + more')} when {_COOKING} then 1000 + more else 0 end as double) active_power",
        f"cast({base(10, 20)} + case {case(lambda ap, rp: rp)} when {_COOKING} then 15 else 0 end as double) reactive_power",
    )


def planted(spark: SparkSession, kind: str, n: int = 216_000) -> DataFrame:
    """One home of a shape, named like it."""
    return homes(spark.createDataFrame([(kind, kind, 0.0)], "site string, kind string, more double"), n)


def seconds(spans: DataFrame) -> DataFrame:
    """``spans`` (lo, hi and more) with one row a second, ``sec``; a row is split by days first, so none grows to more than one."""
    day = 86400
    days = spans.filter("hi >= lo").withColumn("__day", F.explode(F.sequence(F.floor(F.col("lo") / day), F.floor(F.col("hi") / day))))
    first, last = F.greatest(F.col("lo"), F.col("__day") * day), F.least(F.col("hi"), F.col("__day") * day + day - 1)
    return days.withColumn("sec", F.explode(F.sequence(first, last))).drop("__day", "lo", "hi")


def site_range(samples: DataFrame) -> DataFrame:
    """site, lo, hi: the seconds of a site's first and last sample, both channels included."""
    return samples.groupBy("site").agg(F.floor(F.min("us") / 1000000).alias("lo"), F.floor(F.max("us") / 1000000).alias("hi"))


def second_grid(samples: DataFrame) -> DataFrame:
    """site, sec: every second from a site's first to its last sample."""
    return seconds(site_range(samples))
