"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.power import KEY, with_neighbours


def shifted(df: DataFrame, moved: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with columns {new: (column, n)} of the value ``n`` rows before (n > 0) or after (n < 0), null beyond the channel's ends."""
    return with_neighbours(df, {new: (name, -n) for new, (name, n) in moved.items()})


def minmax_scale(df: DataFrame, name: str) -> DataFrame:
    """``scaled``: the column stretched to 0 to 1 within its channel; null where it is constant."""
    ends = df.groupBy(*KEY).agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    return df.join(ends, list(KEY)).withColumn("scaled", F.try_divide(F.col(name) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def segment_ids(df: DataFrame, size: int) -> DataFrame:
    """``segment``: blocks of ``size`` rows from 1; the last may be shorter."""
    return df.withColumn("segment", (F.floor((F.col("idx") - 1) / size) + 1).cast("long"))


def lost_signals(gap: str, med: str) -> Column:
    """Signals missing in a gap: the gap in medians, rounded half to even, less one."""
    return F.greatest(F.bround(F.try_divide(F.col(gap), F.col(med))) - 1, F.lit(0.0))


def percentiles(rows: DataFrame, name: str, shares: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """site, channel, lo, hi and p0, p1, ...: least and greatest value and exact percentiles of a channel, interpolated between ranks.

    Values are counted by ``bins`` equal steps first; then only those of the steps that hold a wanted rank are ordered. ``rows`` is read three times.
    """
    rows = rows.select(*KEY, F.col(name).alias("x")).filter("x is not null")
    ends = F.broadcast(rows.groupBy(*KEY).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row a channel
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = rows.join(ends, list(KEY)).withColumn("bin", step)
    spots = [(F.col("n") - 1) * share for share in shares]
    ranks = [rank(spot).cast("long") for spot in spots for rank in (F.floor, F.ceil)]

    def running(counts: DataFrame, *keys: str, by: str) -> DataFrame:
        """``from`` and ``c``: the ranks below and in each row."""
        w = Window.partitionBy(*KEY, *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("from", F.sum("c").over(w) - F.col("c"))

    inside = lambda rank: (rank >= F.col("from")) & (rank < F.col("from") + F.col("c"))
    steps = running(binned.groupBy(*KEY, "n", "bin").agg(F.count("*").alias("c")), by="bin")
    chosen = steps.filter(F.exists(F.array(*map(inside, ranks)), lambda x: x)).select(*KEY, "bin", F.col("from").alias("below"))
    values = binned.join(F.broadcast(chosen), [*KEY, "bin"]).groupBy(*KEY, "n", "lo", "hi", "bin", "below", "x").agg(F.count("*").alias("c"))  # a few rows a channel
    values = running(values, "bin", by="x").withColumn("from", F.col("from") + F.col("below"))
    found = values.groupBy(*KEY, "n", "lo", "hi").agg(*[F.max(F.when(inside(rank), F.col("x"))).alias(f"v{k}") for k, rank in enumerate(ranks)])
    between = lambda k: (F.col(f"v{2 * k}") + (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) * (spots[k] - F.floor(spots[k]))).alias(f"p{k}")
    return found.select(*KEY, "lo", "hi", *[between(k) for k in range(len(shares))])
