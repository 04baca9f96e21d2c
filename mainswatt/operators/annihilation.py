"""Warm signals by pair annihilation: edges that appear after cooking but not before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lost_signals
from ..sources.power import KEY
from .groups import MEMBERS, search


def tag_particles(edges: DataFrame, lumps: DataFrame, span_sec: float) -> DataFrame:
    """Edges ending within ``span_sec`` after a lump (offset 0 or more) or before it (0 or less), once per lump and side.

    ``lumps``: site, channel, lump_idx, lump_start, lump_end. Edges and lumps meet in time buckets of the span.
    """
    span = int(span_sec * 1e6)
    after = lumps.select(*KEY, "lump_idx", F.lit(1).alias("side"), F.col("lump_end").alias("zero"), F.col("lump_end").alias("lo"), (F.col("lump_end") + span).alias("hi"))
    before = lumps.select(*KEY, "lump_idx", F.lit(0).alias("side"), F.col("lump_start").alias("zero"), (F.col("lump_start") - span).alias("lo"), F.col("lump_start").alias("hi"))
    sides = after.unionByName(before).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))))
    met = edges.withColumn("bucket", F.floor(F.col("end_us") / span)).join(sides, [*KEY, "bucket"]).filter(F.col("end_us").between(F.col("lo"), F.col("hi")))
    return met.withColumn("particle_position", (F.col("end_us") - F.col("zero")) / 1e6).drop("bucket", "zero", "lo", "hi")


def particle_summary(particles: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start_us", "start_idx", "lump_idx", "side")
    gaps = particles.withColumn("gap", (F.col("start_us") - F.lag("start_us").over(w)) / 1e6)
    gaps = gaps.withColumn("med", F.median("gap").over(Window.partitionBy(*keys))).withColumn("lost", lost_signals("gap", "med"))
    out = gaps.groupBy(*keys).agg(
        F.count("*").alias("sum"), F.min("gap").alias("min_t"), F.first("med").alias("med_t"), F.min("h2").alias("min_h2"), F.max("h2").alias("max_h2"),
        F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost_sig_num"), F.count_if(F.col("particle_position") < 0).alias("anti"),
        F.count_if(F.col("particle_position") >= 0).alias("particle"), F.countDistinct("lump_idx").alias("lumps"),
    )
    return out.withColumn("particle_prob", F.try_divide("particle", "sum"))


_TAGGED = MEMBERS + ", lump_idx long, side int, particle_position double"


def _refine(cell: pd.DataFrame, size: int) -> pd.DataFrame:
    """The cut that removes anti-particles at the least cost in particles, where there are ``size`` or more.

    Each anti-particle proposes the half planes beyond itself, away from the medians; cuts are weighed in blocks
    of proposals against all members.
    """
    is_anti = cell["particle_position"].to_numpy() < 0
    count = int(is_anti.sum())
    if count < size:
        return cell
    cuts = np.empty((count, 2), np.int64)
    x = [cell[c].to_numpy(float) for c in ("delta", "sub_delta")]

    def keep(proposals: np.ndarray) -> np.ndarray:
        out = np.ones((len(proposals), len(cell)), bool)
        for v in x:
            mine = v[proposals][:, None]
            out &= np.where(mine < np.median(v), v[None] > mine, v[None] < mine)
        return out

    anti = np.flatnonzero(is_anti)
    for at in range(0, count, 256):
        gone = ~keep(anti[at : at + 256])
        cuts[at : at + 256, 0] = gone[:, is_anti].sum(axis=1)
        cuts[at : at + 256, 1] = gone[:, ~is_anti].sum(axis=1)
    cost = np.where(cuts[:, 0] > 0, cuts[:, 1] / np.maximum(cuts[:, 0], 1), np.inf)
    enough = cuts[:, 0] >= count - size
    order = np.lexsort((np.arange(count), cost, ~enough)) if enough.any() else np.lexsort((np.arange(count), cost, -cuts[:, 0]))
    return cell[keep(anti[order[:1]])[0]]


def refined(particles: DataFrame, size: int) -> DataFrame:
    """The particles of each channel, as one group, that the best cut leaves; all of them where fewer than ``size`` are anti-particles."""
    columns = [x.split()[0] for x in _TAGGED.split(", ")]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _refine(pdf.sort_values(["start_us", "start_idx", "lump_idx", "side"]).reset_index(drop=True), size)

    return particles.select(*KEY, *columns).groupBy(*KEY).applyInPandas(kernel, f"site string, channel int, {_TAGGED}")


def annihilation_edges(particles: DataFrame, edges: DataFrame, cook_lumps: DataFrame, iterations: int = 650, size: int = 7, prob: float = 0.9, max_gap: float = 300.0, med_min: float = 10.0, med_max: float = 700.0, coverage: float = 0.75, lump_size: int = 8) -> DataFrame:
    """All edges in the bounding box of the best refined group; ``cook_lumps`` has site, channel, n_lumps.

    ``size`` is the least cell of the search; ``lump_size`` the particles that cover a lump, and the anti-particles
    from which on a group is cut.
    """
    columns = [x.split()[0] for x in _TAGGED.split(", ")]
    nothing = pd.DataFrame({"site": pd.Series([], dtype=object), "channel": pd.Series([], dtype="int32")} | {c: pd.Series([], dtype=float) for c in ("d0", "d1", "s0", "s1")})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n_lumps = int(pdf["n_lumps"].iloc[0])
        pool = pdf.sort_values(["start_us", "start_idx", "lump_idx", "side"]).reset_index(drop=True)

        def ok(cell: pd.DataFrame, info: dict) -> bool:
            share = (cell["particle_position"] >= 0).mean()
            return med_min <= info["med_t"] <= med_max and abs(cell["h2"].min() - cell["h2"].max()) <= max_gap and share >= prob

        found = []
        for _, cell, _ in search(pool, iterations, size, ok, 0.25):
            after = cell[cell["particle_position"] >= 0]
            if (after.groupby("lump_idx").size() >= lump_size).sum() >= coverage * n_lumps:
                found.append(_refine(cell, lump_size))
        best = max(found, key=len, default=None)
        if best is None or not len(best):
            return nothing.copy()
        box = [best["delta"].min(), best["delta"].max(), best["sub_delta"].min(), best["sub_delta"].max()]
        return pd.DataFrame([[pdf["site"].iloc[0], pdf["channel"].iloc[0], *box]], columns=["site", "channel", "d0", "d1", "s0", "s1"])

    tagged = particles.select(*KEY, *columns).join(cook_lumps, list(KEY))
    box = tagged.groupBy(*KEY).applyInPandas(kernel, "site string, channel int, d0 double, d1 double, s0 double, s1 double")
    near = F.col("delta").between(F.col("d0"), F.col("d1")) & F.col("sub_delta").between(F.col("s0"), F.col("s1"))
    return edges.join(box, list(KEY)).filter(near).drop("d0", "d1", "s0", "s1")
