"""Unsupervised groups of edges by gap partition.

One iteration (walls, cells, summary) is plain DataFrame code. The search repeats it up to hundreds of times,
each depending on what the last left over; its input is a band of one channel's edges, so it runs as one
grouped-map kernel per channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lost_signals
from ..sources.power import KEY
from ..sources.shared import materialise


def walls(edges: DataFrame, name: str, n: int) -> DataFrame:
    """Midpoints of the ``n`` largest gaps between sorted values; ties to the lower gap."""
    ordered = edges.select(*KEY, F.col(name).alias("x")).withColumn("x1", F.lead("x").over(Window.partitionBy(*KEY).orderBy("x")))
    ranked = ordered.filter("x1 is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.col("x1") - F.col("x")), "x")))
    return ranked.filter(F.col("rank") <= n).select(*KEY, ((F.col("x") + F.col("x1")) / 2).alias("wall"))


def cells(edges: DataFrame, main: str, sub: str, n: int, size: int) -> DataFrame:
    """Edges with x_division and y_division (walls at or below the value), in cells of at least ``size``."""
    out = edges = materialise(edges)  # three branches read them
    for axis, name in (("x_division", main), ("y_division", sub)):
        held = walls(edges, name, n).groupBy(*KEY).agg(F.collect_list("wall").alias("held"))  # at most n
        out = out.join(held, list(KEY), "left")
        out = out.withColumn(axis, F.coalesce(F.size(F.filter("held", lambda v: v <= F.col(name))), F.lit(0))).drop("held")
    count = F.count("*").over(Window.partitionBy(*KEY, "x_division", "y_division"))
    return out.withColumn("cell", count).filter(F.col("cell") >= size).drop("cell")


def cell_summary(members: DataFrame, q: float) -> DataFrame:
    by = [*KEY, "x_division", "y_division"]
    gaps = members.withColumn("gap", (F.col("start_us") - F.lag("start_us").over(Window.partitionBy(*by).orderBy("start_us", "start_idx"))) / 1e6)
    gaps = gaps.withColumn("med", F.median("gap").over(Window.partitionBy(*by))).withColumn("lost", lost_signals("gap", "med"))
    out = gaps.groupBy(*by).agg(
        F.count("*").alias("sum"), F.min("gap").alias("min_t"), F.percentile("gap", F.lit(q)).alias("min_t2"), F.first("med").alias("med_t"),
        F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost_sig_num"), F.median("h1").alias("med_h1"), F.median("delta").alias("med_d"), F.median("sub_delta").alias("med_sub_d"),
    )
    return out.withColumns({
        "min_med_rate": F.try_divide("min_t", "med_t"), "min_med_rate2": F.try_divide("min_t2", "med_t"),
        "lost_sig_rate": F.try_divide(F.col("lost_sig_num") * 100, F.col("sum") + F.col("lost_sig_num")),
    })


def _walls(x: np.ndarray, n: int) -> np.ndarray:
    """Midpoints of the ``n`` largest gaps of sorted values; ties to the lower gap."""
    gap = np.diff(x)
    if n < len(gap):
        least = np.partition(gap, len(gap) - n)[len(gap) - n]
        top = np.flatnonzero(gap > least)
        top = np.sort(np.r_[top, np.flatnonzero(gap == least)[: n - len(top)]])
    else:
        top = np.arange(len(gap))
    return (x[top] + x[top + 1]) / 2


def _times(us: np.ndarray, q: float) -> dict[str, float]:
    gap = np.diff(np.sort(us)) / 1e6
    med = float(np.median(gap)) if len(gap) else np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        lost = float(np.nansum(np.maximum(np.round(gap / med) - 1, 0))) if len(gap) else 0.0
        first, low = (float(gap.min()), float(np.quantile(gap, q))) if len(gap) else (np.nan, np.nan)
        return {"sum": len(us), "min_t": first, "min_t2": low, "med_t": med, "lost_sig_num": lost, "min_med_rate2": float(np.float64(low) / med)}


def search(pool: pd.DataFrame, iterations: int, size: int, good: Callable[[pd.DataFrame, dict], bool], q: float) -> Iterator[tuple[int, pd.DataFrame, dict]]:
    """Groups in order of discovery. Cells too small are dropped for good; cells that are good leave as groups.

    Both axes are sorted once; what leaves is taken out of the order. A cell is known by the sum of its members' random
    marks, and judged when it first takes shape: most walls stay where they are from one iteration to the next, so an iteration
    costs a pass over the arrays and judgement of the cells that it cuts or thins.
    """
    x, y, us = pool["delta"].to_numpy(float), pool["sub_delta"].to_numpy(float), pool["start_us"].to_numpy()
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    mark = np.random.default_rng(0).integers(0, 2**63, len(pool))
    here = np.ones(len(pool), bool)
    judged: set[tuple[int, int]] = set()
    r, number = 1, 0
    for _ in range(iterations):
        alive = np.flatnonzero(here)
        if len(alive) + 1 <= r or len(alive) < 2:
            return
        column = np.searchsorted(_walls(x[by_x], r), x[alive], "right")
        line = np.searchsorted(_walls(y[by_y], r), y[alive], "right")
        cell = column * (r + 1) + line
        order = np.argsort(cell, kind="stable")  # members stay in the pool's order
        first = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
        count = np.diff(np.r_[first, len(order)])
        known = np.add.reduceat(mark[alive[order]], first)
        small = np.repeat(count < size, count)
        leaving = [alive[order[small]]]
        r = max(r - int((count < size).sum()), 1)
        if small.all():
            r += 1
        else:
            found = 0
            for k in np.flatnonzero(count >= size).tolist():
                if column[order[first[k]]] == 0 or (int(known[k]), int(count[k])) in judged:
                    continue
                members = alive[order[first[k] : first[k] + count[k]]]
                info, frame = _times(us[members], q), pool.iloc[members]
                if good(frame, info):
                    found, number = found + 1, number + 1
                    leaving.append(members)
                    yield number, frame, info
                else:
                    judged.add((int(known[k]), int(count[k])))
            r = max(r - found + 1, 1)
        gone = np.concatenate(leaving)
        if len(gone):
            here[gone] = False
            by_x, by_y = by_x[here[by_x]], by_y[here[by_y]]


MEMBERS = "start_idx long, end_idx long, start_us long, end_us long, h1 double, h2 double, delta double, sub_delta double, start_v double, end_v double"


def detect_groups(edges: DataFrame, iterations: Column | int = 650, size: Column | int = 7, periodicity: Column | float = 0.2, q: Column | float = 0.25, med_min: Column | float = 10.0, med_max: Column | float = 700.0) -> DataFrame:
    """Members of every group that looks periodic, with group_id and its rank by size; ``delta`` is the drop's depth.

    A bound is a number, or a column of the edges that has one value in a channel.
    """
    columns = [x.split()[0] for x in MEMBERS.split(", ")]
    bounds = {"iterations": iterations, "size": size, "periodicity": periodicity, "q": q, "med_min": med_min, "med_max": med_max}
    names = tuple(bounds)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        site, channel = pdf["site"].iloc[0], pdf["channel"].iloc[0]
        b = {k: float(pdf[f"__{k}"].iloc[0]) for k in names}
        pool = pdf.sort_values(["start_us", "start_idx"]).reset_index(drop=True)
        pool["delta"] = -pool["delta"]
        ok = lambda cell, info: b["med_min"] <= info["med_t"] <= b["med_max"] and info["min_med_rate2"] >= b["periodicity"]
        found = [cell[columns].assign(group_id=n, sum=info["sum"]) for n, cell, info in search(pool, int(b["iterations"]), int(b["size"]), ok, b["q"])]
        out = pd.concat(found) if found else pool.iloc[:0][columns].assign(group_id=0, sum=0)
        return out.assign(site=site, channel=channel)[["site", "channel", "group_id", "sum", *columns]]

    held = edges.select(*KEY, *columns, *[(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(f"__{k}") for k, x in bounds.items()])
    members = held.groupBy(*KEY).applyInPandas(kernel, f"site string, channel int, group_id int, sum long, {MEMBERS}")
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.desc("sum"), "group_id"))
    return members.withColumn("cand_rank", rank)
