"""Washing machine: a fixed configuration, and usage from both channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import washer
from ..params import WASHER_CONFIG, Washer
from ..sources.power import KEY


def _config(value, changed: dict) -> Column:
    """A configuration as a struct, fields named in ``changed`` replaced wherever they stand."""
    return F.struct(*[_config(v, changed).alias(k) if isinstance(v, dict) else F.lit(changed.get(k, v)).alias(k) for k, v in value.items()])


def meta(samples: DataFrame, **changed) -> DataFrame:
    """site, channel, config: the configuration of every channel; nothing is learnt, so all have the same.

    ``changed`` replaces fields by name (``end_delay=...``); one of no such name is an error.
    """
    known = {k for part in WASHER_CONFIG.values() if isinstance(part, dict) for k in part} | {k for k, v in WASHER_CONFIG.items() if not isinstance(v, dict)}
    if changed.keys() - known:
        raise ValueError(f"no such field: {', '.join(sorted(changed.keys() - known))}")
    return samples.select(*KEY).distinct().withColumn("config", _config(WASHER_CONFIG, changed))


def force_meta(samples: DataFrame, sampling_rate: int = 10, debug: bool = False) -> DataFrame:
    """The configuration as the whole home's model states it, with the data's rate."""
    return meta(samples, sampling_rate=sampling_rate, debug=debug)


def find_cycles(samples: DataFrame, p: Washer = Washer(), dip: bool = True) -> DataFrame:
    """Cycles of each channel: boxes, dip test of the boxes that pass all else, votes, starts."""
    boxes = washer.flagged(washer.box_features(samples, p.box), p)
    if dip:
        likely = samples.join(boxes.filter("flag = 1").select(*KEY, "b").withColumnRenamed("b", "__b"), (samples.site == boxes.site) & (samples.channel == boxes.channel) & (F.floor((samples.idx - 1) / p.box) == F.col("__b")), "left_semi")
        tested = washer.dip_test(likely, p.box).select(*KEY, "b", "p_val")
        boxes = boxes.join(tested, [*KEY, "b"], "left").withColumn("flag", F.when(F.coalesce("p_val", F.lit(0.0)) <= p.dip_p, F.col("flag")).otherwise(0))
    return washer.cycles(washer.starts(washer.votes(boxes, p), p), samples, p)


def predict(samples: DataFrame, p: Washer = Washer()) -> DataFrame:
    """site, us, p, q: the washing machine's power at every sample time, both channels added."""
    return washer.channel_sum(washer.washer_power(samples, find_cycles(samples, p), p))


def summary(samples: DataFrame, p: Washer = Washer()) -> DataFrame:
    """Cycles and confidence of each channel."""
    return washer.reliability(samples, find_cycles(samples, p), p)
