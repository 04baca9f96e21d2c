"""Defaults of the appliance models, as fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# What a model says of itself.
META_VERSION = "0.1.0"
SHAPE_TYPE = "ricecooker_pattern_scan"


@dataclass(frozen=True)
class Rice:
    hz: float = 10.0
    eff_size: int = 7
    periodicity: float = 0.2
    search_iter: int = 650
    quantile_prob: float = 0.25
    min_watt: float = 250.0
    max_watt: float = 1350.0
    med_sec_min: float = 10.0
    med_sec_max: float = 700.0
    db_times: tuple[float, ...] = (15.0, 16.0, 20.0, 32.0, 45.0, 50.0, 60.0, 75.0, 128.0)
    db_tolerance: float = 0.4
    lump_gap: float = 3600.0
    long_lump: float = 7200.0
    proper_cook_time: float = 2400.0
    min_cook_on: float = 360.0
    ap_ignore: float = 5.0
    ann_lumps: int = 2
    ann_span: float = 10800.0
    ann_prob: float = 0.9
    ann_max_gap: float = 300.0
    ann_min_watt: float = 50.0
    ann_max_watt: float = 1350.0
    ann_lump_size: int = 8
    ann_coverage: float = 0.75
    ap_margin: float = 50.0
    rp_margin: float = 20.0
    power_adjust: float = 2.0


@dataclass(frozen=True)
class Washer:
    fs: int = 15
    box: int = 450
    kernel: int = 180
    end_delay: int = 3000
    vote_boxes: int = 20
    vote_step: int = 10
    vote_over: int = 6
    ap_range: tuple[float, float] = (100.0, 750.0)
    rp_range: tuple[float, float] = (10.0, 150.0)
    modes: tuple[int, int] = (2, 20)
    dip_p: float = 0.2
    block_sec: int = 10
    quantile: float = 0.01
    span_min: tuple[int, int] = (25, 30)


# The washing machine's configuration as a model states it. Prediction reads the kernel of active power and the end delay.
WASHER_CONFIG = {
    "meta_version": 1, "shape_type": "WashingMachine", "version": "0.0.10", "epsilon": 3.0,
    "active_power": {"washing_kernel": 180, "washing_epsilon": 100.0, "spindry_kernel": 300, "spindry_epsilon": 1.0, "min_usage": 50.0, "local_window": 10},
    "reactive_power": {"washing_kernel": 180, "washing_epsilon": 25.0, "spindry_kernel": 300, "spindry_epsilon": 1.0, "min_usage": 5.0},
    "voltage": {"washing_kernel": 180, "washing_epsilon": 0.5, "spindry_kernel": 300, "spindry_epsilon": 1.0},
    "current": {"washing_kernel": 180, "washing_epsilon": 0.5, "spindry_kernel": 300, "spindry_epsilon": 1.0},
    "spin_dry": {"start_delay": 1500, "end_delay": 3000, "duration": 600, "difference": 2, "max": 50, "fix": True},
    "generation_info": {"start": "2015-11-01 00:00:00", "end": "2015-11-01 23:59:59", "sampling_rate": 15, "training": True, "debug": False},
}
