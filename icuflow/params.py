"""Parameters of the feature jobs. Widths are in seconds, lengths in bins."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Channel:
    """One measured signal: its ids, its valid range and optional unit rules.

    ``unit_rules`` maps an id to ``(offset, divisor)``: the kept value is
    ``(value - offset) / divisor``. Ids without a rule keep their value.
    ``decimals`` rounds the value before its range is checked.
    """

    name: str
    ids: tuple
    lo: float | None = None
    hi: float | None = None
    closed: str = "both"
    unit_rules: dict = field(default_factory=dict)
    decimals: int | None = None


@dataclass(frozen=True)
class PressureComponent:
    """A pressure component read by a primary and a fallback source."""

    name: str
    primary: tuple
    fallback: tuple
    lo: float
    hi: float


@dataclass(frozen=True)
class Params:
    bin_seconds: int = 3600
    max_bins: int | None = None  # bins of a stay, at most; None keeps all

    obs_bins: int = 18
    pred_bins: int = 6
    stride_bins: int = 8
    grace_bins: int = 2
    min_completeness: float = 0.7

    min_age: int = 18
    min_stay_hours: float = 24
    max_stay_hours: float = 720

    low_cut: float = 6.0
    near_seconds: int = 3600
    flag_seconds: int = 14400
    trim_low: float = 0.01
    trim_high: float = 0.99

    flat_seconds: int = 300
    flat_std: float = 2.0


# Channel ids and valid ranges of the clinical event tables.
RESPIRATION = Channel("rr", (220210,), 0.0, 100.0, closed="neither")
HEART_RATE = Channel("hr", (220045,), 20.0, 230.0)
TEMPERATURE = Channel("temp", (223762, 223761), 33.0, 42.0, unit_rules={223761: (32.0, 1.8)})
OXYGEN = Channel("spo2", (220277, 646), 70.0, 100.0)
COMA_SCALE = Channel("gcs", (220739, 223900, 223901), 3.0, 15.0)
PRESSURE = (
    PressureComponent("sbp", (220050,), (220179,), 50.0, 250.0),
    PressureComponent("dbp", (220051,), (220180,), 30.0, 150.0),
    PressureComponent("map", (220052,), (220181,), 40.0, 200.0),
)
VENTILATOR_CHART_IDS = (223848, 223849, 223870)
VENTILATOR_PROCEDURE_IDS = (225792, 225794)
SEDATIVE_IDS = (
    221319, 221668, 222168, 221744, 225942, 225972,
    221320, 229420, 225150, 221195, 227212,
)
CHANNEL_ORDER = ("sbp", "dbp", "map", "hr", "temp", "spo2", "rr", "gcs")
STATISTICS = ("mean", "last", "min", "max")
FLAG_FEATURE = "sedated_flag"
STATIC_FEATURES = ("age", "gender_M", "gender_F")
DROPPED_FEATURES = ("temp_min", "temp_max", "gcs_min", "gcs_max")


def channel_features(channels=CHANNEL_ORDER, flag: str | None = FLAG_FEATURE) -> list[str]:
    """Feature columns in their fixed order: four statistics per channel, then the flag."""
    names = [f"{c}_{s}" for c in channels for s in STATISTICS]
    return names + ([flag] if flag else [])
