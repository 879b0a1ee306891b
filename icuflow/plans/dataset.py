"""From raw clinical tables to the final dataset.

Every step is a function from tables to a table and can run alone on stored
inputs. ``build_dataset`` chains them and stores what several steps read:
cleaned readings, bins and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow import params as P
from icuflow.functions.cut import cut
from icuflow.operators import bins as B
from icuflow.operators import clean as C
from icuflow.operators import features as G
from icuflow.operators import quality as H
from icuflow.operators import windows as W
from icuflow.operators.cohort import cohort_attrition, select_cohort
from icuflow.params import Params

STAY_KEYS = ("subject_id", "hadm_id", "stay_id")
RANGED = (P.HEART_RATE, P.TEMPERATURE, P.OXYGEN)
REQUIRED = ("rr", "hr", "temp", "spo2")
SOURCES = {
    "bp": ("sbp", "dbp", "map"),
    "hr": ("hr",),
    "temp": ("temp",),
    "spo2": ("spo2",),
    "rr": ("rr",),
    "gcs": ("gcs",),
}
FEATURES = P.channel_features()
_COLUMNS = ("stay_id", "ts", "channel", "value", P.FLAG_FEATURE)


def chart_readings(chartevents: DataFrame) -> DataFrame:
    return chartevents.select(
        *STAY_KEYS, F.col("charttime").alias("ts"), "itemid", F.col("valuenum").alias("value")
    )


def _starts(intervals: DataFrame, ids: tuple) -> DataFrame:
    """Start instants of the intervals with the given ids."""
    return C.filter_channels(intervals, ids).select(*STAY_KEYS, F.col("starttime").alias("ts"))


def ranged_readings(readings: DataFrame, cohort: DataFrame) -> DataFrame:
    """Heart rate, temperature and oxygen saturation in one pass."""
    return C.clean_channels(readings, cohort, RANGED, STAY_KEYS)


def respiration_readings(
    readings: DataFrame, procedureevents: DataFrame, cohort: DataFrame, p: Params
) -> DataFrame:
    """Respiration: range, quantile trim, low values only under ventilation."""
    rr = P.RESPIRATION
    kept = cut(C.clean_channel(readings, cohort, rr, STAY_KEYS), "respiration")
    trimmed = C.trim_quantiles(kept, p.trim_low, p.trim_high)
    ventilated = C.restrict_to(
        C.filter_channels(readings, P.VENTILATOR_CHART_IDS), cohort, STAY_KEYS
    )
    procedures = C.restrict_to(
        _starts(procedureevents, P.VENTILATOR_PROCEDURE_IDS), cohort, STAY_KEYS
    )
    cleaned = C.clean_low_with_context(trimmed, ventilated, procedures, p, STAY_KEYS)
    return cleaned.withColumn("channel", F.lit(rr.name))


def coma_readings(
    readings: DataFrame, inputevents: DataFrame, cohort: DataFrame, p: Params
) -> DataFrame:
    """Coma scale with a flag for sedatives given around the reading."""
    scored = C.clean_channel(readings, cohort, P.COMA_SCALE)
    sedated = C.restrict_to(_starts(inputevents, P.SEDATIVE_IDS), cohort)
    flagged = C.flag_near(scored, sedated, p.flag_seconds, name=P.FLAG_FEATURE)
    return flagged.withColumn("channel", F.lit(P.COMA_SCALE.name))


def pressure_readings(
    readings: DataFrame, cohort: DataFrame, p: Params, range_mode: str = "filter"
) -> DataFrame:
    """Pressure components as readings; a component may be missing at an instant."""
    fused = C.clean_pressure(readings, cohort, P.PRESSURE, p, range_mode=range_mode)
    pairs = ", ".join(f"'{c.name}', final_{c.name}" for c in P.PRESSURE)
    return fused.selectExpr(
        "stay_id", "ts", f"stack({len(P.PRESSURE)}, {pairs}) AS (channel, value)"
    )


def clean_readings(
    chartevents: DataFrame,
    inputevents: DataFrame,
    procedureevents: DataFrame,
    cohort: DataFrame,
    p: Params = Params(),
) -> DataFrame:
    """All cleaned readings ``(stay_id, ts, channel, value, sedated_flag)``.

    Each part reads only its own items; on tables landed by item these are
    disjoint row groups, so together they read the event table about once.
    """
    readings = chart_readings(chartevents)
    parts = [
        ranged_readings(readings, cohort),
        respiration_readings(readings, procedureevents, cohort, p),
        coma_readings(readings, inputevents, cohort, p),
        pressure_readings(readings, cohort, p),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*_COLUMNS)


def require_channels(readings: DataFrame, channels=REQUIRED) -> DataFrame:
    """Fail when a required channel has no reading at all."""
    found = {r.channel for r in readings.select("channel").distinct().collect()}
    missing = [c for c in channels if c not in found]
    if missing:
        raise ValueError(f"no readings of {', '.join(missing)}")
    return readings


def build_bins(readings: DataFrame, cohort: DataFrame, p: Params = Params()) -> DataFrame:
    """Hourly bins with the features of all channels, for stays that have every source."""
    flag = (P.FLAG_FEATURE, P.COMA_SCALE.name)
    return B.bin_all(
        readings, cohort, P.CHANNEL_ORDER, p, flag, tie="value", presence=SOURCES
    )


def build_dataset(tables: dict[str, DataFrame], p: Params = Params()) -> dict[str, DataFrame]:
    """Cohort, readings, bins, windows, dataset and reports from the six raw tables.

    The reports (attrition, counts, coverage, missing rates, checks) run only when they are read.
    """
    dimensions = (tables["patients"], tables["admissions"], tables["icustays"])
    cohort = cut(select_cohort(*dimensions, p), "cohort")
    readings = cut(
        clean_readings(
            tables["chartevents"], tables["inputevents"], tables["procedureevents"], cohort, p
        ),
        "readings",
    )
    bins = cut(build_bins(require_channels(readings), cohort, p), "bins")
    windows = cut(W.build_windows(bins, cohort, FEATURES, p), "windows")
    return {
        "cohort": cohort,
        "readings": readings,
        "bins": bins,
        "windows": windows,
        "dataset": G.finalize(windows, cohort, FEATURES),
        "feature_names": G.feature_names(bins.sparkSession, G.feature_list(FEATURES)),
        "coverage": B.coverage(bins),
        "missing": B.missing_rate(bins, FEATURES),
        "window_summary": W.window_summary(windows),
        "attrition": cohort_attrition(*dimensions, p),
        "window_counts": W.window_stats(
            W.candidate_windows(bins, cohort, FEATURES, p, sequences=False), p
        ),
        "health": H.tensor_health(windows),
        "class_balance": H.class_balance(windows),
    }


def impute_dataset(
    bins: DataFrame, windows: DataFrame, cohort: DataFrame, p: Params = Params()
) -> DataFrame:
    """The dataset of stored windows with sequences taken again from imputed bins.

    Labels, bounds and completeness stay those of the original bins.
    """
    imputed = G.impute(bins.select("subject_id", "stay_id", "bin", *FEATURES), FEATURES)
    keys = ["stay_id", "window_id"]
    filled = W.assemble_sequences(windows.select(*keys), imputed, FEATURES, p).select(*keys, "x")
    return G.finalize(windows.drop("x").join(filled, keys), cohort, FEATURES)
