"""Sliding observation windows, their outcome labels, sequences and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.arrays import null_steps
from icuflow.functions.time import ceil_div, floor_div, shift
from icuflow.params import Params

LABEL = "label"
PLAIN_LABEL = "label_plain"
_KEYS = ("stay_id", "window_id")
_BLOCK = 8  # consecutive windows cut from one array of bins


def window_starts(bins: DataFrame, p: Params) -> DataFrame:
    """Every window that fits in a stay's bins, numbered from 0, one row each."""
    spans = bins.groupBy("stay_id").agg(
        F.min("subject_id").alias("subject_id"), (F.max("bin") + 1).alias("_n")
    )
    room = F.col("_n") - (p.obs_bins + p.pred_bins)
    start = F.col("window_id") * p.stride_bins
    return (
        spans.filter(room >= 0)
        .withColumn(
            "window_id",
            F.explode(F.sequence(F.lit(0), floor_div(room, p.stride_bins).cast("int"))),
        )
        .select(
            "subject_id",
            "stay_id",
            "window_id",
            start.alias("obs_start_hour"),
            (start + p.obs_bins).alias("obs_end_hour"),
            (start + p.obs_bins).alias("pred_start_hour"),
            (start + p.obs_bins + p.pred_bins).alias("pred_end_hour"),
        )
    )


def _bound(hour: str, p: Params) -> Column:
    return shift("intime", F.col(hour) * p.bin_seconds)


def window_bounds(windows: DataFrame, stays: DataFrame, p: Params) -> DataFrame:
    """Add the window's start and end times and the stay's event."""
    return (
        windows.join(stays.select("stay_id", "intime", "deathtime"), "stay_id")
        .withColumns(
            {
                "obs_start": _bound("obs_start_hour", p),
                "obs_end": _bound("obs_end_hour", p),
                "pred_start": _bound("pred_start_hour", p),
                "pred_end": _bound("pred_end_hour", p),
            }
        )
    )


def label_windows(bounded: DataFrame, p: Params, mode: str = "grace") -> DataFrame:
    """Outcome of each window.

    ``grace``: an event during the observation removes the window, one in the
    prediction window or shortly after is positive. An event at the very end of
    the observation removes it. Adds ``removed`` and ``label``.
    ``plain``: only an event in the prediction window is positive, nothing is
    removed. Adds ``label_plain``.
    """
    event = F.col("deathtime")
    if mode == "plain":
        hit = event.between(F.col("pred_start"), F.col("pred_end"))
        return bounded.withColumn(PLAIN_LABEL, F.when(hit, 1).otherwise(0))
    if mode != "grace":
        raise ValueError(f"unknown mode {mode!r}")
    grace_end = shift("pred_end", p.grace_bins * p.bin_seconds)
    removed = F.coalesce(
        event.between(F.col("obs_start"), F.col("obs_end")), F.lit(False)
    )
    hit = event.between(F.col("pred_start"), grace_end) & ~removed
    return bounded.withColumn("removed", removed).withColumn(
        LABEL, F.when(hit, 1).otherwise(0)
    )


def spread_to_windows(bins: DataFrame, p: Params) -> DataFrame:
    """Each bin once for every window that observes it, with its ``step`` in the window.

    The window numbers follow from the bin number, so this needs no range join;
    a bin belongs to at most ``ceil(obs / stride)`` windows.
    """
    return _spread(bins, p.obs_bins, p.stride_bins, "window_id", "step")


def _spread(bins: DataFrame, length: int, stride: int, number: str, place: str) -> DataFrame:
    b = F.col("bin").cast("long")
    first = F.greatest(ceil_div(b - length + 1, stride), F.lit(0))
    last = floor_div(b, stride)
    return (
        bins.filter(first <= last)
        .withColumn(number, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .withColumn(place, (F.col("bin") - F.col(number) * stride).cast("int"))
    )


def _blocks(bins: DataFrame, p: Params, empty: Column) -> DataFrame:
    """One row per stay and block of windows: ``_rows`` has ``_row`` of every bin in order, ``empty`` in gaps.

    A bin goes to one block, or to two if windows of the block before still observe it, so blocks
    repeat far fewer bins than windows do; a long stay is many blocks.
    """
    stride = _BLOCK * p.stride_bins
    length = stride - p.stride_bins + p.obs_bins
    placed = _spread(bins, length, stride, "_block", "_place").groupBy("stay_id", "_block").agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "_row"))).alias("_by_place")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda s: F.coalesce(F.try_element_at("_by_place", s), empty),
    )
    return placed.select("stay_id", "_block", dense.alias("_rows"))


def filled_cells(features: Sequence[str]) -> Column:
    """How many of the features a bin has."""
    return F.expr(" + ".join(f"int({f} IS NOT NULL)" for f in features))


def window_completeness(
    windows: DataFrame, bins: DataFrame, features: Sequence[str], p: Params, mode: str = "cells"
) -> DataFrame:
    """Share of observed cells (``cells``) or of observed bins (``rows``) per window."""
    per_window = spread_to_windows(
        bins.select("stay_id", "bin", filled_cells(features).alias("_filled")), p
    ).groupBy(*_KEYS).agg(
        F.sum("_filled").alias("_filled"), F.count(F.lit(1)).alias("_rows")
    )
    joined = windows.join(per_window, list(_KEYS), "left")
    if mode == "rows":
        rows = F.coalesce(F.col("_rows"), F.lit(0))
        joined = joined.withColumn("obs_completeness", rows / p.obs_bins)
    elif mode == "cells":
        joined = _with_cells(joined, len(features), p)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return joined.drop("_filled", "_rows")


def _with_cells(joined: DataFrame, width: int, p: Params) -> DataFrame:
    total = p.obs_bins * width
    filled = F.coalesce(F.col("_filled"), F.lit(0))
    return joined.withColumns(
        {
            "total_values": F.lit(total).cast("long"),
            "missing_values": F.lit(total) - filled,
            "obs_completeness": filled / F.lit(float(total)),
        }
    )


def assemble_sequences(
    windows: DataFrame, bins: DataFrame, features: Sequence[str], p: Params
) -> DataFrame:
    """Add ``x``: one array of features per step, in step order, empty where no bin is.

    Also adds the completeness counts. Each window is cut from the array of its block
    of windows. A window without any bin gets an all-missing sequence. The blocks hold all
    bins but are estimated by their compressed size, so both sides are dealt by block rather than
    broadcast, and a task holds its windows, which are still narrow, while its blocks pass by.
    """
    cells = F.expr("array(" + ", ".join(f"double({f})" for f in features) + ")")
    row = F.struct(cells.alias("cells"), filled_cells(features).alias("n"))
    nothing = F.array_repeat(F.lit(None).cast("double"), len(features))
    empty = F.struct(nothing.alias("cells"), F.lit(0).alias("n"))
    blocks = _blocks(bins.select("stay_id", "bin", row.alias("_row")), p, empty)
    number = F.col("window_id").cast("long")
    start = F.pmod(number, F.lit(_BLOCK)) * p.stride_bins
    own = F.slice("_rows", start.cast("int") + 1, F.lit(p.obs_bins))
    joined = (
        windows.withColumn("_block", floor_div(number, _BLOCK).cast("int"))
        .hint("shuffle_hash")
        .join(blocks, ["stay_id", "_block"], "left")
        .withColumn("_own", own)
        .withColumn("_filled", F.aggregate("_own.n", F.lit(0).cast("long"), lambda t, n: t + n))
    )
    x = F.coalesce(F.col("_own.cells"), null_steps(p.obs_bins, len(features)))
    made = _with_cells(joined, len(features), p).withColumn("x", x)
    kept = [*windows.columns, "total_values", "missing_values", "obs_completeness", "x"]
    return made.select(*kept)


def sequences_tall(
    windows: DataFrame, bins: DataFrame, features: Sequence[str], p: Params
) -> DataFrame:
    """The sequences as one row per window and observed step."""
    steps = spread_to_windows(bins.select("stay_id", "bin", *features), p).drop("bin")
    return windows.select("subject_id", *_KEYS).join(steps, list(_KEYS)).select(
        "subject_id", *_KEYS, "step", *features
    )


def complete_enough(p: Params, only_negative: bool = True, threshold: float | None = None) -> Column:
    """At or above the completeness threshold; positive windows are exempt by default."""
    ok = F.col("obs_completeness") >= (p.min_completeness if threshold is None else threshold)
    return (F.col(LABEL) == 1) | ok if only_negative else ok


def filter_completeness(
    windows: DataFrame, p: Params, only_negative: bool = True, threshold: float | None = None
) -> DataFrame:
    return windows.filter(complete_enough(p, only_negative, threshold))


def candidate_windows(
    bins: DataFrame, stays: DataFrame, features: Sequence[str], p: Params, sequences: bool = True
) -> DataFrame:
    """All windows with label, completeness and, if asked, sequences; nothing dropped."""
    labelled = label_windows(
        label_windows(window_bounds(window_starts(bins, p), stays, p), p), p, "plain"
    )
    if sequences:
        return assemble_sequences(labelled, bins, features, p)
    return window_completeness(labelled, bins, features, p)


def build_windows(
    bins: DataFrame, stays: DataFrame, features: Sequence[str], p: Params, sequences: bool = True
) -> DataFrame:
    """The usable windows: not removed, and complete enough unless positive."""
    kept = candidate_windows(bins, stays, features, p, sequences).filter(~F.col("removed"))
    return filter_completeness(kept, p).drop(
        "intime", "deathtime", "obs_start", "obs_end", "pred_start", "pred_end", "removed"
    )


def window_stats(candidates: DataFrame, p: Params) -> DataFrame:
    """How many windows were possible, removed, too empty, created and positive."""
    kept = ~F.col("removed") & complete_enough(p)
    counts = {
        "total_possible": F.count(F.lit(1)),
        "death_during_obs": F.count_if("removed"),
        "low_completeness": F.count_if(~F.col("removed") & ~complete_enough(p)),
        "created": F.count_if(kept),
        "positive": F.count_if(kept & (F.col(LABEL) == 1)),
    }
    return candidates.agg(*[c.alias(n) for n, c in counts.items()])


def window_summary(windows: DataFrame, label: str = LABEL) -> DataFrame:
    """Windows, positives and their share, subjects, windows per subject, mean completeness."""
    per_subject = windows.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(label).alias("_pos"),
        F.sum("obs_completeness").alias("_sum"),
    )
    n, pos, subjects = F.sum("_n"), F.sum("_pos"), F.count(F.lit(1))
    return per_subject.agg(
        n.alias("n_windows"),
        pos.alias("n_positive"),
        (pos / n).alias("positive_ratio"),
        subjects.alias("n_subjects"),
        (n / subjects).alias("windows_per_subject"),
        (F.sum("_sum") / n).alias("mean_completeness"),
    )


def completeness_describe(windows: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the completeness."""
    c = F.col("obs_completeness")
    return windows.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.percentile(c, 0.25).alias("q25"),
        F.percentile(c, 0.5).alias("q50"),
        F.percentile(c, 0.75).alias("q75"),
        F.max(c).alias("max"),
    )


def completeness_profile(windows: DataFrame) -> DataFrame:
    """Windows per completeness band."""
    c = F.col("obs_completeness")
    band = (
        F.when(c >= 0.9, "0.9+")
        .when(c >= 0.7, "0.7-0.9")
        .when(c >= 0.5, "0.5-0.7")
        .when(c >= 0.3, "0.3-0.5")
        .otherwise("<0.3")
    )
    return windows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_windows"))


def label_diff(windows: DataFrame) -> DataFrame:
    """Positives under the plain and the grace label, and how much the latter adds."""
    old, new, n = F.sum(PLAIN_LABEL), F.sum(LABEL), F.count(F.lit(1))
    return windows.agg(
        old.alias("old_positive"),
        new.alias("new_positive"),
        (new - old).alias("delta"),
        F.when(old > 0, (new - old) * 100.0 / old).otherwise(0.0).alias("delta_pct"),
        n.alias("n_windows"),
        F.try_divide(old * 100.0, n).alias("old_pct"),
        F.try_divide(new * 100.0, n).alias("new_pct"),
    )


def lost_positives(windows: DataFrame, stays: DataFrame) -> DataFrame:
    """Subjects with an event that no positive window stands for."""
    expected = stays.filter(F.col("deathtime").isNotNull()).select("subject_id").distinct()
    found = windows.filter(F.col(LABEL) == 1).select("subject_id")
    return expected.join(found, "subject_id", "left_anti")
