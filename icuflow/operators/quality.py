"""Reports on the window dataset: missing cells, ranges, class balance, shape checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.arrays import count_cells
from icuflow.operators.bins import missing_rate
from icuflow.params import Params

_KEYS = ("stay_id", "window_id")


def _is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def _is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c.cast("double")) == F.lit(float("inf")), F.lit(False))


def _cells(x: str) -> Column:
    return F.aggregate(
        F.col(x), F.lit(0).cast("long"), lambda n, row: n + F.size(row).cast("long")
    )


def tensor_health(windows: DataFrame, x: str = "x", y: str = "label") -> DataFrame:
    """Missing, NaN and infinite counts of the sequences and of the labels."""
    label = F.col(y).cast("double")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return windows.agg(
        total(count_cells(x, lambda c: c.isNull())).alias("x_null"),
        total(count_cells(x, lambda c: c.isNotNull() & F.isnan(c))).alias("x_nan"),
        total(count_cells(x, _is_infinite)).alias("x_inf"),
        F.count_if(label.isNull()).alias("y_null"),
        F.count_if(label.isNotNull() & F.isnan(label)).alias("y_nan"),
        F.count_if(_is_infinite(label)).alias("y_inf"),
    )


def tensor_range(windows: DataFrame, x: str = "x", y: str = "label") -> DataFrame:
    """Smallest and largest cell, ignoring missing ones, and the distinct labels in order."""
    known = F.filter(F.flatten(x), lambda c: ~_is_missing(c))
    return windows.agg(
        F.min(F.array_min(known)).alias("x_min"),
        F.max(F.array_max(known)).alias("x_max"),
        F.array_join(F.sort_array(F.collect_set(F.col(y).cast("int"))).cast("array<string>"), ",")
        .alias("y_values"),
    )


def tensor_null_ratio(windows: DataFrame, x: str = "x") -> DataFrame:
    missing = F.coalesce(F.sum(count_cells(x, _is_missing)), F.lit(0))
    total = F.coalesce(F.sum(_cells(x)), F.lit(0))
    return windows.agg(
        (missing > 0).alias("has_missing"),
        total.alias("total_values"),
        missing.alias("missing_values"),
        F.try_divide(missing * 100.0, total).alias("missing_pct"),
    )


def cells_tall(windows: DataFrame, keys: Sequence[str] = _KEYS, x: str = "x") -> DataFrame:
    """One row per window, step and feature position."""
    steps = windows.select(*keys, F.posexplode(x).alias("step", "_row"))
    return steps.select(*keys, "step", F.posexplode("_row").alias("pos", "value"))


def row_width(windows: DataFrame, x: str = "x") -> int:
    """Cells of the longest step. Reads ``windows``, which should be a stored table."""
    widest = F.array_max(F.transform(x, lambda row: F.size(row)))
    return windows.agg(F.max(widest)).first()[0] or 0


def per_position(
    windows: DataFrame,
    aggregates: Callable[[Column, Column], Mapping[str, Column]],
    width: int | None = None,
    x: str = "x",
) -> DataFrame:
    """One row per feature position: ``pos`` and aggregates of its cells over all windows and steps.

    Steps become rows once and all positions are aggregated side by side in a single row, so no
    cell ever is a row. ``aggregates`` gets a cell, null where the step is shorter, and whether
    the step has it. Positions that no step has give no row, nor does an empty table. ``width``
    is read from the data where it is not given; a step longer than that is an error.
    """
    width = row_width(windows, x) if width is None else width
    if not width:
        width, windows = 1, windows.limit(0)

    def entry(i: int) -> Column:
        made = aggregates(F.get("_row", F.lit(i)), F.size("_row") > i)
        return F.struct(F.lit(i).alias("pos"), *[v.alias(k) for k, v in made.items()])

    entries = [entry(i) for i in range(width)]
    steps = windows.select(F.explode(x).alias("_row"))
    one = steps.agg(F.max(F.size("_row")).alias("_width"), F.array(*entries).alias("_entries"))
    too_long = F.raise_error(F.lit(f"a step has more than {width} features")).cast("int")
    found = F.when(F.col("_width") > width, too_long).otherwise(F.col("_width"))
    return one.select(found.alias("_width"), F.inline("_entries")).filter("pos < _width").drop("_width")


def top_null(
    windows: DataFrame, by: str = "window", k: int = 5, x: str = "x", width: int | None = None
) -> DataFrame:
    """The ``k`` windows, steps or feature positions with the most missing cells.

    ``width``: features of a step, read from the data where a report by feature is not given it.
    """
    if by == "window":
        counted = windows.select(*_KEYS, count_cells(x, _is_missing).alias("missing"))
        return counted.orderBy(F.desc("missing"), *_KEYS).limit(k)
    if by == "step":
        steps = windows.select(F.posexplode(x).alias("step", "_row")).filter(F.size("_row") > 0)
        missing = F.size(F.filter("_row", _is_missing)).cast("long")
        counted = steps.groupBy("step").agg(F.sum(missing).alias("missing"))
        return counted.orderBy(F.desc("missing"), "step").limit(k)
    if by != "feature":
        raise ValueError(f"unknown report by {by!r}")

    def gaps(cell: Column, there: Column) -> dict[str, Column]:
        return {"missing": F.count_if(there & _is_missing(cell))}

    return per_position(windows, gaps, width, x).orderBy(F.desc("missing"), "pos").limit(k)


def missing_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return missing_rate(df, columns).select("feature", "missing_count")


def subject_labels(windows: DataFrame, label: str = "label") -> DataFrame:
    """Per subject: positive if any window is, and its number of windows."""
    return windows.groupBy("subject_id").agg(
        F.max(label).alias("subject_label"),
        F.count(F.lit(1)).alias("n_windows"),
        F.sum(label).alias("n_positive"),
    )


# Names of the imbalance bands.
BALANCE = ("심각한 불균형", "중간 불균형", "약간 불균형", "균형적")


def _balance_columns() -> tuple[Column, Column]:
    ratio = F.col("minority_ratio")
    band = (
        F.when(ratio < 0.1, BALANCE[0])
        .when(ratio < 0.2, BALANCE[1])
        .when(ratio < 0.4, BALANCE[2])
        .otherwise(BALANCE[3])
    )
    advice = (
        F.when(ratio < 0.1, "oversample subjects, strong class weights, focal loss")
        .when(ratio < 0.3, "class weights, balanced subject sampling")
        .otherwise("train as is, light class weights")
    )
    return band, advice


def class_balance(windows: DataFrame, label: str = "label") -> DataFrame:
    """Class counts by subject and by window, their rates, and windows per subject."""
    s = F.col("subject_label")
    counts = subject_labels(windows, label).agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(s == 0).alias("n_negative_subjects"),
        F.count_if(s == 1).alias("n_positive_subjects"),
        F.coalesce(F.sum("n_windows"), F.lit(0)).alias("n_windows"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive_windows"),
    )
    n, neg, pos = (F.col(c) for c in ("n_subjects", "n_negative_subjects", "n_positive_subjects"))
    return counts.withColumns(
        {
            "negative_pct": F.try_divide(neg * 100.0, n),
            "positive_pct": F.try_divide(pos * 100.0, n),
            "imbalance_ratio": F.try_divide(neg * 1.0, pos),
            "window_positive_pct": F.try_divide(
                F.col("n_positive_windows") * 100.0, F.col("n_windows")
            ),
            "windows_per_subject": F.try_divide(F.col("n_windows") * 1.0, n),
        }
    )


def windows_by_class(windows: DataFrame, label: str = "label") -> DataFrame:
    """Windows of positive and of negative subjects, in all and per subject."""
    n, subjects = F.sum("n_windows"), F.count(F.lit(1))
    return subject_labels(windows, label).groupBy("subject_label").agg(
        subjects.alias("n_subjects"),
        n.alias("n_windows"),
        (n / subjects).alias("windows_per_subject"),
    )


def balance_band(windows: DataFrame, label: str = "label") -> DataFrame:
    """Share of the smaller class among subjects, how severe it is, and what to do."""
    counts = class_balance(windows, label)
    smaller = F.least("n_negative_subjects", "n_positive_subjects")
    band, advice = _balance_columns()
    return (
        counts.withColumn("minority_ratio", F.try_divide(smaller * 1.0, F.col("n_subjects")))
        .withColumn("balance", band)
        .withColumn("advice", advice)
        .select("minority_ratio", "balance", "advice")
    )


def check_dataset(windows: DataFrame, p: Params, width: int, x: str = "x") -> DataFrame:
    """Counts of rows whose sequence or label does not have the expected shape."""
    bad_rows = F.size(F.filter(F.col(x), lambda row: F.size(row) != width))
    return windows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col(x).isNull()).alias("missing_x"),
        F.count_if(F.size(x) != p.obs_bins).alias("bad_steps"),
        F.count_if(bad_rows > 0).alias("bad_width"),
        F.count_if(F.col("label").isNull()).alias("missing_y"),
    )
