"""Imputation, feature selection and the final dataset."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.arrays import pick
from icuflow.params import DROPPED_FEATURES, STATIC_FEATURES

_KEYS = ("subject_id",)


def ffill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = _KEYS, order: str = "bin"
) -> DataFrame:
    """Carry the last known value forward. A group is one stay's bins, at most the bin cap."""
    w = f"(PARTITION BY {', '.join(keys)} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return df.selectExpr(
        *[f"last({c}, true) OVER {w} AS {c}" if c in columns else c for c in df.columns]
    )


def fill_means(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = _KEYS,
    original: DataFrame | None = None,
) -> DataFrame:
    """Fill what is left with the group's mean, else with the mean of the whole column.

    The whole-column mean is taken from ``original`` (default: the input), so
    it does not depend on the order in which groups are filled.
    """
    source = original if original is not None else df
    means = source.selectExpr("struct(" + ", ".join(f"avg({c}) AS {c}" for c in columns) + ")")
    group = ", ".join(keys)
    filled = [
        f"coalesce({c}, avg({c}) OVER (PARTITION BY {group}), _means.{c}) AS {c}"
        if c in columns
        else c
        for c in df.columns
    ]
    return df.withColumn("_means", means.scalar()).selectExpr(*filled)


def impute(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = _KEYS, order: str = "bin"
) -> DataFrame:
    return fill_means(ffill(df, columns, keys, order), columns, keys, original=df)


def drop_features(df: DataFrame, columns: Sequence[str] = DROPPED_FEATURES) -> DataFrame:
    return df.drop(*columns)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name contains the pattern, in any case."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c, re.IGNORECASE)])


def missing_delta(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells before and after a change, with percentages."""

    def missing(df: DataFrame, side: str) -> DataFrame:
        cells = F.expr(" + ".join(f"bigint({c} IS NULL)" for c in columns))
        return df.agg(
            F.coalesce(F.sum(cells), F.lit(0)).alias("missing"),
            (F.count(F.lit(1)) * len(columns)).alias("cells"),
        ).withColumn("side", F.lit(side))

    both = missing(before, "before").unionByName(missing(after, "after"))

    def of(side: str, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return both.agg(
        of("before", "missing").alias("missing_before"),
        of("after", "missing").alias("missing_after"),
        of("before", "cells").alias("total_values"),
        (of("before", "missing") - of("after", "missing")).alias("removed"),
        F.try_divide(of("before", "missing") * 100.0, of("before", "cells")).alias("pct_before"),
        F.try_divide(of("after", "missing") * 100.0, of("after", "cells")).alias("pct_after"),
    )


def sort_readings(df: DataFrame, keys: Sequence[str] = ("subject_id",), ts: str = "ts") -> DataFrame:
    return df.orderBy(*keys, ts)


def attach_static(
    windows: DataFrame,
    cohort: DataFrame,
    columns: Sequence[str] = STATIC_FEATURES,
    keys: Sequence[str] = ("subject_id", "stay_id"),
) -> DataFrame:
    """Add the static features. Both sides are dealt by stay, and a task holds its stays while the windows pass by."""
    static = cohort.select(*keys, *columns).hint("shuffle_hash")
    return windows.join(static, list(keys), "left")


def concat_static(windows: DataFrame, columns: Sequence[str] = STATIC_FEATURES) -> DataFrame:
    """Append the static features to every step of the sequence."""
    static = F.array(*[F.col(c).cast("double") for c in columns])
    return windows.withColumn("x", F.transform("x", lambda row: F.concat(row, static)))


def keep_features(
    windows: DataFrame, features: Sequence[str], dropped: Sequence[str] = DROPPED_FEATURES
) -> DataFrame:
    """Remove features from every step of the sequence."""
    positions = [i for i, f in enumerate(features) if f not in dropped]
    return windows.withColumn("x", F.transform("x", lambda row: pick(row, positions)))


def feature_list(
    features: Sequence[str],
    dropped: Sequence[str] = DROPPED_FEATURES,
    static: Sequence[str] = STATIC_FEATURES,
) -> list[str]:
    return [f for f in features if f not in dropped] + list(static)


def feature_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The ordered feature names as a table ``(pos, name)``."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")


def finalize(
    windows: DataFrame,
    cohort: DataFrame,
    features: Sequence[str],
    dropped: Sequence[str] = DROPPED_FEATURES,
    static: Sequence[str] = STATIC_FEATURES,
    label: str = "label",
) -> DataFrame:
    """The dataset: ``x`` as float arrays of steps with static features, ``y`` as int."""
    joined = attach_static(keep_features(windows, features, dropped), cohort, static)
    return concat_static(joined, static).withColumn(
        "x", F.col("x").cast("array<array<float>>")
    ).withColumn("y", F.col(label).cast("int"))
