"""Model input: subsampling, subject-wise split, undersampling, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.arrays import sanitize_sequence
from icuflow.functions.cut import cut
from icuflow.functions.ordering import kth_key, shuffle_key
from icuflow.operators.quality import per_position, subject_labels


def subsample_windows(windows: DataFrame, start: str = "obs_start_hour") -> DataFrame:
    """Thin out each subject's windows: all of up to two, else every n-div-3-th by start.

    A subject has as many windows as its stay has strides, a few dozen at most.
    """
    subject = W.partitionBy("subject_id")
    ordered = subject.orderBy(start, "stay_id", "window_id")
    step = F.greatest(F.lit(1), F.expr("_n div 3"))
    return (
        windows.withColumn("_rn", F.row_number().over(ordered))
        .withColumn("_n", F.count(F.lit(1)).over(subject))
        .filter((F.col("_n") <= 2) | ((F.col("_rn") - 1) % step == 0))
        .drop("_rn", "_n")
    )


def split_subjects(
    windows: DataFrame,
    test: float = 0.2,
    val: float = 0.2,
    seed: int = 42,
    label: str = "label",
) -> DataFrame:
    """Every subject's split: ``train``, ``val`` or ``test``.

    Subjects are ordered by a seeded md5. The test share is taken within the
    positive and the negative subjects apart; the validation share is taken
    from the remaining ones together. The subjects are written once, because
    the last key of each share is found by counting keys, before the subjects are filtered.
    """
    subjects = cut(subject_labels(windows, label).select("subject_id", "subject_label"))
    keyed = subjects.withColumns(
        {"_key": shuffle_key(f"{seed}", "subject_id"), "_val_key": shuffle_key(f"{seed}v", "subject_id")}
    )
    last = kth_key(
        keyed, ["subject_label"], "_key", lambda n: F.floor(n * F.lit(test) + F.lit(0.5))
    )
    tested = keyed.withColumn("_test", F.coalesce(F.col("_key") <= last, F.lit(False)))
    rest = tested.filter(~F.col("_test"))
    last_val = kth_key(rest, [], "_val_key", lambda n: F.ceil(n * F.lit(val)))
    split = F.when(F.col("_test"), "test").when(F.col("_val_key") <= last_val, "val").otherwise("train")
    return tested.select("subject_id", "subject_label", split.alias("split"))


def assign_split(windows: DataFrame, splits: DataFrame) -> DataFrame:
    return windows.join(splits.select("subject_id", "split"), "subject_id")


def split_leakage(windows: DataFrame) -> DataFrame:
    """Subjects found in more than one split; empty when the split is sound."""
    return (
        windows.groupBy("subject_id")
        .agg(F.count_distinct("split").alias("n_splits"))
        .filter("n_splits > 1")
    )


def undersample(
    windows: DataFrame,
    ratio: float = 0.10,
    seed: int = 42,
    label: str = "label",
    only_below: float | None = None,
    keys: Sequence[str] = ("stay_id", "window_id"),
) -> DataFrame:
    """All positives and as many negatives, in seeded md5 order, as the target rate allows.

    Nothing is removed when a class is empty, or when ``only_below`` is given
    and the positive rate is not below it. The negatives' keys are counted
    to find the last one to keep; the windows themselves are just filtered. The
    input is read several times, so it should be a stored table.
    """
    keyed = windows.withColumn("_key", shuffle_key(seed, *keys))
    negatives = keyed.filter(F.col(label) == 0).select("_key")
    positive, n = F.count_if(F.col(label) == 1), F.count(F.lit(1))
    quota = F.floor(positive * F.lit(1.0 - ratio) / F.lit(ratio) + F.lit(1e-9))
    keep_all = positive == 0
    if only_below is not None:
        keep_all = keep_all | (F.avg(F.col(label).cast("double")) >= only_below)
    limit = windows.agg(F.when(keep_all, n).otherwise(quota).alias("n")).scalar()
    last = kth_key(negatives, [], "_key", lambda _: limit)
    return keyed.filter((F.col(label) == 1) | (F.col("_key") <= last)).drop("_key")


def fit_scaler(
    windows: DataFrame,
    x: str = "x",
    missing: str = "zero",
    names: Sequence[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Mean and population deviation per feature position over all windows and steps.

    ``missing='zero'`` counts missing cells as 0 (the training scaler),
    ``'skip'`` leaves them out. A deviation of zero becomes 1. Without ``names`` and
    ``width`` the number of features is read from the data first.
    """
    if missing not in ("zero", "skip"):
        raise ValueError(f"unknown missing {missing!r}")
    source = windows.withColumn(x, sanitize_sequence(x)) if missing == "zero" else windows

    def moments(cell: Column, there: Column) -> dict[str, Column]:
        spread = F.stddev_pop(cell)
        return {"mean": F.avg(cell), "std": F.when(spread == 0, 1.0).otherwise(spread)}

    stats = per_position(source, moments, len(names) if names else width, x)
    if names is None:
        return stats
    return stats.withColumn("feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("pos")))


def apply_scaler(
    windows: DataFrame, stats: DataFrame, x: str = "x", missing: str = "zero"
) -> DataFrame:
    """Standardise every cell with the statistics of its feature position."""
    entry = F.sort_array(F.collect_list(F.struct("pos", "mean", "std")))
    scale = stats.agg(entry.alias("scale")).scalar()
    source = windows.withColumn(x, sanitize_sequence(x)) if missing == "zero" else windows
    with_scale = source.withColumn("_scale", scale)
    standard = F.transform(
        x,
        lambda row: F.zip_with(
            row, F.col("_scale"), lambda v, s: (v - s.getField("mean")) / s.getField("std")
        ),
    )
    return with_scale.withColumn(x, standard).drop("_scale")


def class_weight(windows: DataFrame, label: str = "label", factor: float = 1.5) -> DataFrame:
    """Weight of the positive class: ``factor`` times negatives per positive."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return windows.agg(
        pos.alias("n_positive"),
        neg.alias("n_negative"),
        (F.lit(factor) * neg / F.greatest(pos, F.lit(1))).alias("pos_weight"),
    )


def dataset_facts(windows: DataFrame, label: str = "label") -> DataFrame:
    """Subjects, samples, samples per subject, and the event rate by window and by subject."""
    n, subjects = F.sum("n_windows"), F.count(F.lit(1))
    return subject_labels(windows, label).agg(
        subjects.alias("n_subjects"),
        n.alias("n_samples"),
        (n / subjects).alias("samples_per_subject"),
        (F.sum("n_positive") / n).alias("window_event_rate"),
        F.avg(F.col("subject_label").cast("double")).alias("subject_event_rate"),
    )
