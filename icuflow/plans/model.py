"""Around the model: its input, the evaluation of its scores, the dashboard's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut
from icuflow.operators import evaluate as J
from icuflow.operators import risk as K
from icuflow.operators import sampling as S


def model_input(
    dataset: DataFrame,
    label: str = "label",
    ratio: float = 0.10,
    only_below: float = 0.15,
    seed: int = 42,
    subsample: bool = True,
) -> dict[str, DataFrame]:
    """Scaled train, validation and test windows.

    Windows are thinned per subject and split by subject; only the training
    part is undersampled, and the scaler is fitted on it alone.
    """
    thinned = S.subsample_windows(dataset) if subsample else dataset
    thinned = cut(thinned, "thinned")
    splits = S.split_subjects(thinned, seed=seed, label=label)
    parted = cut(S.assign_split(thinned, splits), "parted")
    train = parted.filter(F.col("split") == "train")
    train = cut(S.undersample(train, ratio, seed, label, only_below), "train")
    scaler = cut(S.fit_scaler(train), "scaler")
    parts = {name: parted.filter(F.col("split") == name) for name in ("val", "test")}
    scaled = {n: S.apply_scaler(d, scaler) for n, d in {"train": train, **parts}.items()}
    return {**scaled, "splits": splits, "scaler": scaler}


def evaluation_tables(scores: DataFrame) -> dict[str, DataFrame]:
    """Curves, metrics and operating points of ``model, y_true, y_prob``."""
    measured = J.metrics(scores)
    return {
        "metrics": measured,
        "comparison": J.compare_models(measured),
        "ranking": J.rank_models(measured),
        "roc_curve": J.roc_curve(scores),
        "pr_curve": J.pr_curve(scores),
        "threshold_sweep": J.threshold_sweep(scores),
        "operating_points": J.operating_points(scores),
        "calibration": J.calibration(scores),
        "score_histogram": J.score_histogram(scores),
    }


def blend_best(
    scores: DataFrame, keys: Sequence[str], metric: str = "auc_roc", k: int = 2
) -> DataFrame:
    """The blend of the ``k`` best models, weighted by their metric on the same scores."""
    best = J.rank_models(J.metrics(scores), metric, k).select("model", F.col(metric).alias("weight"))
    return J.blend(scores, best, keys)


def dashboard_tables(
    scores: DataFrame, windows: DataFrame | None = None, features: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Timelines, trends, high-risk list, summary and documents for all scored subjects.

    With the scored ``windows`` and the names of their features also the features' importance.
    """
    importance = {}
    if windows is not None:
        per_model = K.variance_importance(windows, scores, features)
        importance = {"importance": per_model, "global_importance": K.global_importance(per_model)}
    return {
        **importance,
        "timelines": K.risk_timeline(scores),
        "trends": K.risk_trend(scores),
        "subjects": K.subject_risk(scores),
        "high_risk": K.high_risk(scores),
        "summary": K.risk_summary(scores, J.roc_auc(scores)),
        "explanations": K.explanation_docs(scores),
        "trend_documents": K.trend_docs(scores),
        "performance": K.performance_table(J.metrics(scores)),
    }
