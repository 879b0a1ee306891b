"""Evaluation of scored windows. Input: ``model, y_true, y_prob``.

Everything starts from the distinct scores with their class counts, which the
map side already combines; curves then add running totals over the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.ordering import probability_bucket, running_totals

_EPS = 1e-8
METRICS = ("auc_roc", "auc_pr", "f1", "precision", "recall", "specificity")
# Shift names and their thresholds.
OPERATING_POINTS = (("night_weekend", 0.5), ("day_standard", 0.3), ("emergency", 0.15))


def known_scores(scores: DataFrame) -> DataFrame:
    """The same rows; a missing score or one that is no number is an error, never a rank."""
    p = F.col("y_prob")
    message = F.lit("y_prob must be a number in every row")
    known = F.when(p.isNotNull() & ~F.isnan(p.cast("double")), p)
    return scores.withColumn("y_prob", known.otherwise(F.raise_error(message).cast("double")))


def score_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives of every distinct score. Scores must be known."""
    return known_scores(scores).groupBy("model", "y_prob").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"),
        F.count_if(F.col("y_true") == 0).alias("neg"),
    )


def score_totals(scores: DataFrame, neighbours: bool = False) -> DataFrame:
    """Per distinct score: ``cum_pos`` and ``cum_neg`` at or above it, and the class totals.

    ``neighbours`` adds the counts of the next lower score and whether a score is the highest.
    """
    return running_totals(
        score_counts(scores),
        ["model"],
        "y_prob",
        probability_bucket(F.col("y_prob")),
        ["pos", "neg"],
        descending=True,
        neighbours=neighbours,
    )


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def roc_curve(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """ROC points, from the origin (threshold infinity) down to the lowest score.

    ``drop_intermediate`` leaves out points on a straight line: those whose
    next lower score adds the same counts as they do. The origin comes with the
    highest score of a model, so the scores are read once.
    """
    totals = score_totals(scores, neighbours=True)
    if drop_intermediate:
        same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        totals = totals.filter(F.col("is_first") | F.col("next_pos").isNull() | ~same)

    def row(fpr: Column, tpr: Column, threshold: Column) -> Column:
        return F.struct(fpr.alias("fpr"), tpr.alias("tpr"), threshold.alias("threshold"))

    point = row(
        _share(F.col("cum_neg"), F.col("all_neg")),
        _share(F.col("cum_pos"), F.col("all_pos")),
        F.col("y_prob").cast("double"),
    )
    origin = row(F.lit(0.0), F.lit(0.0), F.lit(float("inf")))
    points = F.when(F.col("is_first"), F.array(origin, point)).otherwise(F.array(point))
    return totals.select("model", F.inline(points))


def _auc_column() -> Column:
    """Rank-sum AUC in whole numbers, ties counted half; 0.5 when a class is missing."""
    wide = "decimal(19,0)"
    pos, neg = F.col("pos").cast(wide), F.col("neg").cast(wide)
    above = (F.col("cum_pos") - F.col("pos")).cast(wide)
    pairs = F.sum((neg * (above * 2 + pos)).cast("decimal(38,0)"))
    both = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return F.when(both > 0, pairs.cast("double") / (both * 2.0)).otherwise(0.5)


def roc_auc(scores: DataFrame) -> DataFrame:
    return score_totals(scores).groupBy("model").agg(_auc_column().alias("auc_roc"))


def _precision() -> Column:
    return F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))


def _recall() -> Column:
    return F.when(F.col("all_pos") > 0, F.col("cum_pos") / F.col("all_pos")).otherwise(1.0)


def pr_curve(scores: DataFrame) -> DataFrame:
    """Precision and recall at every score, and the end point without a threshold.

    The end point comes with the lowest score of a model.
    """

    def row(threshold: Column, precision: Column, recall: Column) -> Column:
        names = {"threshold": threshold, "precision": precision, "recall": recall}
        return F.struct(*[c.alias(n) for n, c in names.items()])

    point = row(F.col("y_prob").cast("double"), _precision(), _recall())
    end = row(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0))
    last = F.col("next_pos").isNull()
    points = F.when(last, F.array(point, end)).otherwise(F.array(point))
    return score_totals(scores, neighbours=True).select("model", F.inline(points))


def average_precision(scores: DataFrame) -> DataFrame:
    """Precision at every score, weighted by the recall gained there."""
    return score_totals(scores).groupBy("model").agg(_ap().alias("auc_pr"))


def _ap() -> Column:
    gained = F.sum(F.col("pos") * _precision())
    return F.when(F.max("all_pos") > 0, gained / F.max("all_pos")).otherwise(0.0)


def _f1() -> Column:
    p, r = _precision(), _recall()
    return (p * r * 2) / (p + r + F.lit(_EPS))


def _best(recall_floor: float | None) -> Column:
    """The lowest threshold of the best F1 with enough recall, else of the best F1 at all.

    A struct with the score and the counts at or above it. The end point of the
    curve has no recall and an F1 of 0, so it never beats a score.
    """
    at = F.struct(_f1().alias("f1"), (-F.col("y_prob")).alias("low"))
    point = F.struct("y_prob", "cum_pos", "cum_neg")
    best_any = F.max_by(point, at)
    if recall_floor is None:
        return best_any
    return F.coalesce(F.max_by(point, F.when(_recall() >= recall_floor, at)), best_any)


def best_threshold(scores: DataFrame, recall_floor: float | None = 0.3) -> DataFrame:
    """Per model the threshold with the best F1 among those with at least the floor's recall."""
    best = score_totals(scores).groupBy("model").agg(_best(recall_floor).alias("best"))
    return best.select("model", F.col("best.y_prob").alias("threshold"))


def _quality(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return {
        "f1": _share(tp * 2, tp * 2 + fp + fn),
        "precision": precision,
        "recall": recall,
        "specificity": _share(tn, tn + fp),
        "npv": _share(tn, tn + fn),
        "alarm_rate": _share(fp, fp + tn),
    }


def confusion(scores: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """True and false positives and negatives at one threshold, or at each model's own."""
    counts = score_counts(scores)
    if isinstance(thresholds, DataFrame):
        own = thresholds.select("model", "threshold")
        at = counts.join(F.broadcast(own), "model")  # one row per model
    else:
        at = counts.withColumn("threshold", F.lit(float(thresholds)))
    hit = F.col("y_prob") >= F.col("threshold")

    def total(column: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(column)).otherwise(0))

    return at.groupBy("model", "threshold").agg(
        total("neg", ~hit).alias("tn"),
        total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"),
        total("pos", hit).alias("tp"),
    )


def metrics(scores: DataFrame, recall_floor: float | None = 0.3) -> DataFrame:
    """One row of metrics per model, at its best threshold, from one pass over the scores."""
    summary = score_totals(scores).groupBy("model").agg(
        _auc_column().alias("auc_roc"),
        _ap().alias("auc_pr"),
        _best(recall_floor).alias("best"),
        F.max("all_pos").alias("all_pos"),
        F.max("all_neg").alias("all_neg"),
    )
    cells = summary.withColumns(
        {
            "tp": F.col("best.cum_pos"),
            "fp": F.col("best.cum_neg"),
            "fn": F.col("all_pos") - F.col("best.cum_pos"),
            "tn": F.col("all_neg") - F.col("best.cum_neg"),
        }
    )
    quality = _quality(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.withColumns(quality).select(
        "model",
        "auc_roc",
        "auc_pr",
        *quality,
        F.col("best.y_prob").alias("threshold_optimal"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def threshold_points(points: int = 15, low: float = 0.1, high: float = 0.9) -> list[float]:
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [high]


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] | int = 15) -> DataFrame:
    """Metrics at evenly spaced thresholds; those that predict a single class are left out.

    All thresholds are counted side by side in one aggregate.
    """
    points = threshold_points(thresholds) if isinstance(thresholds, int) else list(thresholds)
    aggs = [F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")]
    for i, t in enumerate(points):
        hit = F.col("y_prob") >= t
        aggs.append(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias(f"_tp{i}"))
        aggs.append(F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias(f"_fp{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"_tp{i}").alias("tp"),
                (F.col("all_neg") - F.col(f"_fp{i}")).alias("tn"),
                F.col(f"_fp{i}").alias("fp"),
                (F.col("all_pos") - F.col(f"_tp{i}")).alias("fn"),
            )
            for i, t in enumerate(points)
        ]
    )
    cells = score_counts(scores).groupBy("model").agg(*aggs).select("model", F.inline(rows))
    predicted = F.col("tp") + F.col("fp")
    rest = F.col("tn") + F.col("fn")
    quality = _quality(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.filter((predicted > 0) & (rest > 0)).withColumns(quality)


def operating_points(
    scores: DataFrame, points: Sequence[tuple[str, float]] = OPERATING_POINTS
) -> DataFrame:
    """The sweep at named thresholds."""
    swept = threshold_sweep(scores, [t for _, t in points])
    name = F.lit(None).cast("string")
    for label, t in points:
        name = F.when(F.col("threshold") == t, label).otherwise(name)
    return swept.withColumn("shift", name)


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score against positive rate in equal-width bins; empty bins do not appear.

    A score on an edge belongs to the lower bin.
    """
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    bin_no = F.lit(0)
    for edge in edges:
        bin_no = bin_no + F.when(F.col("y_prob") > edge, 1).otherwise(0)
    n = F.sum(F.col("pos") + F.col("neg"))
    return (
        score_counts(scores)
        .groupBy("model", bin_no.alias("bin_no"))
        .agg(
            n.alias("n_rows"),
            (F.sum("pos") / n).alias("fraction_positive"),
            (F.sum(F.col("y_prob") * (F.col("pos") + F.col("neg"))) / n).alias("mean_predicted"),
        )
    )


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """Counts per model and class in equal-width bins over that class's own range.

    The last bin includes its upper edge. A class with a single score gets a
    range of one around it.
    """
    counted = (
        known_scores(scores)
        .groupBy("model", "y_true", "y_prob")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spans = counted.groupBy("model", "y_true").agg(
        F.min("y_prob").alias("_lo"), F.max("y_prob").alias("_hi")
    )
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    position = F.floor((F.col("y_prob") - lo) / (hi - lo) * bins)
    return (
        counted.join(F.broadcast(spans), ["model", "y_true"])  # two rows per model
        .groupBy("model", "y_true", F.least(position, F.lit(bins - 1)).cast("int").alias("bin_no"))
        .agg(F.sum("n").alias("n_rows"))
    )


def compare_models(measured: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """The model comparison table: upper-case names, metrics at four decimals."""
    return measured.select(
        F.upper("model").alias("model"), *[F.round(n, 4).alias(n) for n in names]
    )


def compare_models_tall(measured: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    return measured.unpivot("model", list(names), "metric", "value")


def rank_models(measured: DataFrame, metric: str = "auc_roc", k: int = 2) -> DataFrame:
    """The best ``k`` models by a metric, with their place."""
    top = measured.orderBy(F.desc(metric), "model").limit(k)
    place = F.row_number().over(W.orderBy(F.desc(metric), "model"))
    return top.select(place.alias("place"), "model", metric)


def blend(
    scores: DataFrame, weights: DataFrame, keys: Sequence[str], softmax: bool = True
) -> DataFrame:
    """Weighted mean of the models' scores per key, clamped, and its logit.

    ``weights`` has one row ``(model, weight)`` per model. Keys that lack a
    score of some model are left out.
    """
    raw = F.exp("weight") if softmax else F.col("weight")
    total = weights.agg(F.sum(raw).alias("s"), F.count(F.lit(1)).alias("n")).select(
        F.struct("s", "n").alias("t")
    ).scalar()
    share = weights.select("model", raw.alias("_w"))
    mixed = (
        known_scores(scores)
        .join(F.broadcast(share), "model")  # one row per model
        .groupBy(*keys)
        .agg(
            F.max("y_true").alias("y_true"),
            F.sum(F.col("_w") * F.col("y_prob")).alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_t", total)
        .filter(F.col("_n") == F.col("_t.n"))
    )
    p = F.least(F.greatest(F.col("_sum") / F.col("_t.s"), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return (
        mixed.withColumn("y_prob", p)
        .withColumn("logit", F.log(F.col("y_prob") / (F.lit(1.0) - F.col("y_prob"))))
        .drop("_sum", "_n", "_t")
    )
