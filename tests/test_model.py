import random
import statistics

import pandas as pd
import pytest
from conftest import START, rows
from pyspark.sql import functions as F

from icuflow.functions.ordering import kth_key, quantile_bucket, ranked, running_totals
from icuflow.operators import evaluate as J
from icuflow.operators import risk as K
from icuflow.operators import sampling as S
from icuflow.plans import model as M

SCORE = "model string, subject_id long, obs_start_hour int, tiebreak long, y_true int, y_prob double"


def test_running_totals_and_ranks_match_brute_force(spark):
    rng = random.Random(1)
    values = sorted({round(rng.uniform(-1000, 1000), 2) for _ in range(500)} | {0.0, 1e9, -1e9})
    data = [(g, v, rng.randrange(9)) for g in "ab" for v in values]
    df = spark.createDataFrame(data, "g string, v double, n long")
    for down in (False, True):
        got = running_totals(df, ["g"], "v", quantile_bucket(df, ["g"], "v", ["n"], 16), ["n"], down)
        for r in got.collect():
            mine = [n for g, v, n in data if g == r.g and (v >= r.v if down else v <= r.v)]
            assert r.cum_n == sum(mine)
            assert r.all_n == sum(n for g, _, n in data if g == r.g)
    keyed = df.withColumn("k", F.md5(F.concat("g", F.col("v").cast("string"))))
    for levels, share in ((1, 0.3), (2, 0.3), (3, 1.0), (2, 2.0), (2, 0.0)):
        at = kth_key(keyed, ["g"], "k", lambda n: F.floor(n * F.lit(share)), levels)
        found = {r.g: r["last"] for r in keyed.select("g", at.alias("last")).distinct().collect()}
        for g in "ab":
            keys = sorted(k.k for k in keyed.filter(F.col("g") == g).select("k").collect())
            n = min(int(len(keys) * share), len(keys))
            assert found[g] == (keys[n - 1] if n else None)
    hot = ranked(df, [], F.lit(0), ["g", "v"])
    assert sorted(r["rank"] for r in hot.collect()) == list(range(1, len(data) + 1))


def test_values_in_a_narrow_band_spread_over_buckets(spark):
    data = [("m", 0.5 + i / 2e6) for i in range(10_000)] + [("n", float(i)) for i in range(3)]
    df = spark.createDataFrame(data, "model string, y_prob double")
    counts = df.groupBy("model", quantile_bucket(df, ["model"], "y_prob", []).alias("b")).count().collect()
    mine = [r["count"] for r in counts if r.model == "m"]
    assert len(mine) > 100 and max(mine) < 200 and sum(r["count"] for r in counts if r.model == "n") == 3


def windows(spark, counts, positive=()):
    data = [
        (s, s, w, 8 * w, int(s in positive and w == 0))
        for s, n in counts.items() for w in range(n)
    ]
    return spark.createDataFrame(
        data, "subject_id long, stay_id long, window_id int, obs_start_hour int, label int"
    )


def test_subsample_keeps_every_nth(spark):
    kept = S.subsample_windows(windows(spark, {1: 1, 2: 2, 3: 3, 4: 7}))
    assert {r.subject_id: r["count"] for r in kept.groupBy("subject_id").count().collect()} == {
        1: 1, 2: 2, 3: 3, 4: 4
    }
    assert rows(kept.filter("subject_id = 4"), "window_id") == [(0,), (2,), (4,), (6,)]


def test_split_sizes_strata_and_leakage(spark):
    w = windows(spark, {s: 2 for s in range(100)}, positive=set(range(20)))
    splits = S.split_subjects(w).cache()
    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    assert sizes == {"test": 20, "val": 16, "train": 64}
    assert splits.filter("split = 'test' AND subject_label = 1").count() == 4
    assert rows(splits) == rows(S.split_subjects(w))
    assert rows(splits) != rows(S.split_subjects(w, seed=7))
    parted = S.assign_split(w, splits)
    assert parted.count() == 200 and S.split_leakage(parted).count() == 0
    leaky = parted.withColumn("split", F.when(F.col("window_id") == 0, "test").otherwise("train"))
    assert S.split_leakage(leaky).count() == 100


def test_undersample_reaches_the_rate(spark):
    w = windows(spark, {s: 5 for s in range(60)}, positive={1, 2, 3})
    kept = S.undersample(w, 0.10)
    assert kept.filter("label = 1").count() == 3 and kept.count() == 30
    assert rows(kept) == rows(S.undersample(w.repartition(7), 0.10))
    assert S.undersample(w, 0.5, only_below=0.001).count() == 300
    none = windows(spark, {1: 4})
    assert S.undersample(none).count() == 4
    few = windows(spark, {1: 4}, positive={1})
    assert S.undersample(few, 0.10).count() == 4


def test_scaler(spark):
    nan = float("nan")
    data = [(1, 0, [[1.0, 5.0, None], [3.0, 5.0, nan]]), (2, 0, [[None, 5.0, 1.0], [4.0, 5.0, 2.0]])]
    w = spark.createDataFrame(data, "stay_id long, window_id int, x array<array<double>>")
    stats = {r.pos: (r.mean, r.std) for r in S.fit_scaler(w).collect()}
    first = [1.0, 3.0, 0.0, 4.0]
    assert stats[0] == pytest.approx((statistics.fmean(first), statistics.pstdev(first)))
    assert stats[1] == (5.0, 1.0)
    skipped = {r.pos: r.mean for r in S.fit_scaler(w, missing="skip").collect() if r.pos == 0}
    assert skipped[0] == pytest.approx(8 / 3)
    scaled = S.apply_scaler(w, S.fit_scaler(w)).collect()
    for pos in range(3):
        column = [row[pos] for r in scaled for row in r.x]
        assert sum(column) == pytest.approx(0, abs=1e-9)


def scores(spark, probs, labels, model="m"):
    data = [(model, i, i, i, y, p) for i, (p, y) in enumerate(zip(probs, labels, strict=True))]
    return spark.createDataFrame(data, SCORE)


CASES = {
    "ties": ([0.1, 0.4, 0.4, 0.4, 0.8, 0.8, 0.9, 0.2, 0.2, 0.5], [0, 0, 1, 0, 1, 0, 1, 0, 1, 1]),
    "perfect": ([0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9], [0] * 5 + [1] * 5),
    "inverted": ([0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.3, 0.2, 0.1], [0] * 5 + [1] * 5),
    "extremes": ([0.0, 1.0, 0.0, 1.0, 1e-12, 1 - 1e-12, 0.5, 0.5, 0.0, 1.0], [0, 1, 1, 0, 0, 1, 1, 0, 0, 1]),
}


@pytest.mark.parametrize("case", CASES)
def test_curves_match_brute_force(spark, case):
    probs, labels = CASES[case]
    s = scores(spark, probs, labels).cache()
    pos, neg = sum(labels), len(labels) - sum(labels)
    pairs = [(a, b) for a, y in zip(probs, labels) if y for b, z in zip(probs, labels) if not z]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert J.roc_auc(s).first().auc_roc == pytest.approx(auc)

    def at(t):
        tp = sum(y for p, y in zip(probs, labels) if p >= t)
        fp = sum(1 - y for p, y in zip(probs, labels) if p >= t)
        return tp, fp

    levels = sorted(set(probs))
    curve = {r.threshold: (r.tpr, r.fpr) for r in J.roc_curve(s, False).collect()}
    assert curve.pop(float("inf")) == (0.0, 0.0)
    assert curve == {t: (at(t)[0] / pos, at(t)[1] / neg) for t in levels}
    ap, last, f1 = 0.0, 0.0, {}
    for t in reversed(levels):
        tp, fp = at(t)
        precision, recall = tp / (tp + fp), tp / pos
        ap += (recall - last) * precision
        last = recall
        if recall >= 0.3:
            f1[t] = 2 * precision * recall / (precision + recall + 1e-8)
    assert J.average_precision(s).first().auc_pr == pytest.approx(ap)
    best = min(f1, key=lambda t: (-f1[t], t))
    m = J.metrics(s).first()
    assert m.threshold_optimal == best and (m.tp, m.fp) == at(best)
    assert m.alarm_rate == pytest.approx(m.fp / neg) and m.auc_roc == pytest.approx(auc)
    assert J.pr_curve(s).count() == len(levels) + 1
    corners = {r.threshold for r in J.roc_curve(s).collect()}
    points = [curve[t] for t in reversed(levels)]
    counts = [(at(t)[0] - at(u)[0], at(t)[1] - at(u)[1]) for t, u in zip(levels, levels[1:] + [2.0])][::-1]
    kept = {
        t for i, t in enumerate(reversed(levels))
        if i in (0, len(points) - 1) or counts[i] != counts[i + 1]
    }
    assert corners - {float("inf")} == kept


def test_one_class_and_flipped_scores(spark):
    one = scores(spark, [0.2, 0.6], [0, 0])
    assert J.roc_auc(one).first().auc_roc == 0.5
    assert J.average_precision(one).first().auc_pr == 0.0
    probs, labels = CASES["ties"]
    flipped = scores(spark, [round(1 - p, 6) for p in probs], labels)
    a, b = J.roc_auc(scores(spark, probs, labels)).first(), J.roc_auc(flipped).first()
    assert a.auc_roc + b.auc_roc == pytest.approx(1.0)


def test_sweep_calibration_histogram(spark):
    s = scores(spark, [0.05, 0.1, 0.3, 0.35, 1.0], [0, 0, 1, 0, 1])
    swept = J.threshold_sweep(s).collect()
    assert len(swept) == 15 and all(r.tp + r.fp + r.tn + r.fn == 5 for r in swept)
    assert J.threshold_sweep(s, [0.0, 0.5]).count() == 1
    assert rows(J.operating_points(s), "shift", "tp", "fp")[0] == ("day_standard", 2, 1)
    # A score on an edge belongs to the lower bin; 3 * 0.1 is a little above 0.3.
    assert rows(J.calibration(s), "bin_no", "n_rows") == [(0, 2), (2, 1), (3, 1), (9, 1)]
    h = {(r.y_true, r.bin_no): r.n_rows for r in J.score_histogram(s, 2).collect()}
    assert h == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    flat = J.score_histogram(scores(spark, [0.4, 0.4], [1, 1])).first()
    assert (flat.bin_no, flat.n_rows) == (25, 2)


def test_blend_and_ranking(spark):
    both = scores(spark, [0.2, 1.0], [0, 1], "a").union(scores(spark, [0.6, 1.0], [0, 1], "b"))
    lone = spark.createDataFrame([("a", 9, 9, 9, 1, 0.5)], SCORE)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "model string, weight double")
    mixed = rows(J.blend(both.union(lone), weights, ["subject_id"]), "subject_id", "y_prob")
    assert mixed == [(0, pytest.approx(0.4)), (1, pytest.approx(1 - 1e-6))]
    measured = spark.createDataFrame(
        [("a", 0.7), ("b", 0.9), ("c", 0.8)], "model string, auc_roc double"
    )
    assert rows(J.rank_models(measured)) == [(1, "b", 0.9), (2, "c", 0.8)]
    table = K.performance_table(measured.withColumn("val_auc", F.lit(0.5))).first()
    assert (table.best_auc, table.aupr, table.auroc) == (0.5, 0.0, table.auc_roc)


def test_band_variants(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.30001,), (0.70001,), (0.1,)], "p double")
    banded = df.select("p", *[K.risk_band("p", v).alias(v) for v in ("above", "from", "outside")])
    bands = {r.p: (r.above, r[2], r.outside) for r in banded.collect()}
    assert bands[0.3] == ("Low", "Medium", "Medium")
    assert bands[0.7] == ("Medium", "High", "Medium")
    assert bands[0.30001] == ("Medium", "Medium", "Medium")
    assert bands[0.70001] == ("High", "High", "High") and bands[0.1] == ("Low", "Low", "Low")


def timeline(spark):
    data = [("m", 1, h, 0, 0, p) for h, p in ((0, 0.1), (8, 0.9))]
    data += [("m", 2, h, 0, int(h == 16), p) for h, p in ((16, 0.9), (0, 0.1), (8, 0.2))]
    data += [("m", 3, h, 0, 0, p) for h, p in ((0, 0.8), (8, 0.75), (16, 0.2), (24, 0.1))]
    data += [("m", 4, 8, t, 1, 0.71) for t in range(3)]
    return spark.createDataFrame(data, SCORE)


def test_trends_lists_and_documents(spark):
    s = timeline(spark)
    trends = {r.subject_id: r.risk_trend for r in K.risk_trend(s).collect()}
    assert trends == {1: "stable", 2: "increasing", 3: "decreasing", 4: "stable"}
    top = K.high_risk(s, 2).collect()
    assert sorted(r.subject_id for r in top) == [1, 2]
    twice = s.unionByName(s.withColumn("model", F.lit("other")))
    listed = [(r.model, r.subject_id) for r in K.high_risk(twice, 1).collect()]
    assert len(listed) == 2 and {m for m, _ in listed} == {"other", s.first().model}
    assert K.high_risk(twice).count() == 2 * K.high_risk(s).count()
    summary = K.risk_summary(s).first()
    assert (summary.total_patients, summary.high_risk_count, summary.total_deaths) == (4, 4, 2)
    assert summary.low_risk_mortality_rate == 0.0 and summary.high_risk_mortality_rate == 0.5
    second = K.risk_timeline(s).filter("subject_id = 2").first().timeline
    assert [e.hour for e in second] == [0, 8, 16]
    doc = K.explanation_docs(s).filter("subject_id = 2").first().document
    assert doc.death_probability == 0.9 and doc.actual_death == 0
    assert doc.explanation.top_risk_factors[0].feature_name == "Risk_Score"
    trend = K.trend_docs(s).filter("subject_id = 3").first().document
    assert [p.risk_score for p in trend.predictions_timeline] == [0.8, 0.75, 0.2, 0.1]
    dated = K.trend_docs(s, issued_at=START).filter("subject_id = 1").first().document
    assert [p.timestamp for p in dated.predictions_timeline] == [
        "2024-01-01T00:00:00", "2024-01-01T08:00:00"
    ]
    doc = K.explanation_docs(s, issued_at=START).first().document
    assert doc.prediction_timestamp == "2024-01-01T00:00:00"


def test_scores_are_read_once_for_metrics(spark, tmp_path):
    timeline(spark).write.parquet(str(tmp_path / "s"))
    measured = J.metrics(spark.read.parquet(str(tmp_path / "s")))
    measured.collect()
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_factors_and_scoring(spark):
    w = spark.createDataFrame(
        [(1, 0, [[9.0, 9.0, 9.0], [0.05, -3.0, 0.5]]), (2, 0, [[0.0] * 3, [None, float("nan"), -0.2]])],
        "stay_id long, window_id int, x array<array<double>>",
    )
    assert rows(K.top_factors(w, ["a", "b", "c"], k=2), "stay_id", "place", "feature_name") == [
        (1, 1, "b"), (1, 2, "c"), (2, 1, "c")
    ]
    strong = K.top_factors(w, ["a", "b", "c"], min_abs=0.1)
    assert rows(strong, "stay_id", "feature_name", "contribution") == [
        (1, "b", "high"), (1, "c", "medium"), (2, "c", "medium")
    ]
    weights = spark.createDataFrame([(2, 2.0), (0, 0.0), (1, 1.0)], "pos int, weight double")
    scored = {r.stay_id: r.y_prob for r in K.score_linear(w, weights, 2.0).collect()}
    assert scored[1] == pytest.approx(0.5) and scored[2] == pytest.approx(1 / (1 + 2.718281828459045**-1.6))
    tiled = K.tile_snapshot(spark.createDataFrame([(1.5, None)], "a double, b double"), ["a", "b", "z"], 2)
    assert [list(r) for r in tiled.first().x] == [[1.5, 0.0, 0.0]] * 2
    variance = K.variance_importance(w, timeline(spark), ["a", "b", "c"])
    assert variance.count() == 3 and K.global_importance(variance, 2).count() == 2


def test_any_model_scores_in_batches(spark):
    df = spark.range(10).withColumn("v", F.col("id") / 10)

    def predict(part: pd.DataFrame) -> pd.Series:
        return part["v"] * 2

    scored = K.score_with(df, predict)
    assert rows(scored.filter("abs(y_prob - 2 * v) > 1e-12")) == [] and scored.count() == 10


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_refused(spark, bad):
    scores = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.2), ("m", 1, bad)], "model string, y_true int, y_prob double")
    for table in (J.metrics(scores), J.confusion(scores, 0.5), J.score_histogram(scores)):
        with pytest.raises(Exception, match="y_prob must be a number"):
            table.collect()


def test_best_models_are_blended(spark):
    rows_ = [(m, s, s % 2, p) for s in range(20) for m, p in (("a", 0.2 + 0.6 * (s % 2)), ("b", 0.4 + 0.1 * (s % 3)), ("c", 0.5))]
    scores = spark.createDataFrame(rows_, "model string, subject_id long, y_true int, y_prob double")
    mixed = M.blend_best(scores, ["subject_id"])
    assert mixed.count() == 20 and mixed.filter("y_true = 1").selectExpr("min(y_prob) AS p").first().p > 0.5


def test_cells_add_up_and_small_tables_are_broadcast(spark):
    scores = spark.createDataFrame([("m", i % 2, i / 50) for i in range(50)], "model string, y_true int, y_prob double")
    own = spark.createDataFrame([("m", 0.3)], "model string, threshold double")
    for cells in (J.confusion(scores, own), J.confusion(scores, 0.5)):
        r = cells.first()
        assert r.tn + r.fp + r.fn + r.tp == 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.confusion(scores, own)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
