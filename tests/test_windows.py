import random

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from icuflow.operators import features as G
from icuflow.operators import quality as H
from icuflow.operators import sampling as S
from icuflow.operators import windows as W
from icuflow.params import Params

P = Params()
SMALL = Params(obs_bins=3, pred_bins=2, stride_bins=2, grace_bins=1, min_completeness=0.7)
STAY = "subject_id long, stay_id long, intime timestamp, outtime timestamp, deathtime timestamp"


def spine(spark, lengths):
    data = [(s, s, b) for s, n in lengths.items() for b in range(n)]
    return spark.createDataFrame(data, "subject_id long, stay_id long, bin int")


def test_how_many_windows_fit(spark):
    starts = W.window_starts(spine(spark, {1: 23, 2: 24, 3: 31, 4: 32}), P)
    assert rows(starts, "stay_id", "window_id", "obs_start_hour", "pred_end_hour") == [
        (2, 0, 0, 24), (3, 0, 0, 24), (4, 0, 0, 24), (4, 1, 8, 32)
    ]


def test_label_boundaries(spark):
    events = {1: at(18), 2: at(18, 1), 3: at(24), 4: at(26), 5: at(26, 1), 6: None, 7: at(-1), 8: at(0)}
    stays = spark.createDataFrame([(s, s, at(0), at(40), e) for s, e in events.items()], STAY)
    bounded = W.window_bounds(W.window_starts(spine(spark, {s: 24 for s in events}), P), stays, P)
    both = W.label_windows(W.label_windows(bounded, P), P, "plain")
    assert rows(both, "stay_id", "removed", "label", "label_plain") == [
        (1, True, 0, 1), (2, False, 1, 1), (3, False, 1, 1), (4, False, 1, 0),
        (5, False, 0, 0), (6, False, 0, 0), (7, False, 0, 0), (8, True, 0, 0),
    ]


def gappy(spark):
    rng = random.Random(4)
    data = [
        (s, s, b, rng.choice([None, float(b)]), rng.choice([None, 1.0]))
        for s in range(6) for b in range(12) if b in (0, 11) or rng.random() < 0.7
    ]
    bins = spark.createDataFrame(data, "subject_id long, stay_id long, bin int, f double, g double")
    stays = spark.createDataFrame(
        [(s, s, at(0), at(12), at(4.5) if s % 2 else None) for s in range(6)], STAY
    )
    return data, bins, stays


def test_sequences_and_completeness_match_brute_force(spark):
    data, bins, stays = gappy(spark)
    cells = {(d[1], d[2]): [d[3], d[4]] for d in data}
    got = W.candidate_windows(bins, stays, ["f", "g"], SMALL).collect()
    assert len(got) == 6 * 4
    for r in got:
        want = [cells.get((r.stay_id, r.obs_start_hour + i), [None, None]) for i in range(3)]
        assert [list(row) for row in r.x] == want
        filled = sum(v is not None for row in want for v in row)
        assert abs(r.obs_completeness - filled / 6) < 1e-12
        assert r.missing_values == 6 - filled
    tall = W.sequences_tall(W.window_starts(bins, SMALL), bins, ["f", "g"], SMALL)
    for r in tall.collect():
        assert cells[(r.stay_id, 2 * r.window_id + r.step)] == [r.f, r.g]
    by_rows = W.window_completeness(
        W.window_starts(bins, SMALL), bins, ["f", "g"], SMALL, "rows"
    ).collect()
    for r in by_rows:
        present = sum((r.stay_id, r.obs_start_hour + i) in cells for i in range(3))
        assert abs(r.obs_completeness - present / 3) < 1e-12


def test_positives_are_exempt_from_completeness(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.69), (2, 0, 0.69), (3, 1, 0.70), (4, 0, 0.70)],
        "stay_id long, label int, obs_completeness double",
    )
    assert rows(W.filter_completeness(df, P), "stay_id") == [(1,), (3,), (4,)]
    assert rows(W.filter_completeness(df, P, only_negative=False), "stay_id") == [(3,), (4,)]


def test_stats_add_up_and_removed_windows_occur(spark):
    _, bins, stays = gappy(spark)
    candidates = W.candidate_windows(bins, stays, ["f", "g"], SMALL, sequences=False)
    s = W.window_stats(candidates, SMALL).first()
    assert s.total_possible == s.death_during_obs + s.low_completeness + s.created == 24
    assert s.death_during_obs > 0
    built = W.build_windows(bins, stays, ["f", "g"], SMALL)
    assert built.count() == s.created
    assert W.window_summary(built).first().n_windows == s.created


def test_window_without_bins_is_all_missing(spark):
    windows = spark.createDataFrame([(1, 1, 0)], "subject_id long, stay_id long, window_id int")
    empty = spark.createDataFrame([], "stay_id long, bin int, f double, g double")
    r = W.assemble_sequences(windows, empty, ["f", "g"], SMALL).first()
    assert [list(v) for v in r.x] == [[None, None]] * 3 and r.obs_completeness == 0.0


def test_lost_positives(spark):
    stays = spark.createDataFrame(
        [(1, 1, at(0), at(9), at(5)), (2, 2, at(0), at(9), at(5)), (3, 3, at(0), at(9), None)], STAY
    )
    windows = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "subject_id long, label int")
    assert rows(W.lost_positives(windows, stays)) == [(2,)]


def test_imputation(spark):
    df = spark.createDataFrame(
        [
            (1, 0, None, None, None), (1, 1, 2.0, None, None), (1, 2, None, 4.0, None),
            (1, 3, None, None, None), (2, 0, 9.0, None, None), (2, 1, None, 8.0, None),
        ],
        "subject_id long, bin int, a double, b double, c double",
    )
    filled = G.ffill(df, ["a", "b", "c"])
    assert rows(filled, "subject_id", "bin", "a", "b") == [
        (1, 0, None, None), (1, 1, 2.0, None), (1, 2, 2.0, 4.0), (1, 3, 2.0, 4.0),
        (2, 0, 9.0, None), (2, 1, 9.0, 8.0),
    ]
    done = G.impute(df, ["a", "b", "c"])
    assert rows(done, "subject_id", "bin", "a", "b", "c")[0] == (1, 0, 2.0, 4.0, None)
    only_means = G.fill_means(df.filter("subject_id = 1 OR bin = 1"), ["a", "b"])
    assert (2, 1, 2.0, 8.0) in rows(only_means, "subject_id", "bin", "a", "b")
    delta = G.missing_delta(df, done, ["a", "b"]).first()
    assert (delta.missing_before, delta.missing_after, delta.total_values) == (8, 0, 12)


def test_final_dataset_shape_and_order(spark):
    _, bins, stays = gappy(spark)
    windows = W.build_windows(bins, stays, ["f", "g"], SMALL)
    cohort = spark.createDataFrame(
        [(s, s, 40 + s, 1, 0) for s in range(5)],
        "subject_id long, stay_id long, age int, gender_M int, gender_F int",
    )
    final = G.finalize(windows, cohort, ["f", "g"], dropped=("g",))
    assert dict(final.dtypes)["x"] == "array<array<float>>" and dict(final.dtypes)["y"] == "int"
    for r in final.collect():
        assert len(r.x) == 3 and all(len(row) == 4 for row in r.x)
        static = [40.0 + r.stay_id, 1.0, 0.0] if r.stay_id < 5 else [None] * 3
        assert all(list(row[1:]) == static for row in r.x)
    names = G.feature_list(["f", "g"], ("g",))
    assert rows(G.feature_names(spark, names)) == [(0, "f"), (1, "age"), (2, "gender_M"), (3, "gender_F")]
    check = H.check_dataset(final, SMALL, 4).first()
    assert (check.bad_steps, check.bad_width, check.missing_x) == (0, 0, 0)
    assert G.drop_matching(final, "OBS").columns == [c for c in final.columns if "obs" not in c]


def tensor(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, 1, 0, [[1.0, None], [nan, 2.0]], 0),
        (1, 1, 1, [[None, None], [inf, -3.0]], 1),
        (2, 2, 0, [[0.5, 1.0], [1.0, 1.0]], None),
    ]
    return spark.createDataFrame(
        data, "subject_id long, stay_id long, window_id int, x array<array<double>>, label int"
    )


def test_tensor_reports(spark):
    w = tensor(spark)
    assert rows(H.tensor_health(w)) == [(3, 1, 1, 1, 0, 0)]
    assert rows(H.tensor_range(w)) == [(-3.0, float("inf"), "0,1")]
    assert rows(H.tensor_null_ratio(w)) == [(True, 12, 4, 4 * 100 / 12)]
    assert [tuple(r) for r in H.top_null(w, "window", 2).collect()] == [(1, 0, 2), (1, 1, 2)]
    assert [tuple(r) for r in H.top_null(w, "step", 1).collect()] == [(0, 3)]
    assert [tuple(r) for r in H.top_null(w, "feature").collect()] == [(0, 2), (1, 2)]
    ragged = spark.createDataFrame([(1, 0, [[1.0, None], None, [], [None]])], "stay_id long, window_id int, x array<array<double>>")
    assert [tuple(r) for r in H.top_null(ragged, "feature").collect()] == [(0, 1), (1, 1)]
    assert [tuple(r) for r in H.top_null(ragged, "step").collect()] == [(0, 1), (3, 1)]
    assert H.top_null(ragged.limit(0), "feature").collect() == []
    with pytest.raises(Exception, match="more than 1 features"):
        H.top_null(ragged, "feature", width=1).collect()


def test_cells_never_become_rows(spark):
    w = spark.createDataFrame([(1, 0, [[1.0, 2.0]])], "stay_id long, window_id int, x array<array<double>>")
    for df in (S.fit_scaler(w, width=2), H.top_null(w, "feature", width=2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1
    assert "posexplode(_row" not in H.top_null(w, "step")._jdf.queryExecution().optimizedPlan().toString()


def test_class_reports(spark):
    df = spark.createDataFrame(
        [(1, 0), (1, 1), (2, 0), (3, 0), (3, 0), (4, 0)], "subject_id long, label int"
    )
    b = H.class_balance(df).first()
    assert (b.n_negative_subjects, b.n_positive_subjects, b.imbalance_ratio) == (3, 1, 3.0)
    assert rows(H.windows_by_class(df)) == [(0, 3, 4, 4 / 3), (1, 1, 2, 2.0)]
    assert H.balance_band(df).first().minority_ratio == 0.25
    none = H.class_balance(df.withColumn("label", F.lit(0))).first()
    assert none.imbalance_ratio is None


def test_bins_are_not_broadcast_to_the_windows(spark):
    p = Params(obs_bins=2, pred_bins=1, stride_bins=1)
    bins = spark.createDataFrame([(1, 1, b, float(b)) for b in range(30)], "subject_id long, stay_id long, bin int, hr double")
    starts = W.window_starts(bins, p)
    made = W.assemble_sequences(starts, bins, ["hr"], p)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in made.select("window_id", "x").collect()) == [(n, [[float(n)], [n + 1.0]]) for n in range(28)]


def test_statics_are_not_broadcast_to_the_windows(spark):
    windows = spark.createDataFrame([(s, s, w) for s in range(6) for w in range(3)], "subject_id long, stay_id long, window_id int")
    cohort = spark.createDataFrame([(s, s, 40 + s, 1, 0) for s in range(5)], "subject_id long, stay_id long, age int, gender_M int, gender_F int")
    found = G.attach_static(windows, cohort)
    held = sorted((tuple(r) for r in found.collect()), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "ShuffledHashJoin" in plan and "Broadcast" not in plan
    static = lambda s: (40 + s, 1, 0) if s < 5 else (None, None, None)
    assert held == sorted(((s, s, w, *static(s)) for s in range(6) for w in range(3)), key=str)
