import random
import statistics
from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import START, at, rows
from pyspark.sql import functions as F

from icuflow.operators import clean as C
from icuflow.params import TEMPERATURE, Params, PressureComponent

READING = "stay_id long, ts timestamp, value double"


def readings(spark, values, schema=READING):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize(
    ("closed", "kept"),
    [("both", [0.0, 1.0, 2.0]), ("neither", [1.0]), ("right", [1.0, 2.0]), ("left", [0.0, 1.0])],
)
def test_range_ends(spark, closed, kept):
    df = readings(spark, [(1, at(0), v) for v in (-1.0, 0.0, 1.0, 2.0, 3.0, None)])
    assert [v for (v,) in rows(C.clip_range(df, 0, 2, closed), "value")] == kept


def test_temperature_is_converted_before_its_range(spark):
    df = spark.createDataFrame(
        [(1, 223761, 98.6), (1, 223762, 37.0), (1, 223761, 37.0), (1, 223762, 98.6), (1, 1, 37.0)],
        "stay_id long, itemid int, value double",
    )
    kept = C.clean_channel(df, None, TEMPERATURE)
    assert [(i, round(v, 9)) for i, v in rows(kept, "itemid", "value")] == [
        (223761, 37.0), (223762, 37.0)
    ]


def test_rounding_is_optional(spark):
    df = spark.createDataFrame([(1, 223761, 99.0)], "stay_id long, itemid int, value double")
    kept = C.clean_channel(df, None, replace(TEMPERATURE, decimals=3))
    assert rows(kept, "value") == [(37.222,)]


def test_exact_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 30), 2) for _ in range(997)] + [5.0] * 400
    df = readings(spark, [(1, at(0), v) for v in values])
    ordered = sorted(values)

    def smallest_with_share(q):
        return next(v for i, v in enumerate(ordered) if _share(ordered, i) >= q)

    def _share(o, i):
        return sum(1 for x in o if x <= o[i]) / len(o)

    lower, upper = C.quantile_bounds(df, 0.01, 0.99).first()
    assert (lower, upper) == (smallest_with_share(0.01), smallest_with_share(0.99))
    kept = C.trim_quantiles(df, 0.01, 0.99)
    assert kept.count() == sum(lower <= v <= upper for v in values)
    approx = C.quantile_bounds(df, 0.25, 0.75, method="approx").first()
    assert abs(approx[0] - smallest_with_share(0.25)) < 3


def test_context_bounds_and_no_multiplication(spark):
    df = readings(spark, [(1, at(10), 1.0), (2, at(10), 1.0)])
    context = readings(
        spark,
        [(1, at(10, s), 0.0) for s in (3600, 3601, -3601, 100, 200)] + [(2, at(10, 3601), 0.0)],
    )
    flagged = C.flag_near(df, context, 3600)
    assert rows(flagged, "stay_id", "sedated_flag") == [(1, 1), (2, 0)]
    edge = readings(spark, [(2, at(10, 3600), 0.0)])
    assert rows(C.keep_if_near(df, edge, 3600), "stay_id") == [(2,)]
    assert rows(C.flag_near(df, context.limit(0), 3600), "sedated_flag") == [(0,), (0,)]


@pytest.mark.parametrize("tolerance", [0, 1, 7, 100])
def test_near_matches_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    left = [(rng.randrange(3), at(0, rng.randrange(-300, 300)), float(i)) for i in range(150)]
    right = [(rng.randrange(3), at(0, rng.randrange(-300, 300)), 0.0) for _ in range(12)]
    expected = sorted(
        v for s, t, v in left
        if any(s == s2 and abs((t - t2).total_seconds()) <= tolerance for s2, t2, _ in right)
    )
    kept = C.keep_if_near(readings(spark, left), readings(spark, right), tolerance)
    assert sorted(r.value for r in kept.collect()) == expected


def test_low_values_need_a_context_event(spark):
    p = Params(low_cut=6, near_seconds=3600)
    df = readings(
        spark, [(1, at(0), 6.0), (1, at(5), 5.0), (1, at(9), 4.0), (1, at(9), 7.0), (1, at(9), 7.0)]
    )
    exact = readings(spark, [(1, at(0), 0.0)])
    near = readings(spark, [(1, at(5.5), 0.0)])
    assert rows(C.clean_low_with_context(df, exact, near, p), "value") == [(5.0,), (6.0,), (7.0,)]


def test_lone_primary_reading_is_not_valid(spark):
    df = readings(spark, [(1, at(0, s), v) for s, v in ((0, 100.0), (100, 101.0), (200, 120.0), (900, 80.0))])
    rolled = C.flag_flatline(C.rolling_stddev(df, 300), 2.0)
    got = {r.value: (r.rolling_std and round(r.rolling_std, 3), r.is_valid) for r in rolled.collect()}
    assert got == {
        100.0: (None, None), 101.0: (0.707, False), 120.0: (11.269, True), 80.0: (None, None)
    }


@pytest.mark.parametrize("width", [None, 300, 1000])
def test_rolling_deviation_matches_brute_force(spark, width):
    rng = random.Random(5)
    data = [(rng.randrange(2), at(0, rng.randrange(8000)), round(rng.uniform(50, 150), 1)) for _ in range(400)]
    rolled = C.rolling_stddev(readings(spark, data), 300, bucket_seconds=width)
    assert rolled.count() == len(data)
    for r in rolled.collect():
        frame = [
            v for s, t, v in data
            if s == r.stay_id and 0 <= (r.ts - t).total_seconds() <= 300
        ]
        want = statistics.stdev(frame) if len(frame) > 1 else None
        assert (want is None) == (r.rolling_std is None)
        assert want is None or abs(want - r.rolling_std) < 1e-6


SBP = PressureComponent("sbp", (1,), (2,), 50.0, 250.0)


def test_source_choice_and_labels(spark):
    # Two close primary readings that differ make the second one valid.
    primary = readings(
        spark, [(1, at(1), 100.0), (1, at(1, 60), 120.0), (1, at(5), 90.0), (1, at(6), 300.0)]
    )
    fallback = readings(
        spark, [(1, at(1, 60), 110.0), (1, at(5), 95.0), (1, at(7), 85.0), (1, at(8), 10.0)]
    )
    fused = C.fuse_sources(primary, fallback, SBP, Params())
    assert rows(fused, "ts", "final_sbp", "sbp_source") == [
        (at(1), None, "NA"),
        (at(1, 60), 120.0, "IBP"),
        (at(5), 95.0, "NIBP"),
        (at(7), 85.0, "NIBP"),
    ]


def test_flag_mode_leaves_the_fallback_unchecked(spark):
    primary = readings(spark, [(1, at(1), 100.0), (1, at(1, 60), 300.0)])
    fallback = readings(spark, [(1, at(8), 10.0)])
    fused = C.fuse_sources(primary, fallback, SBP, Params(), range_mode="flag")
    assert rows(fused, "ts", "final_sbp", "sbp_source") == [
        (at(1), None, "NA"), (at(1, 60), None, "NA"), (at(8), 10.0, "NIBP")
    ]


def test_mean_pressure_is_filled_from_the_other_two(spark):
    df = spark.createDataFrame(
        [(None, 120.0, 60.0), (90.0, 120.0, 60.0), (None, None, 60.0)],
        "final_map double, final_sbp double, final_dbp double",
    )
    assert [v for (v,) in rows(C.derive_map(df), "final_map")] == [80.0, 90.0, None]


def test_components_keep_instants_of_any(spark):
    items = {"sbp": (220050, 220179), "dbp": (220051, 220180), "map": (220052, 220181)}
    from icuflow.params import PRESSURE

    df = spark.createDataFrame(
        [(1, at(1), items["sbp"][1], 120.0), (1, at(1), items["dbp"][1], 60.0), (1, at(2), items["map"][1], 70.0)],
        "stay_id long, ts timestamp, itemid int, value double",
    )
    fused = C.clean_pressure(df, None, PRESSURE, Params())
    assert rows(fused, "ts", "final_sbp", "final_dbp", "final_map", "map_source") == [
        (at(1), 120.0, 60.0, 80.0, None), (at(2), None, None, 70.0, "NIBP")
    ]


def test_same_instant_union_and_guard(spark):
    df = readings(spark, [(1, at(1), 1.0), (1, at(2), 2.0)])
    assert rows(C.keep_if_same_instant(df, readings(spark, [(1, at(2), 0.0)])), "value") == [(2.0,)]
    assert C.union_distinct(df, df).count() == 2
    assert C.distinct_instants(df.union(df)).count() == 2
    with pytest.raises(ValueError, match="no rows for hr"):
        C.require_rows(df.filter(F.lit(False)), "hr")


def test_no_broadcast_is_forced_and_no_cross_join(spark):
    df = readings(spark, [(1, START + timedelta(hours=h), 1.0) for h in range(5)])
    plan = C.flag_near(df, df, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and "Cross" not in plan


def test_context_is_not_broadcast_to_the_readings(spark):
    df = readings(spark, [(n, at(n), 1.0) for n in range(6)] + [(6, None, 1.0), (None, at(0), 1.0)])
    near = readings(spark, [(n, at(n, 60 * n), 1.0) for n in range(4)])
    flagged = C.flag_near(df, near, 120, name="flag").select("stay_id", "flag")
    found = sorted((r for r in flagged.collect()), key=str)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in found] == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (None, 0)]


def test_hot_stay_is_split_over_buckets(spark):
    # One stay holds nearly all rows; its readings land in many groups.
    data = [(1, at(0, 30 * i), float(i % 7)) for i in range(3000)] + [(2, at(0), 1.0)]
    df = readings(spark, data)
    plan = C.rolling_stddev(df, 300)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stay_id" in plan and "_bucket" in plan.split("hashpartitioning(")[1].split(")")[0]
    assert C.rolling_stddev(df, 300).count() == len(data)
    flagged = C.flag_near(df, df, 60)
    assert flagged.count() == len(data) and flagged.filter("sedated_flag = 1").count() == len(data)


def test_infinite_values_have_a_place_in_the_quantiles(spark):
    from icuflow.functions.ordering import value_bucket

    values = [float("-inf"), -2.0, 0.0, 3.5, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    places = [r[0] for r in df.select(value_bucket(df["v"])).collect()]
    assert places == sorted(places) and None not in places


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("mode", ["filter", "flag"])
def test_pressure_in_one_pass_equals_the_joins(spark, mode):
    import random

    from icuflow.params import PRESSURE

    rnd = random.Random(mode)
    items = [i for c in PRESSURE for i in (*c.primary, *c.fallback)]
    data = [
        (rnd.randint(1, 3), at(rnd.randint(0, 30) / 3) if rnd.random() < 0.5 else at(2.999), rnd.choice(items), rnd.choice([None, 10.0, 60.0, 61.0, 90.0, 140.0]))
        for _ in range(120)
    ]
    df = spark.createDataFrame(data, "stay_id long, ts timestamp, itemid int, value double")
    parts = [
        C.fuse_sources(C.filter_channels(df, c.primary), C.filter_channels(df, c.fallback), c, Params(), range_mode=mode)
        for c in PRESSURE
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, ["stay_id", "ts"], "full_outer")
    names = ["stay_id", "ts"] + [n for c in PRESSURE for n in (f"final_{c.name}", f"{c.name}_source")]
    fused = C.clean_pressure(df, None, PRESSURE, Params(), range_mode=mode)
    assert rows(fused, *names) == rows(C.derive_map(joined), *names)
    assert rows(C.derive_map(C.combine_components(parts)), *names) == rows(C.derive_map(joined), *names)
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and _exchanges(fused) == 1


def test_components_without_key_or_instant_stay(spark):
    a = spark.createDataFrame([(None, at(1), 1.0), (None, at(1), 1.0), (1, None, 2.0)], "stay_id long, ts timestamp, a double")
    b = spark.createDataFrame([(None, at(1), 5.0), (2, at(2), 6.0)], "stay_id long, ts timestamp, b double")
    joined = a.join(b, ["stay_id", "ts"], "full_outer")
    assert rows(C.combine_components([a, b]), "stay_id", "ts", "a", "b") == rows(joined, "stay_id", "ts", "a", "b")


def test_low_values_in_one_sweep(spark):
    import random

    rnd = random.Random(3)
    kind = "stay_id long, ts timestamp, value double"

    def some(n):
        return [(rnd.choice([1, 2, None]), None if rnd.random() < 0.05 else at(0, rnd.randint(0, 40_000)), rnd.choice([None, 2.0, 6.0, 7.0])) for _ in range(n)]

    df, exact, near = spark.createDataFrame(some(300), kind), spark.createDataFrame(some(40), kind), spark.createDataFrame(some(12), kind)
    p = Params()
    normal, low = df.filter("value > 6"), df.filter("value <= 6")
    for e, n in ((exact, near), (exact, None), (None, near), (None, None)):
        parts = [normal]
        parts += [C.keep_if_same_instant(low, e)] if e is not None else []
        parts += [C.keep_if_near(low, n, p.near_seconds)] if n is not None else []
        got = C.clean_low_with_context(df, e, n, p)
        assert rows(got) == rows(C.union_distinct(*parts))
    swept = C.clean_low_with_context(df, exact, near, p)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(swept) == 1 and "Join" not in plan and plan.count("Window [") == 1
