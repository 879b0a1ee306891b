import random

from conftest import at, rows

from icuflow.operators import bins as B
from icuflow.params import Params

STAY = "subject_id long, stay_id long, intime timestamp, outtime timestamp, deathtime timestamp"
READING = "stay_id long, ts timestamp, channel string, value double, n long"
P = Params()


def test_spine_clamps_stops_and_caps(spark):
    stays = spark.createDataFrame(
        [
            (1, 1, at(0), at(25.5), None),
            (2, 2, at(0), at(30), at(10.25)),
            (3, 3, at(0), at(30), at(-1)),
            (4, 4, at(0), at(200), None),
            (5, 5, at(0), at(3), at(9)),
        ],
        STAY,
    )
    spine = B.bin_spine(stays, Params(max_bins=168))
    counts = {r.stay_id: r["count"] for r in spine.groupBy("stay_id").count().collect()}
    assert counts == {1: 26, 2: 11, 4: 168, 5: 3}
    last = {r.stay_id: r.bin_end for r in spine.collect() if r.bin == counts[r.stay_id] - 1}
    assert last[1] == at(25.5) and last[2] == at(10.25) and last[4] == at(168)
    assert B.bin_spine(stays, P).filter("stay_id = 4").count() == 200


def test_bin_edges(spark):
    stays = spark.createDataFrame([(1, 1, at(0), at(4), at(2.5))], STAY)
    times = {0: at(0), 1: at(1), 2: at(1, -0.001), 3: at(2.5), 4: at(3), 5: at(4), 6: at(4, 1)}
    df = spark.createDataFrame([(1, t, "hr", 1.0, n) for n, t in times.items()], READING)
    got = rows(B.assign_bin(B.within_stay(df, stays), P), "n", "bin")
    # After the event a reading is in no bin; after the stay it is gone.
    assert got == [(0, 0), (1, 1), (2, 0), (3, None), (4, None), (5, None)]


def test_presence_counts_rows_outside_bins_and_without_value(spark):
    stays = spark.createDataFrame(
        [(1, 1, at(0), at(4), at(2)), (2, 2, at(0), at(2), None)], STAY
    )
    df = spark.createDataFrame(
        [(1, at(0.5), "hr", 60.0, 1), (1, at(3), "rr", None, 2), (2, at(0.5), "hr", 70.0, 3)],
        READING,
    )
    bins = B.bin_all(df, stays, ["hr", "rr"], P)
    assert rows(bins, "stay_id", "bin", "hr_mean", "rr_mean") == [
        (1, 0, 60.0, None), (1, 1, None, None)
    ]
    assert B.bin_all(df, stays, ["hr", "rr"], P, presence={"any": ["hr", "rr"]}).count() == 4


def test_last_skips_missing_values_and_breaks_ties(spark):
    stays = spark.createDataFrame([(1, 1, at(0), at(1), None)], STAY)
    df = spark.createDataFrame(
        [(1, at(0.1), "hr", 1.0, 2), (1, at(0.1), "hr", 5.0, 1), (1, at(0.2), "hr", None, 3)], READING
    )
    bins = B.bin_all(df, stays, ["hr"], P, tie="n")
    assert rows(bins, "hr_mean", "hr_last", "hr_min", "hr_max") == [(3.0, 1.0, 1.0, 5.0)]


def test_flag_needs_a_value(spark):
    stays = spark.createDataFrame([(1, 1, at(0), at(3), None)], STAY)
    df = spark.createDataFrame(
        [
            (1, at(0.1), "gcs", 3.0, 0), (1, at(0.2), "gcs", 4.0, 1),
            (1, at(1.1), "gcs", None, 1), (1, at(2.1), "gcs", 5.0, 0),
        ],
        "stay_id long, ts timestamp, channel string, value double, f int",
    )
    bins = B.bin_all(df, stays, ["gcs"], P, ("f", "gcs"))
    assert rows(bins, "bin", "f") == [(0, 1), (1, None), (2, 0)]
    plain = B.bin_all(df, stays, ["gcs"], P, ("f", "gcs"), plain_flag=True)
    assert rows(plain, "bin", "f") == [(0, 1), (1, 1), (2, 0)]


def rounded(df):
    return df.selectExpr(
        *[f"round({c}, 6) AS {c}" if t == "double" else c for c, t in df.dtypes]
    )


def random_case(spark):
    rng = random.Random(11)
    stays = [
        (s, s, at(0, rng.randrange(3600)), at(rng.randrange(20, 60)),
         at(rng.randrange(10, 60)) if s % 3 == 0 else None)
        for s in range(8)
    ]
    data = [
        (rng.randrange(8), at(0, rng.randrange(70 * 3600)), rng.choice(["hr", "rr", "bp"]),
         rng.choice([None, round(rng.uniform(1, 99), 1)]), n)
        for n in range(1500)
    ]
    return stays, data, spark.createDataFrame(stays, STAY), spark.createDataFrame(data, READING)


def test_bins_match_brute_force(spark):
    stays, data, s_df, r_df = random_case(spark)
    channels = ["hr", "rr", "bp"]
    expected = {}
    for _, stay, start, out, death in stays:
        inside = [d for d in data if d[0] == stay and start <= d[1] <= out]
        if {d[2] for d in inside} != set(channels):
            continue
        end = death or out
        hour = 0
        while hour < 168 and (end - start).total_seconds() > hour * 3600:
            if (out - start).total_seconds() <= hour * 3600:
                break
            cell = []
            for c in channels:
                mine = sorted(
                    (d[1], d[4], d[3]) for d in inside
                    if d[2] == c and d[3] is not None and d[1] < end
                    and int((d[1] - start).total_seconds() // 3600) == hour
                )
                vs = [v for _, _, v in mine]
                cell += [round(sum(vs) / len(vs), 6), vs[-1], min(vs), max(vs)] if vs else [None] * 4
            expected[(stay, hour)] = cell
            hour += 1
    bins = B.bin_all(r_df, s_df, channels, P, tie="n")
    names = [f"{c}_{s}" for c in channels for s in ("mean", "last", "min", "max")]
    got = {
        (r.stay_id, r.bin): [r[n] if not n.endswith("mean") or r[n] is None else round(r[n], 6) for n in names]
        for r in bins.collect()
    }
    assert got == expected


def test_pivot_equals_joining_channels(spark):
    _, _, stays, readings = random_case(spark)
    channels = ["hr", "rr", "bp"]
    together = B.bin_all(readings, stays, channels, P, tie="n").drop("subject_id")
    parts = [
        B.bin_all(readings.filter(readings.channel == c), stays, [c], P, tie="n").drop("subject_id")
        for c in channels
    ]
    joined = B.merge_channels(parts).select(*together.columns)
    assert rows(rounded(together)) == rows(rounded(joined))


def test_reports(spark):
    df = spark.createDataFrame(
        [(1, 7, 0, 1.0, None), (1, 7, 1, None, None), (1, 7, 3, 3.0, None), (2, 8, 5, 1.0, None)],
        "stay_id long, subject_id long, bin int, a double, b double",
    )
    covered = B.coverage(df)
    assert rows(covered, "stay_id", "total_hours", "hour_range", "coverage_ratio") == [
        (1, 3, 4, 0.75), (2, 1, 1, 1.0)
    ]
    assert rows(B.coverage_summary(covered)) == [(0.875, 2.0)]
    assert rows(B.missing_rate(df, ["a", "b"])) == [("a", 0.25, 1, 4, False), ("b", 1.0, 4, 4, True)]
    times = spark.createDataFrame(
        [(1, at(0)), (1, at(4)), (1, at(6)), (2, at(1))], "stay_id long, ts timestamp"
    )
    assert rows(B.sampling_density(times)) == [(1, 6.0, 3, 3.0), (2, 0.0, 1, 0.0)]


def test_readings_are_scanned_once(spark, tmp_path):
    _, _, stays, readings = random_case(spark)
    readings.write.parquet(str(tmp_path / "r"))
    stays.write.parquet(str(tmp_path / "s"))
    bins = B.bin_all(
        spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "s")),
        ["hr", "rr", "bp"], P, tie="n",
    )
    plan = bins._jdf.queryExecution().executedPlan().toString()
    assert plan.count(str(tmp_path / "r")) == 1
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_whole_number_ties_need_no_sort(spark):
    data = [(1, 0, at(1), "hr", 5.0, 7), (1, 0, at(1), "hr", 6.0, -9), (1, 0, at(1), "hr", 4.0, None), (1, 0, at(0.5), "hr", 9.0, 1 << 62), (1, 1, at(2), "hr", 1.0, None)]
    df = spark.createDataFrame(data, "stay_id long, bin int, ts timestamp, channel string, value double, event_id long")
    made = B.aggregate_bins(df, ["hr"], tie="event_id")
    assert rows(made, "bin", "hr_last") == [(0, 5.0), (1, 1.0)]
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(B.aggregate_bins(df, ["hr"], tie="value"), "bin", "hr_last") == [(0, 6.0), (1, 1.0)]
