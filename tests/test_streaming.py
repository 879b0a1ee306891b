import pytest
from conftest import at, rows

from icuflow.functions.cut import work_folder
from icuflow.operators import bins as B
from icuflow.params import Params
from icuflow.streaming import alerts as A
from icuflow.streaming import bins as L

P = Params()
STAY = "subject_id long, stay_id long, intime timestamp, outtime timestamp, deathtime timestamp"
READING = "stay_id long, ts timestamp, channel string, value double"
SCORE = "model string, subject_id long, obs_start_hour int, tiebreak long, y_true int, y_prob double"


def test_bins_over_several_batches_equal_the_batch_job(spark, tmp_path):
    stays = spark.createDataFrame([(1, 1, at(0.5), at(9), None), (2, 2, at(0), at(9), at(5))], STAY)
    source = str(tmp_path / "in")
    parts = [
        [(1, at(0.6), "hr", 60.0), (2, at(0.1), "hr", 50.0)],
        [(1, at(1.2), "hr", 80.0), (2, at(2.5), "hr", 70.0), (2, at(7), "hr", 99.0)],
    ]
    for part in parts:
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(READING).parquet(source)
        bins = L.stream_bins(stream, stays, ["hr"], P, lateness_seconds=7200)
        L.write_changed_bins(bins, str(tmp_path)).awaitTermination()
    got = L.newest_bins(spark, str(tmp_path))
    whole = spark.createDataFrame([r for p in parts for r in p], READING)
    batch = B.bin_aggregate(B.within_stay(whole, stays), ["hr"], P).filter("bin IS NOT NULL")
    names = ("stay_id", "bin", "hr_mean", "hr_last", "hr_min", "hr_max")
    assert rows(got, *names) == rows(batch, *names)
    assert (1, 0, 70.0, 80.0, 60.0, 80.0) in rows(got, *names)


def test_late_readings_are_dropped(spark, tmp_path):
    stays = spark.createDataFrame([(1, 1, at(0), at(99), None)], STAY)
    source = str(tmp_path / "in")
    for part in ([(1, at(0.5), "hr", 60.0)], [(1, at(50), "hr", 70.0)], [(1, at(0.6), "hr", 99.0)]):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(READING).parquet(source)
        bins = L.stream_bins(stream, stays, ["hr"], P)
        L.write_changed_bins(bins, str(tmp_path)).awaitTermination()
    assert rows(L.newest_bins(spark, str(tmp_path)), "bin", "hr_mean") == [(0, 60.0), (50, 70.0)]


def test_alerts_remember_the_last_band(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [
        [("m", 1, 0, 0, 0, 0.1), ("m", 1, 8, 0, 0, 0.2), ("m", 2, 0, 0, 0, 0.9)],
        [("m", 1, 16, 0, 0, 0.25), ("m", 1, 24, 0, 0, 0.8), ("m", 3, 0, 0, 0, 0.5)],
        [("m", 1, 4, 0, 0, 0.5), ("m", 2, 8, 0, 0, 0.4)],
    ]
    for part in parts:
        spark.createDataFrame(part, SCORE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCORE).parquet(source)
        A.write_alerts(stream, str(tmp_path)).awaitTermination()
    assert rows(A.read_late(spark, str(tmp_path)), "subject_id", "obs_start_hour") == [(1, 4)]
    got = rows(A.read_alerts(spark, str(tmp_path)), "subject_id", "obs_start_hour", "risk_level")
    assert got == [
        (1, 0, "Low"), (1, 24, "High"), (2, 0, "High"), (2, 8, "Medium"), (3, 0, "Medium")
    ]


class Session:
    """The part of a session that ``work_folder`` asks."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.master = master
        self.sparkContext = self

    def getCheckpointDir(self):
        return None


def test_work_folder_follows_the_session(spark):
    assert work_folder(Session("yarn", "hdfs://shared/tmp"), "x").startswith("hdfs://shared/tmp/x-")
    assert work_folder(spark, "x") != work_folder(spark, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session("local[4]"), "x")


def test_alert_state_is_written_for_the_subjects_of_a_batch(spark, tmp_path):
    import json
    from pathlib import Path

    source = str(tmp_path / "in")
    parts = [[("m", s, 0, 0, 0, 0.1) for s in range(60)], [("m", 7, 8, 0, 0, 0.9)], [("m", 7, 4, 0, 0, 0.5), ("m", 9, 8, 0, 0, 0.1)]]
    progress = []
    for part in parts:
        spark.createDataFrame(part, SCORE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCORE).parquet(source)
        query = A.write_alerts(stream, str(tmp_path))
        query.awaitTermination()
        progress.append(json.loads(query.lastProgress.json)["stateOperators"][0])
    assert [p["numRowsUpdated"] for p in progress] == [60, 1, 2]
    assert "RocksDB" in json.dumps(progress) or any(Path(tmp_path, "state").rglob("*.changelog"))
    assert rows(A.read_late(spark, str(tmp_path)), "subject_id", "obs_start_hour") == [(7, 4)]


def test_bins_close_once_with_empty_ones_and_late_readings_apart(spark, tmp_path):
    folder = str(tmp_path)
    stays = spark.createDataFrame([(1, 1, at(0.5), at(9), None), (2, 2, at(0), at(9), at(5))], STAY)
    stays.write.parquet(f"{folder}/stays")
    parts = [
        [(1, at(0.6), "hr", 60.0), (2, at(0.1), "hr", 50.0)],
        [(1, at(3.7), "hr", 80.0), (2, at(2.5), "hr", 70.0), (2, at(7), "hr", 99.0)],
        [(1, at(0.7), "hr", 1.0), (1, at(3.6), "hr", 82.0), (2, at(4.5), "hr", 71.0)],
    ]
    closed = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(READING).parquet(f"{folder}/in")
        L.sort_readings(stream, stays, P, folder, 0).awaitTermination()
        if i == 2:
            L.end_readings(spark, stream.schema, folder)
        known = spark.readStream.schema(stays.schema).parquet(f"{folder}/stays")
        L.write_closed_bins(spark, stream.schema, known, ["hr"], P, folder, 0).awaitTermination()
        closed.append(L.closed_bins(spark, folder).count())
    assert closed[0] < closed[1] < closed[2]  # what is closed is written at once and stays
    assert rows(L.late_readings(spark, folder), "stay_id", "value") == [(1, 1.0)]
    kept = spark.createDataFrame([r for p in parts for r in p if r[3] != 1.0], READING)
    whole = B.bin_spine(stays, P).join(
        B.bin_aggregate(B.within_stay(kept, stays), ["hr"], P).filter("bin IS NOT NULL"), ["stay_id", "bin"], "left"
    )
    names = ("subject_id", "stay_id", "bin", "bin_start", "bin_end", "hr_mean", "hr_last", "hr_min", "hr_max")
    assert rows(L.closed_bins(spark, folder), *names) == rows(whole, *names)


def test_alerts_need_no_python_and_equal_a_walk_through_the_batches(spark, tmp_path):
    import random

    rnd, source, last, alerts, late = random.Random(5), str(tmp_path / "in"), {}, [], []
    for _ in range(3):
        part = [("m", rnd.randrange(8), rnd.randrange(6), rnd.randrange(2), 0, rnd.choice((0.1, 0.3, 0.5, 0.9))) for _ in range(40)]
        for m, s, hour, tie, _, p in sorted(part):
            row, band = (hour, tie, p), "High" if p > 0.7 else "Medium" if p > 0.3 else "Low"
            before = last.get(s)
            if before and row < before[0]:
                late.append((s, *row))
                continue
            if before is None or before[1] != band:
                alerts.append((s, *row, band))
            last[s] = (row, band)
        spark.createDataFrame(part, SCORE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCORE).parquet(source)
        assert "Pandas" not in A.changes(stream)._jdf.queryExecution().logical().toString()
        A.write_alerts(stream, str(tmp_path)).awaitTermination()
    key = ("subject_id", "obs_start_hour", "tiebreak", "y_prob")
    assert late and rows(A.read_late(spark, str(tmp_path)), *key) == sorted(late, key=lambda t: tuple(map(str, t)))
    assert rows(A.read_alerts(spark, str(tmp_path)), *key, "risk_level") == sorted(alerts, key=lambda t: tuple(map(str, t)))
