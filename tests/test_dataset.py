"""From compressed CSV to the final dataset, checked against plain loops."""

import csv
import gzip
import json
import random
import statistics
from datetime import timedelta

import pytest
from conftest import at, rows

from icuflow.params import CHANNEL_ORDER, Params
from icuflow.plans import dataset as D
from icuflow.plans import model as M
from icuflow.sources import tables as T

P = Params(obs_bins=6, pred_bins=3, stride_bins=4, grace_bins=1, min_completeness=0.2)
COLUMNS = {n: [c.split()[0] for c in s.replace("\n", " ").split(",")] for n, s in T.EVENT_SCHEMAS.items()}
ITEMS = {
    220210: (0, 30), 220045: (15, 240), 223762: (32, 43), 223761: (90, 109), 220277: (65, 102),
    646: (65, 102), 220739: (1, 5), 223900: (1, 5), 220050: (90, 140), 220179: (40, 260),
    220051: (50, 80), 220180: (25, 160), 220052: (60, 100), 220181: (35, 210), 223848: (1, 1),
}


def write_csv(path, header, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(data)


def raw_tables(root, subjects=8):
    rng = random.Random(9)
    patients, admissions, stays, chart, inputs, procedures = [], [], [], [], [], []
    for s in range(1, subjects + 1):
        start = at(rng.randrange(48), rng.randrange(3600))
        end = start + timedelta(hours=rng.randrange(24, 40), minutes=30)
        death = start + timedelta(hours=13.5 + s % 3) if s % 2 else None
        hadm, stay = s * 10, s * 100
        patients.append((s, "FM"[s % 2], 15 if s == subjects else 30 + s, "x"))
        admissions.append((s, hadm, death or "not a time"))
        stays.append((s, hadm, stay, start, end))
        span = int((end - start).total_seconds()) + 7200

        def when(span=span, start=start):
            return start + timedelta(seconds=rng.randrange(0, span, 60) - 3600)

        for item, (lo, hi) in ITEMS.items():
            for _ in range(60 if item != 223848 else 3):
                value = round(rng.uniform(lo, hi), 1) if rng.random() > 0.05 else ""
                chart.append((s, hadm, stay, 1, when(), "", item, value, value, "u", ""))
        inputs += [
            dict(zip(("subject_id", "hadm_id", "stay_id", "starttime", "itemid"), (s, hadm, stay, when(), i)))
            for i in (221319, 1) for _ in range(2)
        ]
        procedures += [
            dict(zip(("subject_id", "hadm_id", "stay_id", "starttime", "itemid"), (s, hadm, stay, when(), 225792)))
            for _ in range(2)
        ]
    rng.shuffle(chart)
    write_csv(root / T.PATHS["patients"], ("subject_id", "gender", "anchor_age", "extra"), patients)
    write_csv(root / T.PATHS["admissions"], ("subject_id", "hadm_id", "deathtime"), admissions)
    write_csv(root / T.PATHS["icustays"], ("subject_id", "hadm_id", "stay_id", "intime", "outtime"), stays)
    write_csv(root / T.PATHS["chartevents"], COLUMNS["chartevents"], chart)
    for name, data in (("inputevents", inputs), ("procedureevents", procedures)):
        write_csv(root / T.PATHS[name], COLUMNS[name], [[d.get(c, "") for c in COLUMNS[name]] for d in data])
    return stays, admissions, chart, inputs, procedures


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    raw = raw_tables(root)
    landed = tmp_path_factory.mktemp("landed")
    report = T.ingest_raw(spark, str(root), str(landed))
    tables = {n: spark.read.parquet(str(landed / n)) for n in T.PATHS}
    return raw, report, D.build_dataset(tables, P), tables


def test_landing_report(spark, built, tmp_path):
    raw, report, _, tables = built
    counts = {r.name: (r.present, r.n_rows) for r in report.collect()}
    assert counts["chartevents"] == (True, len(raw[2])) and counts["patients"] == (True, 8)
    assert tables["admissions"].filter("deathtime IS NULL").count() == 4
    nothing = T.ingest_raw(spark, str(tmp_path), str(tmp_path / "out"))
    assert {r.present for r in nothing.collect()} == {False}


def test_short_header_is_refused(spark, tmp_path):
    write_csv(tmp_path / T.PATHS["chartevents"], COLUMNS["chartevents"][:5], [(1, 2, 3, 4, at(0))])
    with pytest.raises(Exception, match="(?i)header|column"):
        T.read_table(spark, str(tmp_path), "chartevents").collect()


def loops(raw):
    """Cleaned readings per stay and channel, by plain loops."""
    stays, admissions, chart, inputs, procedures = raw
    deaths = {a[0]: a[2] for a in admissions if not isinstance(a[2], str)}
    adults = [s for s in stays if s[0] != 8 and (s[0] not in deaths or deaths[s[0]] <= s[4])]
    keep = {s[2] for s in adults}
    by_item = {}
    for c in chart:
        if c[2] in keep:
            by_item.setdefault(c[6], []).append((c[2], c[4], None if c[8] == "" else c[8]))
    out = {}

    def ranged(channel, items, lo, hi, convert=lambda i, v: v):
        kept = [
            (s, t, convert(i, v)) for i in items for s, t, v in by_item[i] if v is not None
        ]
        out[channel] = [r for r in kept if lo <= r[2] <= hi]

    ranged("hr", [220045], 20, 230)
    ranged("spo2", [220277, 646], 70, 100)
    ranged("temp", [223762, 223761], 33, 42, lambda i, v: (v - 32) / 1.8 if i == 223761 else v)
    ranged("gcs", [220739, 223900], 3, 15)
    rr = [r for r in by_item[220210] if r[2] is not None and 0 < r[2] < 100]
    ordered = sorted(v for _, _, v in rr)
    lower, upper = (
        next(v for v in ordered if sum(x <= v for x in ordered) / len(ordered) >= q) for q in (0.01, 0.99)
    )
    vents = {(s, t) for s, t, _ in by_item[223848]}
    procs = [(p["stay_id"], p["starttime"]) for p in procedures]
    out["rr"] = {
        r for r in rr
        if lower <= r[2] <= upper and (
            r[2] > 6 or (r[0], r[1]) in vents
            or any(s == r[0] and abs((t - r[1]).total_seconds()) <= 3600 for s, t in procs)
        )
    }
    for name, (p, f, lo, hi) in {
        "sbp": (220050, 220179, 50, 250), "dbp": (220051, 220180, 30, 150), "map": (220052, 220181, 40, 200)
    }.items():
        primary = [r for r in by_item[p] if r[2] is not None and lo <= r[2] <= hi]
        fallback = [r for r in by_item[f] if r[2] is not None and lo <= r[2] <= hi]
        joined = []
        for s, t, v in primary:
            frame = [x for a, b, x in primary if a == s and 0 <= (t - b).total_seconds() <= 300]
            ok = len(frame) > 1 and statistics.stdev(frame) >= 2.0
            others = [x for a, b, x in fallback if (a, b) == (s, t)]
            joined += [(s, t, v if ok else o) for o in (others or [None])]
        have = {(s, t) for s, t, _ in primary}
        out[name] = joined + [r for r in fallback if (r[0], r[1]) not in have]
    sbp, dbp = ({} for _ in range(2))
    for store, name in ((sbp, "sbp"), (dbp, "dbp")):
        for s, t, v in out[name]:
            store.setdefault((s, t), []).append(v)
    maps = {}
    for s, t, v in out["map"]:
        maps.setdefault((s, t), []).append(v)
    fused = {n: [] for n in ("sbp", "dbp", "map")}
    for key in {*sbp, *dbp, *maps}:
        for a in sbp.get(key, [None]):
            for b in dbp.get(key, [None]):
                for m in maps.get(key, [None]):
                    if m is None and a is not None and b is not None:
                        m = (b * 2 + a) / 3.0
                    for n, v in (("sbp", a), ("dbp", b), ("map", m)):
                        fused[n].append((*key, v))
    out.update(fused)
    sedated = [(i["stay_id"], i["starttime"]) for i in inputs if i["itemid"] == 221319]
    flags = {
        (s, t): int(any(a == s and abs((b - t).total_seconds()) <= 14400 for a, b in sedated))
        for s, t, _ in out["gcs"]
    }
    return adults, deaths, out, flags


def test_readings_and_bins_match_loops(built):
    raw, _, result, _ = built
    adults, deaths, cleaned, flags = loops(raw)
    got = {}
    for r in result["readings"].collect():
        got.setdefault(r.channel, []).append((r.stay_id, r.ts, None if r.value is None else round(r.value, 6)))
    for channel in CHANNEL_ORDER:
        want = [(s, t, None if v is None else round(v, 6)) for s, t, v in cleaned[channel]]
        assert sorted(got[channel], key=str) == sorted(want, key=str), channel
    bins = {(r.stay_id, r.bin): r for r in result["bins"].collect()}
    n = 0
    for subject, hadm, stay, start, out in adults:
        end = deaths.get(subject) or out
        hour = 0
        while start + timedelta(hours=hour) < end:
            row = bins[(stay, hour)]
            low = start + timedelta(hours=hour)
            high = min(low + timedelta(hours=1), end)
            assert (row.bin_start, row.bin_end, row.hadm_id) == (low, high, hadm)
            for channel in CHANNEL_ORDER:
                vs = sorted(
                    (t, v) for s, t, v in cleaned[channel] if s == stay and v is not None and low <= t < high
                )
                if not vs:
                    assert row[f"{channel}_mean"] is None and row[f"{channel}_last"] is None
                    continue
                assert row[f"{channel}_mean"] == pytest.approx(statistics.fmean(v for _, v in vs))
                assert row[f"{channel}_last"] == pytest.approx(vs[-1][1])
                assert row[f"{channel}_min"] <= row[f"{channel}_mean"] <= row[f"{channel}_max"]
            in_bin = [flags[(s, t)] for s, t, _ in cleaned["gcs"] if s == stay and low <= t < high]
            assert row.sedated_flag == (max(in_bin) if in_bin else None)
            hour += 1
            n += 1
    assert n == len(bins)


def test_windows_and_dataset(built):
    _, _, result, _ = built
    dataset = result["dataset"].collect()
    assert dataset and {r.y for r in dataset} == {0, 1}
    assert result["feature_names"].count() == 32
    for r in dataset:
        assert len(r.x) == P.obs_bins and {len(step) for step in r.x} == {32}
        assert r.x[0][-3:] == [30.0 + r.subject_id, *((1.0, 0.0) if r.subject_id % 2 else (0.0, 1.0))]
    assert result["window_summary"].first().n_windows == len(dataset)


def test_missing_channel_fails(built):
    _, _, result, _ = built
    with pytest.raises(ValueError, match="no readings of hr"):
        D.require_channels(result["readings"].filter("channel <> 'hr'"))


def test_model_input_and_tables(built):
    _, _, result, _ = built
    parts = M.model_input(result["dataset"].withColumnRenamed("y", "target"), label="label")
    assert parts["train"].count() > 0 and parts["scaler"].count() == 32
    subjects = [{r.subject_id for r in parts[n].collect()} for n in ("train", "val", "test")]
    assert not (subjects[0] & subjects[2]) and not (subjects[0] & subjects[1])


def test_reports_and_imputed_dataset(built):
    _, _, result, _ = built
    counts = result["window_counts"].first()
    assert counts.created == result["windows"].count() and counts.total_possible >= counts.created
    assert result["attrition"].count() > 0 and result["class_balance"].count() == 1
    assert result["health"].first().x_inf == 0
    imputed = D.impute_dataset(result["bins"], result["windows"], result["cohort"], P)
    assert imputed.count() == result["dataset"].count() and set(imputed.columns) == set(result["dataset"].columns)


def test_cleaning_plan_pushes_items_down(built):
    _, _, result, tables = built
    plan = (
        D.ranged_readings(D.chart_readings(tables["chartevents"]), result["cohort"])
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PushedFilters: [In(itemid" in plan or "PushedFilters: [IsNotNull(itemid" in plan or "In(itemid" in plan
    assert "BatchEvalPython" not in plan


def test_sinks(spark, built, tmp_path):
    _, _, result, _ = built
    T.write_dataset(result["dataset"], result["feature_names"], str(tmp_path / "d"), files=2)
    back = T.read_parquet(spark, str(tmp_path / "d" / "windows"), ["stay_id", "window_id", "y"])
    assert back.count() == result["windows"].count() and back.columns == ["stay_id", "window_id", "y"]
    assert T.read_parquet(spark, str(tmp_path / "d" / "features")).count() == 32
    scores = spark.createDataFrame(
        [("m", s, h, 0, 0, 0.5) for s in (1, 2) for h in (0, 8)],
        "model string, subject_id long, obs_start_hour int, tiebreak long, y_true int, y_prob double",
    )
    tables = M.dashboard_tables(scores)
    T.write_documents(tables["trend_documents"], str(tmp_path / "docs"), per_key=True)
    (file,) = (tmp_path / "docs" / "subject_id=1").glob("*.txt")
    document = json.loads(file.read_text())
    assert [p["hour"] for p in document["predictions_timeline"]] == [0, 8]
    T.write_documents(tables["explanations"], str(tmp_path / "lines"))
    lines = [json.loads(x) for f in (tmp_path / "lines").glob("*.txt") for x in f.read_text().splitlines()]
    assert sorted(d["subject_id"] for d in lines) == [1, 2]
    assert rows(T.head_sample(scores.select("subject_id", "obs_start_hour"), 1, ["subject_id", "obs_start_hour"])) == [(1, 0)]
    assert {n: d.count() for n, d in M.evaluation_tables(scores).items()}["roc_curve"] == 2
