"""One query per operator over the given tables. The SQL they must equal is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icuflow.functions.cut import cut, work_folder
from icuflow.operators import bins as B
from icuflow.operators import clean as C
from icuflow.operators import cohort as D
from icuflow.operators import evaluate as J
from icuflow.operators import features as G
from icuflow.operators import quality as H
from icuflow.operators import risk as K
from icuflow.operators import sampling as S
from icuflow.operators import windows as W
from icuflow.params import Channel, PressureComponent, channel_features
from icuflow.registry import views as V
from icuflow.registry.session import prepare
from icuflow.registry.views import CHANNELS, DAY, PARAMS
from icuflow.sources import tables as X
from icuflow.streaming import alerts as A
from icuflow.streaming import bins as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLAG = ("sedated_flag", "purchase")
FEATURES = channel_features(CHANNELS, FLAG[0])
DROPPED = ("purchase_min", "purchase_max", "error_min", "error_max")
FINAL = G.feature_list(FEATURES, DROPPED)
VIEW = Channel("view", ("view",), 1.0, 20.0)
PRESSURE_LIKE = PressureComponent("sbp", ("view",), ("click",), 1.0, 60.0)
BLEND_WEIGHTS = (("F", 0.25), ("O", -0.5))


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places and show times without a zone, for comparison.

    Rounding goes through nine places, so that a mean that lies exactly half way
    does not depend on the last bit of a sum.
    """
    columns = []
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.TimestampType):
            columns.append(f"CAST({f.name} AS timestamp_ntz) AS {f.name}")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            columns.append(f"round(round(double({f.name}), 9), 6) + 0.0D AS {f.name}")
        else:
            columns.append(f.name)
    return df.selectExpr(*columns)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        prepare(spark)
        return tidy(fn(spark, root))

    QUERIES[fn.__name__] = run
    return fn


# Landing and sinks: the given tables in the shape of raw files, written, landed and read back.


def _raw_events(spark: SparkSession, root: str) -> DataFrame:
    """The readings as a raw event table, every column as text, in file order."""
    found = V.readings(spark, root).select(
        "stay_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("charttime"),
        (F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))).alias("itemid"),
        F.col("value").alias("valuenum"),
    )
    columns = T.StructType.fromDDL(X.EVENT_SCHEMAS["chartevents"]).fieldNames()
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def _raw_files(spark: SparkSession, root: str) -> str:
    folder = work_folder(spark, "raw")
    tables = {
        "patients": V.patients(spark, root),
        "admissions": V.admissions(spark, root),
        "icustays": V.icustays(spark, root),
        "chartevents": _raw_events(spark, root),
    }
    for name, df in tables.items():
        text = df.select(*[F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])
        text.write.option("header", True).option("compression", "gzip").csv(f"{folder}/{X.PATHS[name]}")
    return folder


@query
def landing_report(spark, root):
    return X.ingest_raw(spark, _raw_files(spark, root), work_folder(spark, "landed"))


@query
def read_events_csv(spark, root):
    return X.read_table(spark, _raw_files(spark, root), "chartevents").select(
        "stay_id", F.col("charttime").alias("ts"), "itemid", "valuenum"
    )


@query
def read_dimension_csv(spark, root):
    return X.read_dim(spark, _raw_files(spark, root), "patients")


@query
def dataset_roundtrip(spark, root):
    folder = work_folder(spark, "dataset")
    X.write_dataset(_windows(spark, root), G.feature_names(spark, FEATURES), folder, files=4)
    return X.read_parquet(spark, f"{folder}/windows", ["stay_id", "window_id", "label"])


@query
def documents_json(spark, root):
    folder = work_folder(spark, "documents")
    X.write_documents(K.explanation_docs(V.scores(spark, root)), folder)
    shape = "subject_id long, death_probability double, actual_death int"
    document = F.from_json("value", shape).alias("d")
    return spark.read.text(folder).select(document).select(
        F.col("d.death_probability").alias("death_probability"),
        F.col("d.actual_death").alias("actual_death"),
    )


# Inputs shared by the queries below.


def _channel(spark: SparkSession, root: str, *names: str) -> DataFrame:
    return C.filter_channels(V.readings(spark, root), names, "channel")


def _flagged(spark: SparkSession, root: str) -> DataFrame:
    """All readings; those of the flag channel know whether a signup is near."""
    flag, channel = FLAG
    flagged = C.flag_near(
        _channel(spark, root, channel),
        _channel(spark, root, "signup"),
        PARAMS.flag_seconds,
        name=flag,
    )
    others = V.readings(spark, root).filter(F.col("channel") != channel)
    return flagged.unionByName(others, allowMissingColumns=True)


def _stays(spark: SparkSession, root: str) -> DataFrame:
    """The stays as a stored table; they are derived from all readings."""
    return cut(V.stays(spark, root), "stays")


def _bins_of(spark: SparkSession, root: str, stays: DataFrame) -> DataFrame:
    return B.bin_all(_flagged(spark, root), stays, CHANNELS, PARAMS, FLAG, tie="event_id")


def _bins(spark: SparkSession, root: str) -> DataFrame:
    return _bins_of(spark, root, _stays(spark, root))


def _kept_bins(spark: SparkSession, root: str) -> DataFrame:
    """The bins as a stored table, for steps that read them more than once."""
    return cut(_bins(spark, root), "bins")


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    stays = _stays(spark, root)
    bins = cut(_bins_of(spark, root, stays), "bins")
    return W.candidate_windows(bins, stays, FEATURES, PARAMS, sequences=False)


def _windows(spark: SparkSession, root: str, sequences: bool = False) -> DataFrame:
    stays = _stays(spark, root)
    bins = cut(_bins_of(spark, root, stays), "bins")
    return W.build_windows(bins, stays, FEATURES, PARAMS, sequences)


def _kept_windows(spark: SparkSession, root: str, sequences: bool = False) -> DataFrame:
    return cut(_windows(spark, root, sequences), "windows")


def _statics(spark: SparkSession, root: str) -> DataFrame:
    """Age and gender of every stay; the patients grow too and would be broadcast for their compressed size."""
    people = D.one_hot(V.patients(spark, root), "gender", ("F", "M")).hint("merge")
    return V.stays(spark, root).select("subject_id", "stay_id").join(people, "subject_id").select(
        "subject_id", "stay_id", F.col("anchor_age").alias("age"), "gender_M", "gender_F"
    )


def _final(spark: SparkSession, root: str) -> DataFrame:
    return G.finalize(
        _windows(spark, root, sequences=True), _statics(spark, root), FEATURES, DROPPED
    )


def _splits(spark: SparkSession, root: str) -> DataFrame:
    windows = _kept_windows(spark, root)
    return S.assign_split(windows, S.split_subjects(windows))


def _keys() -> list[str]:
    return ["stay_id", "window_id"]


# Cohort


@query
def cohort_select(spark, root):
    return D.select_cohort(
        V.patients(spark, root), V.admissions(spark, root), V.icustays(spark, root), PARAMS
    )


@query
def cohort_first_row(spark, root):
    return D.select_cohort(
        V.patients(spark, root), V.admissions(spark, root), V.icustays(spark, root), PARAMS, "row"
    )


@query
def cohort_attrition(spark, root):
    return D.cohort_attrition(
        V.patients(spark, root), V.admissions(spark, root), V.icustays(spark, root), PARAMS
    )


@query
def join_dimensions(spark, root):
    joined = D.join_dimensions(
        V.patients(spark, root), V.admissions(spark, root), V.icustays(spark, root)
    )
    return D.with_stay_hours(joined)


@query
def one_hot(spark, root):
    return D.one_hot(V.patients(spark, root), "gender", ("F", "M"))


# Cleaning


@query
def channel_filter(spark, root):
    return _channel(spark, root, "view", "error")


@query
def clip_range(spark, root):
    return C.clip_range(_channel(spark, root, "view"), 1.0, 20.0, "neither")


@query
def clip_range_right(spark, root):
    return C.clip_range(_channel(spark, root, "view"), 0.0, 20.0, "right")


@query
def convert_units(spark, root):
    rows = C.convert_units(
        _channel(spark, root, "error", "view"), {"error": (32.0, 1.8)}, "channel"
    )
    return C.clip_range(rows, -15.0, 20.0)


@query
def clean_channel(spark, root):
    cohort = V.stays(spark, root).filter(F.col("deathtime").isNotNull())
    return C.clean_channel(V.readings(spark, root), cohort, VIEW, column="channel")


@query
def trim_quantiles(spark, root):
    return C.trim_quantiles(_channel(spark, root, "view"), PARAMS.trim_low, PARAMS.trim_high)


@query
def restrict_to_cohort(spark, root):
    cohort = D.select_cohort(
        V.patients(spark, root), V.admissions(spark, root), V.icustays(spark, root), PARAMS
    )
    people = cohort.select(F.col("subject_id").alias("stay_id"))
    return C.restrict_to(V.readings(spark, root), people)


@query
def low_with_context(spark, root):
    return C.clean_low_with_context(
        _channel(spark, root, "view"),
        _channel(spark, root, "error"),
        _channel(spark, root, "signup"),
        PARAMS,
    )


@query
def keep_if_near(spark, root):
    return C.keep_if_near(
        _channel(spark, root, "click"), _channel(spark, root, "signup"), PARAMS.near_seconds
    )


@query
def flag_near(spark, root):
    return C.flag_near(
        _channel(spark, root, "purchase"), _channel(spark, root, "signup"), PARAMS.flag_seconds
    )


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_trunc("day", "ts"))


@query
def semi_same_instant(spark, root):
    return C.keep_if_same_instant(
        _by_day(_channel(spark, root, "view")), _by_day(_channel(spark, root, "error")), ts="day"
    )


@query
def distinct_instants(spark, root):
    return C.distinct_instants(_by_day(_channel(spark, root, "signup")), ts="day")


@query
def union_distinct(spark, root):
    day = _by_day(_channel(spark, root, "view", "click")).select("stay_id", "channel", "day")
    other = _by_day(_channel(spark, root, "click", "error")).select("stay_id", "channel", "day")
    return C.union_distinct(day, other)


@query
def rolling_stddev(spark, root):
    return C.rolling_stddev(_channel(spark, root, "view"), PARAMS.flat_seconds)


@query
def flag_flatline(spark, root):
    rolled = C.rolling_stddev(_channel(spark, root, "view"), PARAMS.flat_seconds)
    return C.flag_flatline(rolled, PARAMS.flat_std)


def _one_per_day(df: DataFrame) -> DataFrame:
    """The latest row of each stay and day; instants never coincide in this data."""
    newest = F.max_by(F.struct("ts", "value", "event_id"), F.struct("ts", "event_id"))
    return _by_day(df).groupBy("stay_id", "day").agg(newest.alias("_r")).select(
        "stay_id", "day", "_r.*"
    )


def _component(spark, root, name: str, primary: str, fallback: str, mode: str = "filter"):
    component = PressureComponent(name, (primary,), (fallback,), 1.0, 60.0)
    return C.fuse_sources(
        _one_per_day(_channel(spark, root, primary)),
        _one_per_day(_channel(spark, root, fallback)),
        component,
        PARAMS,
        at="day",
        range_mode=mode,
    )


@query
def fuse_sources(spark, root):
    return _component(spark, root, "sbp", "view", "click")


@query
def fuse_sources_flagged(spark, root):
    return _component(spark, root, "sbp", "view", "click", "flag")


@query
def combine_components(spark, root):
    parts = [
        _component(spark, root, "sbp", "view", "click"),
        _component(spark, root, "dbp", "click", "signup"),
        _component(spark, root, "map", "error", "purchase"),
    ]
    return C.derive_map(C.combine_components(parts, ts="day"))


PRESSURE = (
    PressureComponent("sbp", ("view",), ("click",), 1.0, 60.0),
    PressureComponent("dbp", ("signup",), ("purchase",), 1.0, 60.0),
    PressureComponent("map", ("error",), ("click",), 1.0, 60.0),
)


def _pressure(spark, root, mode: str) -> DataFrame:
    """Instants are days here, so most hold several readings of a source."""
    rows = V.readings(spark, root).withColumn("ts", F.date_trunc("day", "ts"))
    cohort = V.stays(spark, root).filter("stay_id % 5 <> 0")
    return C.clean_pressure(rows, cohort, PRESSURE, PARAMS, column="channel", range_mode=mode)


@query
def clean_pressure(spark, root):
    return _pressure(spark, root, "filter")


@query
def clean_pressure_flagged(spark, root):
    return _pressure(spark, root, "flag")


@query
def require_rows(spark, root):
    return C.require_rows(_channel(spark, root, "view"), "view")


# Bins


@query
def bin_spine(spark, root):
    return B.bin_spine(V.stays(spark, root), PARAMS)


@query
def bin_spine_capped(spark, root):
    return B.bin_spine(V.stays(spark, root), replace(PARAMS, max_bins=10))


@query
def within_stay(spark, root):
    return B.within_stay(V.readings(spark, root), V.stays(spark, root)).select(
        "stay_id", "event_id", "ts", "channel", "value"
    )


@query
def assign_bin(spark, root):
    inside = B.within_stay(V.readings(spark, root), V.stays(spark, root))
    return B.assign_bin(inside, PARAMS).select("stay_id", "event_id", "ts", "bin")


@query
def present_stays(spark, root):
    inside = B.within_stay(V.readings(spark, root), V.stays(spark, root))
    return B.present_stays(B.bin_aggregate(inside, CHANNELS, PARAMS), CHANNELS)


@query
def bin_aggregate(spark, root):
    return _bins(spark, root)


@query
def merge_channels(spark, root):
    stays, tables = _stays(spark, root), []
    for channel in CHANNELS:
        tables.append(
            B.bin_all(
                _channel(spark, root, channel),
                stays,
                [channel],
                PARAMS,
                tie="event_id",
            ).drop("subject_id")
        )
    return B.merge_channels(tables)


@query
def coverage(spark, root):
    return B.coverage(_bins(spark, root))


@query
def coverage_summary(spark, root):
    return B.coverage_summary(B.coverage(_bins(spark, root)))


@query
def missing_rate(spark, root):
    return B.missing_rate(_bins(spark, root), FEATURES)


@query
def missing_per_column(spark, root):
    return H.missing_per_column(_bins(spark, root), FEATURES)


@query
def sampling_density(spark, root):
    return B.sampling_density(V.readings(spark, root))


# Windows


@query
def window_starts(spark, root):
    return W.window_starts(_bins(spark, root), PARAMS)


@query
def window_labels(spark, root):
    stays = _stays(spark, root)
    bounded = W.window_bounds(W.window_starts(B.bin_spine(stays, PARAMS), PARAMS), stays, PARAMS)
    return W.label_windows(bounded, PARAMS)


@query
def window_labels_outlast(spark, root):
    """Bins go on after the event, so that windows with an event inside occur."""
    stays = _stays(spark, root)
    spine = B.bin_spine(stays.withColumn("deathtime", F.lit(None).cast("timestamp")), PARAMS)
    bounded = W.window_bounds(W.window_starts(spine, PARAMS), stays, PARAMS)
    return W.label_windows(bounded, PARAMS).select(
        "stay_id", "window_id", "removed", "label"
    )


@query
def window_labels_plain(spark, root):
    return _candidates(spark, root).select("stay_id", "window_id", "label_plain")


@query
def window_completeness(spark, root):
    return _candidates(spark, root).select(
        "stay_id", "window_id", "total_values", "missing_values", "obs_completeness"
    )


@query
def window_completeness_rows(spark, root):
    bins = _kept_bins(spark, root)
    seen = bins.filter(W.filled_cells(FEATURES) > 0)
    return W.window_completeness(
        W.window_starts(bins, PARAMS), seen, FEATURES, PARAMS, "rows"
    ).select("stay_id", "window_id", "obs_completeness")


@query
def build_windows(spark, root):
    return _windows(spark, root)


@query
def window_stats(spark, root):
    return W.window_stats(_candidates(spark, root), PARAMS)


@query
def window_summary(spark, root):
    return W.window_summary(_windows(spark, root))


@query
def completeness_describe(spark, root):
    return W.completeness_describe(_candidates(spark, root))


@query
def completeness_profile(spark, root):
    return W.completeness_profile(_candidates(spark, root))


@query
def label_diff(spark, root):
    return W.label_diff(_windows(spark, root))


@query
def complete_windows(spark, root):
    kept = _candidates(spark, root).filter(~F.col("removed"))
    return W.filter_completeness(kept, PARAMS, only_negative=False).select(
        "stay_id", "window_id", "label", "obs_completeness"
    )


@query
def lost_positives(spark, root):
    kept = _candidates(spark, root).filter(~F.col("removed"))
    windows = W.filter_completeness(kept, PARAMS, only_negative=False)
    return W.lost_positives(windows, V.stays(spark, root))


@query
def sequences_tall(spark, root):
    stays = _stays(spark, root)
    bins = cut(_bins_of(spark, root, stays), "bins")
    windows = W.build_windows(bins, stays, FEATURES, PARAMS, sequences=False)
    return W.sequences_tall(windows, bins, FEATURES, PARAMS)


@query
def sequence_arrays(spark, root):
    windows = _windows(spark, root, sequences=True)
    return H.cells_tall(windows)


# Imputation and final dataset


@query
def ffill(spark, root):
    return G.ffill(_bins(spark, root).select("subject_id", "bin", *FEATURES), FEATURES)


@query
def fill_means(spark, root):
    return G.fill_means(_kept_bins(spark, root).select("subject_id", "bin", *FEATURES), FEATURES)


@query
def impute(spark, root):
    return G.impute(_kept_bins(spark, root).select("subject_id", "bin", *FEATURES), FEATURES)


@query
def missing_delta(spark, root):
    bins = _kept_bins(spark, root)
    return G.missing_delta(bins, G.impute(bins, FEATURES), FEATURES)


@query
def drop_matching(spark, root):
    return G.drop_matching(G.drop_features(_bins(spark, root), DROPPED), "_last|bin_")


@query
def sort_readings(spark, root):
    return G.sort_readings(
        V.readings(spark, root).select("stay_id", "ts", "value"), ("stay_id",)
    )


@query
def attach_static(spark, root):
    return G.attach_static(_windows(spark, root), _statics(spark, root)).select(
        "stay_id", "window_id", "label", "age", "gender_M", "gender_F"
    )


@query
def final_tall(spark, root):
    final = _final(spark, root)
    cells = H.cells_tall(final, ["stay_id", "window_id", "y"])
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 3))


@query
def feature_names(spark, root):
    """Feature names in order with how many cells of the dataset hold a value."""
    names = F.array(*[F.lit(n) for n in FINAL])
    return (
        H.per_position(_final(spark, root), lambda c, _: {"n_values": F.count(c)}, len(FINAL))
        .select("pos", F.get(names, F.col("pos")).alias("name"), "n_values")
    )


# Quality reports


@query
def tensor_health(spark, root):
    return H.tensor_health(_final(spark, root), y="y")


@query
def tensor_range(spark, root):
    return H.tensor_range(_windows(spark, root, sequences=True))


@query
def tensor_null_ratio(spark, root):
    return H.tensor_null_ratio(_final(spark, root))


@query
def top_null_window(spark, root):
    return H.top_null(_final(spark, root), "window")


@query
def top_null_step(spark, root):
    return H.top_null(_final(spark, root), "step")


@query
def top_null_feature(spark, root):
    return H.top_null(_final(spark, root), "feature", width=len(FINAL))


@query
def class_balance(spark, root):
    return H.class_balance(_windows(spark, root))


@query
def windows_by_class(spark, root):
    return H.windows_by_class(_windows(spark, root))


@query
def balance_band(spark, root):
    return H.balance_band(_windows(spark, root))


@query
def check_dataset(spark, root):
    return H.check_dataset(_final(spark, root), PARAMS, len(FINAL))


# Model input


@query
def subsample_windows(spark, root):
    return S.subsample_windows(_windows(spark, root)).select(
        "subject_id", "stay_id", "window_id", "obs_start_hour"
    )


@query
def split_subjects(spark, root):
    return S.split_subjects(_windows(spark, root))


@query
def split_leakage(spark, root):
    split = cut(_splits(spark, root))
    leaking = S.split_leakage(split).agg(F.count(F.lit(1)).alias("n")).scalar()
    return split.agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("split").alias("n_splits")
    ).withColumn("n_leaking", leaking)


@query
def undersample(spark, root):
    return S.undersample(_kept_windows(spark, root), ratio=0.10).select(*_keys(), "label")


@query
def undersample_train(spark, root):
    train = cut(_splits(spark, root).filter("split = 'train'"))
    return S.undersample(train, ratio=0.10, only_below=0.15).select(*_keys(), "label")


@query
def fit_scaler(spark, root):
    return S.fit_scaler(_windows(spark, root, sequences=True), names=FEATURES)


@query
def fit_scaler_skip(spark, root):
    return S.fit_scaler(_windows(spark, root, sequences=True), missing="skip", names=FEATURES)


@query
def apply_scaler(spark, root):
    windows = _kept_windows(spark, root, sequences=True)
    scaled = S.apply_scaler(windows, S.fit_scaler(windows, width=len(FEATURES)))
    return H.cells_tall(scaled)


@query
def class_weight(spark, root):
    return S.class_weight(_windows(spark, root))


@query
def dataset_facts(spark, root):
    return S.dataset_facts(_windows(spark, root))


# Evaluation


@query
def roc_curve(spark, root):
    return J.roc_curve(V.scores(spark, root)).withColumn(
        "threshold", F.when(F.col("threshold") < 2, F.col("threshold"))
    )


@query
def roc_curve_full(spark, root):
    return J.roc_curve(V.scores(spark, root), drop_intermediate=False).withColumn(
        "threshold", F.when(F.col("threshold") < 2, F.col("threshold"))
    )


@query
def roc_auc(spark, root):
    return J.roc_auc(V.scores(spark, root))


@query
def pr_curve(spark, root):
    return J.pr_curve(V.scores(spark, root))


@query
def average_precision(spark, root):
    return J.average_precision(V.scores(spark, root))


@query
def best_threshold(spark, root):
    return J.best_threshold(V.scores(spark, root))


@query
def best_threshold_free(spark, root):
    return J.best_threshold(V.scores(spark, root), None)


@query
def confusion(spark, root):
    return J.confusion(V.scores(spark, root), 0.5)


@query
def confusion_own_threshold(spark, root):
    scores = V.scores(spark, root)
    return J.confusion(scores, J.best_threshold(scores))


@query
def metrics(spark, root):
    return J.metrics(V.scores(spark, root))


@query
def threshold_sweep(spark, root):
    return J.threshold_sweep(V.scores(spark, root))


@query
def operating_points(spark, root):
    return J.operating_points(V.scores(spark, root))


@query
def calibration(spark, root):
    return J.calibration(V.scores(spark, root))


@query
def score_histogram(spark, root):
    return J.score_histogram(V.scores(spark, root))


@query
def compare_models(spark, root):
    return J.compare_models(J.metrics(V.scores(spark, root)))


@query
def compare_models_tall(spark, root):
    return J.compare_models_tall(J.metrics(V.scores(spark, root)))


@query
def rank_models(spark, root):
    return J.rank_models(J.metrics(V.scores(spark, root)), "auc_pr")


@query
def blend(spark, root):
    per_order = V.scores(spark, root).groupBy("model", "subject_id").agg(
        F.max("y_true").alias("y_true"), F.max("y_prob").alias("y_prob")
    )
    weights = spark.createDataFrame(BLEND_WEIGHTS, "model string, weight double")
    return J.blend(per_order, weights, ["subject_id"])


# Risk tables


@query
def risk_band(spark, root):
    scores = V.scores(spark, root)
    bands = [K.risk_band("y_prob", v).alias(v) for v in ("above", "from", "outside")]
    named = [b.alias(f"band_{i}") for i, b in enumerate(bands)]
    return scores.groupBy("y_prob").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "y_prob", "n_rows", *named
    )


@query
def alert_columns(spark, root):
    return K.alert_columns(V.scores(spark, root))


@query
def risk_timeline(spark, root):
    return K.risk_timeline(V.scores(spark, root)).select(
        "model", "subject_id", F.posexplode("timeline").alias("pos", "entry")
    ).select("model", "subject_id", "pos", "entry.*")


@query
def timeline_rows(spark, root):
    return K.timeline_rows(V.scores(spark, root)).select(
        "model", "subject_id", "obs_start_hour", "tiebreak", "y_prob", "place", "hour_count"
    )


@query
def risk_trend(spark, root):
    return K.risk_trend(V.scores(spark, root))


@query
def subject_risk(spark, root):
    return K.subject_risk(V.scores(spark, root))


@query
def high_risk(spark, root):
    return K.high_risk(V.scores(spark, root), 50)


@query
def high_risk_all(spark, root):
    return K.high_risk(V.scores(spark, root))


@query
def risk_summary(spark, root):
    scores = V.scores(spark, root)
    return K.risk_summary(scores, J.roc_auc(scores))


@query
def top_factors(spark, root):
    windows = _kept_windows(spark, root, sequences=True)
    scaled = S.apply_scaler(windows, S.fit_scaler(windows, width=len(FEATURES)))
    rounded = scaled.withColumn(
        "x", F.transform("x", lambda row: F.transform(row, lambda v: F.round(F.round(v, 9), 6)))
    )
    return K.top_factors(rounded, FEATURES, min_abs=0.1)


@query
def variance_importance(spark, root):
    return K.variance_importance(
        _windows(spark, root, sequences=True), V.scores(spark, root), FEATURES
    )


@query
def global_importance(spark, root):
    importance = K.variance_importance(
        _windows(spark, root, sequences=True), V.scores(spark, root), FEATURES
    )
    return K.global_importance(
        importance.withColumn("importance_score", F.round(F.round("importance_score", 9), 6))
    )


@query
def explanation_docs(spark, root):
    return K.explanation_docs(V.scores(spark, root)).select(
        "model",
        "subject_id",
        F.col("document.death_probability").alias("death_probability"),
        F.col("document.actual_death").alias("actual_death"),
        F.col("document.explanation.risk_level").alias("risk_level"),
        F.col("document.explanation.top_risk_factors")[0]["value"].alias("factor_value"),
    )


@query
def trend_docs(spark, root):
    return K.trend_docs(V.scores(spark, root)).select(
        "model",
        "subject_id",
        F.posexplode("document.predictions_timeline").alias("pos", "e"),
    ).select("model", "subject_id", "pos", F.col("e.hour").alias("hour"),
             F.col("e.death_probability").alias("death_probability"))


@query
def performance_table(spark, root):
    return K.performance_table(J.metrics(V.scores(spark, root)))


@query
def tile_snapshot(spark, root):
    latest = _bins(spark, root).groupBy("stay_id").agg(
        *[F.max_by(f, "bin").alias(f) for f in FEATURES]
    )
    tiled = K.tile_snapshot(latest, [*FEATURES, "not_measured"], PARAMS.obs_bins)
    return H.cells_tall(tiled, ["stay_id"])


@query
def score_linear(spark, root):
    windows = _kept_windows(spark, root, sequences=True)
    scaled = S.apply_scaler(windows, S.fit_scaler(windows, width=len(FEATURES)))
    weights = spark.createDataFrame(
        [(i, (i % 5 - 2) / 10.0) for i in range(len(FEATURES))], "pos int, weight double"
    )
    scored = K.score_linear(scaled, weights, intercept=-0.5)
    return scored.select(*_keys(), "y_prob")


# Streams


@query
def stream_bins(spark, root):
    raw = V.table(spark, root, "events")
    stream = spark.readStream.schema(raw.schema).parquet(f"{root}/events*.parquet")
    folder = work_folder(spark, "stream_bins")
    bins = L.stream_bins(
        V.readings_of(stream), _stays(spark, root), CHANNELS, PARAMS, DAY, tie="event_id"
    )
    L.write_changed_bins(bins, folder).awaitTermination()
    return L.newest_bins(spark, folder)


def _binned_in_parts(spark, root) -> str:
    """The readings land in four parts by time, a few of them one part too late."""
    folder = work_folder(spark, "closed_bins")
    stays = cut(V.stays(spark, root), "stays")
    stays.write.parquet(f"{folder}/stays")
    readings = _flagged(spark, root)
    day = F.date_diff("ts", F.lit(readings.agg(F.to_date(F.min("ts"))).first()[0]))
    part = F.least(F.floor(day / 8) + F.when(F.col("event_id") % 29 == 0, 1).otherwise(0), F.lit(3))
    for i in range(4):
        readings.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(readings.schema).parquet(f"{folder}/in")
        L.sort_readings(stream, stays, PARAMS, folder, DAY).awaitTermination()
        if i == 3:
            L.end_readings(spark, readings.schema, folder)
        known = spark.readStream.schema(stays.schema).parquet(f"{folder}/stays")
        L.write_closed_bins(
            spark, readings.schema, known, CHANNELS, PARAMS, folder, DAY, FLAG, "event_id"
        ).awaitTermination()
    return folder


@query
def stream_closed_bins(spark, root):
    return L.closed_bins(spark, _binned_in_parts(spark, root))


@query
def stream_late_readings(spark, root):
    late = L.late_readings(spark, _binned_in_parts(spark, root))
    return late.select("stay_id", "event_id", "ts", "channel", "value", "bin", "bin_start")


def _scored_in_parts(spark, root) -> str:
    """The scores land in four parts, mostly in order of the hour; the last part is late for most subjects."""
    scores = V.scores(spark, root)
    part = F.when(F.col("tiebreak") % 17 == 0, 3).otherwise(F.least(F.floor(F.col("obs_start_hour") / 3), F.lit(2)))
    folder = work_folder(spark, "stream_alerts")
    for i in range(4):
        scores.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(scores.schema).parquet(f"{folder}/in")
        A.write_alerts(stream, folder).awaitTermination()
    return folder


@query
def stream_alerts(spark, root):
    return A.read_alerts(spark, _scored_in_parts(spark, root))


@query
def stream_late_scores(spark, root):
    return A.read_late(spark, _scored_in_parts(spark, root))


@query
def batch_alerts(spark, root):
    return A.batch_alerts(V.scores(spark, root))
