"""Cohort selection: dimension joins, first stay per subject, validity filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.time import hours_between
from icuflow.params import Params

COHORT_COLUMNS = (
    "subject_id",
    "hadm_id",
    "stay_id",
    "age",
    "gender_F",
    "gender_M",
    "intime",
    "outtime",
    "deathtime",
    "icu_los_hours",
)
_ORDER = ("intime", "stay_id")


def with_stay_hours(
    df: DataFrame, start: str = "intime", end: str = "outtime", name: str = "icu_los_hours"
) -> DataFrame:
    return df.withColumn(name, hours_between(start, end))


def filter_min_age(patients: DataFrame, min_age: int, age: str = "anchor_age") -> DataFrame:
    return patients.filter(F.col(age) >= min_age)


def join_dimensions(patients: DataFrame, admissions: DataFrame, stays: DataFrame) -> DataFrame:
    """Every stay with its admission and subject; inner on both."""
    return (
        admissions.select("subject_id", "hadm_id", "deathtime")
        .join(patients.select("subject_id", "anchor_age", "gender"), "subject_id")
        .join(
            stays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime"),
            ["subject_id", "hadm_id"],
        )
    )


def first_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    mode: str = "column",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per group.

    ``column`` takes the first non-null value of every column on its own, so a
    value may come from a later row; ``row`` keeps the first row as it is.
    Both are plain aggregates, so a very large group is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[F.col(c) for c in order])
    if mode == "row":
        first = F.min_by(F.struct(*[F.col(c) for c in rest]), position).alias("_first")
        grouped = df.groupBy(*keys).agg(first, *extra)
        others = [c for c in grouped.columns if c not in keys and c != "_first"]
        return grouped.select(*keys, "_first.*", *others)
    if mode == "column":
        firsts = [
            F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in rest
        ]
        return df.groupBy(*keys).agg(*firsts, *extra)
    raise ValueError(f"unknown mode {mode!r}")


def _stay_length_ok(p: Params) -> Column:
    return F.col("icu_los_hours").between(p.min_stay_hours, p.max_stay_hours)


def _event_end_ok() -> Column:
    return F.col("deathtime").isNull() | (F.col("deathtime") <= F.col("outtime"))


def filter_stay_length(df: DataFrame, p: Params) -> DataFrame:
    return df.filter(_stay_length_ok(p))


def filter_event_end(df: DataFrame) -> DataFrame:
    """Keep stays without an event, or whose event is not after the end of the stay."""
    return df.filter(_event_end_ok())


def one_hot(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """A 0/1 column per value of a fixed domain; values not seen give all zeros."""
    return df.withColumns(
        {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in domain}
    )


def select_cohort(
    patients: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    p: Params = Params(),
    mode: str = "column",
) -> DataFrame:
    """First stay of every adult, with a valid length and event end: one row per subject."""
    adults = filter_min_age(patients, p.min_age)
    merged = with_stay_hours(join_dimensions(adults, admissions, stays))
    firsts = first_per_group(merged, ["subject_id"], _ORDER, mode)
    kept = filter_event_end(filter_stay_length(firsts, p))
    return one_hot(kept, "gender", ("F", "M")).withColumnRenamed("anchor_age", "age").select(
        *COHORT_COLUMNS
    )


def cohort_attrition(
    patients: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    p: Params = Params(),
    mode: str = "column",
) -> DataFrame:
    """Rows left after every selection step; the last step also has the event rate."""
    adults = filter_min_age(patients, p.min_age)
    merged = with_stay_hours(join_dimensions(adults, admissions, stays))
    firsts = first_per_group(
        merged, ["subject_id"], _ORDER, mode, extra=[F.count(F.lit(1)).alias("_rows")]
    )
    length_ok = _stay_length_ok(p)
    valid = length_ok & _event_end_ok()
    counts = firsts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("merged"),
        F.count(F.lit(1)).alias("first"),
        F.count_if(length_ok).alias("length"),
        F.count_if(valid).alias("valid"),
        F.avg(F.when(valid, F.col("deathtime").isNotNull().cast("int"))).alias("rate"),
    )
    none = F.lit(None).cast("double")
    steps = [
        (2, "merged", F.col("merged"), none),
        (3, "first_stays", F.col("first"), none),
        (4, "stay_length", F.col("length"), none),
        (5, "event_end", F.col("valid"), F.col("rate")),
    ]
    rows = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(no).alias("step_no"),
                        F.lit(step).alias("step"),
                        n.cast("long").alias("n_rows"),
                        rate.alias("event_rate"),
                    )
                    for no, step, n, rate in steps
                ]
            )
        )
    )
    adult_row = adults.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(1).alias("step_no"), F.lit("adults").alias("step"), "n_rows", none.alias("event_rate")
    )
    return adult_row.unionByName(rows)
