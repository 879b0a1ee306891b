"""The given tables shaped like clinical ones: dimensions, readings, stays and scores.

The same shapes are written in SQL in ``registry.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.time import shift
from icuflow.params import Params

DAY = 86_400
CHANNELS = ("view", "click", "signup", "purchase", "error")

# The readings are sparse (about 67 per stay and month), so bins are days.
PARAMS = Params(
    bin_seconds=DAY,
    obs_bins=5,
    pred_bins=2,
    stride_bins=3,
    grace_bins=2,
    low_cut=3.0,
    near_seconds=DAY,
    flag_seconds=14_400,
    flat_seconds=172_800,
    flat_std=5.0,
    min_completeness=0.3,
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def patients(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        (F.col("c_custkey") * 7 % 90).cast("int").alias("anchor_age"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def admissions(spark: SparkSession, root: str) -> DataFrame:
    first_ship = (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min(F.col("l_shipdate").cast("timestamp")).alias("d0"))
    )
    return (
        table(spark, root, "orders")
        .join(first_ship, "o_orderkey")
        .select(
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            F.when(
                F.col("o_orderstatus") == "F",
                shift("d0", F.col("o_orderkey") % 40 * DAY),
            ).alias("deathtime"),
        )
    )


def icustays(spark: SparkSession, root: str) -> DataFrame:
    per_stay = (
        table(spark, root, "lineitem")
        .groupBy("l_orderkey", "l_partkey", "l_linenumber")
        .agg(
            F.min(F.col("l_shipdate").cast("timestamp")).alias("intime"),
            F.max("l_quantity").alias("quantity"),
        )
    )
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return per_stay.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"),
        F.col("l_orderkey").alias("hadm_id"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias(
            "stay_id"
        ),
        "intime",
        shift("intime", (F.col("quantity") * 20).cast("int") * 3600).alias("outtime"),
    )


def readings(spark: SparkSession, root: str) -> DataFrame:
    return readings_of(table(spark, root, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("stay_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("channel"),
        "value",
        "event_id",
    )


def stays(spark: SparkSession, root: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    spans = (
        table(spark, root, "events")
        .groupBy(F.col("user_id").alias("stay_id"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("outtime"))
    )
    return spans.select(
        "stay_id",
        F.col("stay_id").alias("subject_id"),
        F.date_trunc("day", "first_ts").alias("intime"),
        "outtime",
        F.when(
            F.col("stay_id") % 3 == 0, shift("outtime", -(F.col("stay_id") % 10) * DAY)
        ).alias("deathtime"),
    )


def scores(spark: SparkSession, root: str) -> DataFrame:
    return scores_of(table(spark, root, "lineitem"))


def scores_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_linestatus").alias("model"),
        F.col("l_orderkey").alias("subject_id"),
        F.col("l_linenumber").alias("obs_start_hour"),
        F.col("l_partkey").alias("tiebreak"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.round((F.col("l_quantity") + F.col("l_orderkey") % 50) / 101.0, 4).alias("y_prob"),
    )
