"""Bins of a stream of readings.

``stream_bins`` keeps changed bins up to date. ``sort_readings`` and ``write_closed_bins`` together write every bin once,
when it is closed: empty ones too, and readings that come later than that go to a table of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from icuflow.functions.time import MICROS, micros, shift
from icuflow.operators.bins import aggregate_bins, assign_bin, bin_spine, within_stay
from icuflow.params import Params, channel_features
from icuflow.streaming.state import rocksdb


def _timed(readings: DataFrame, stays: DataFrame, p: Params) -> DataFrame:
    """Readings of a bin, with the start of the bin as event time."""
    binned = assign_bin(within_stay(readings, stays), p).filter(F.col("bin").isNotNull())
    return binned.withColumn("bin_start", shift("intime", F.col("bin").cast("long") * p.bin_seconds))


def stream_bins(
    readings: DataFrame,
    stays: DataFrame,
    channels: Sequence[str],
    p: Params,
    lateness_seconds: int = 3600,
    flag: tuple[str, str] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Non-empty bins of a reading stream.

    Bins are anchored at the stay's start, so the event time is the start of
    the bin rather than a clock window. A bin's state is dropped once its whole
    width and the allowed lateness have passed.
    """
    timed = _timed(readings, stays, p).withWatermark("bin_start", f"{p.bin_seconds + lateness_seconds} seconds")
    aggregated = aggregate_bins(
        timed, channels, flag, tie, keys=("stay_id", "bin", "bin_start")
    )
    features = channel_features(channels, flag[0] if flag else None)
    return aggregated.select("stay_id", "bin", "bin_start", *features)


def write_changed_bins(bins: DataFrame, folder: str) -> StreamingQuery:
    """Write each batch's changed bins to ``folder/bins``, one sub-folder per batch.

    A batch that is run again replaces its own sub-folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bins/batch={batch_id}")

    return (
        bins.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def newest_bins(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every bin written by ``write_changed_bins``."""
    written = spark.read.parquet(f"{folder}/bins")
    values = [c for c in written.columns if c not in ("stay_id", "bin", "batch")]
    return (
        written.groupBy("stay_id", "bin")
        .agg(F.max_by(F.struct(*values), "batch").alias("_row"))
        .select("stay_id", "bin", "_row.*")
    )


def sort_readings(
    readings: DataFrame, stays: DataFrame, p: Params, folder: str, lateness_seconds: int = 3600
) -> StreamingQuery:
    """Write each batch's binned readings to ``folder/on_time``, or to ``folder/late`` where their bin is closed.

    A bin closes once its width and the lateness have passed since the latest bin start of earlier
    batches; that one instant is all that is kept between batches. A batch that is run again replaces its own sub-folders.
    """
    delay = p.bin_seconds + lateness_seconds

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = None
        if batch_id > 0:
            latest = spark.read.parquet(f"{folder}/latest/batch={batch_id - 1}").first()["latest"]
        timed = _timed(batch, stays, p).persist()
        closed = F.lit(False) if latest is None else micros("bin_start") <= latest - delay * MICROS
        columns = [*batch.columns, "bin", "bin_start"]
        timed.filter(closed).select(*columns).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        timed.filter(~closed).select(*columns).write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch_id}")
        newest = timed.agg(F.greatest(F.max(micros("bin_start")), F.lit(latest).cast("long")).alias("latest"))
        newest.write.mode("overwrite").parquet(f"{folder}/latest/batch={batch_id}")
        timed.unpersist()

    return (
        readings.writeStream.option("checkpointLocation", f"{folder}/sort_state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _binned_schema(readings: T.StructType) -> T.StructType:
    more = [T.StructField("bin", T.IntegerType()), T.StructField("bin_start", T.TimestampType())]
    return T.StructType([*readings.fields, *more])


def write_closed_bins(
    spark: SparkSession,
    readings: T.StructType,
    stays: DataFrame,
    channels: Sequence[str],
    p: Params,
    folder: str,
    lateness_seconds: int = 3600,
    flag: tuple[str, str] | None = None,
    tie: str | None = None,
) -> StreamingQuery:
    """Append the bins that are closed to ``folder/closed``, each once, those without readings included.

    ``stays`` is a stream of stays: their bins enter the state as rows without a reading, so an open bin is one state row and
    empty bins close with the others. Readings (of this schema) are those sorted into ``folder/on_time``.
    Only readings move the watermark, so a bin stays open until they have passed it.
    A stay must be known before its first bin closes.
    """
    timed = _binned_schema(readings)
    seen = spark.readStream.schema(timed).option("recursiveFileLookup", "true").parquet(f"{folder}/on_time")
    seen = seen.select(*timed.names).withWatermark("bin_start", f"{p.bin_seconds + lateness_seconds} seconds")
    spine = bin_spine(stays, p)
    ids = [c for c in spine.columns if c not in ("stay_id", "bin", "bin_start")]
    together = seen.unionByName(spine, allowMissingColumns=True)
    keys = ("stay_id", "bin", "bin_start")
    whole = aggregate_bins(together, channels, flag, tie, keys=keys, extra=[F.max(c).alias(c) for c in ids])
    features = channel_features(channels, flag[0] if flag else None)
    with rocksdb(spark):
        return (
            whole.select(*keys, *ids, *features)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{folder}/closed")
            .option("checkpointLocation", f"{folder}/close_state")
            .trigger(availableNow=True)
            .start()
        )


def end_readings(spark: SparkSession, readings: T.StructType, folder: str) -> None:
    """Tell ``write_closed_bins`` that no reading follows: a row without stay, later than all, closes every bin."""
    timed = _binned_schema(readings)
    end = spark.createDataFrame([(None,) * len(timed)], timed).withColumn("bin_start", F.lit("9999-01-01").cast("timestamp"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/on_time/end")


def closed_bins(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/closed")


def late_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The readings whose bin was closed when they came."""
    return spark.read.parquet(f"{folder}/late").drop("batch")
