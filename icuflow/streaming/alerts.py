"""Alerts on a stream of scores: a row whenever a subject's risk band changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from icuflow.operators.risk import alert_columns, risk_band
from icuflow.streaming.state import rocksdb

_SUBJECT = ("model", "subject_id")
_ORDER = ("obs_start_hour", "tiebreak", "y_prob")
_ROW = "model string, subject_id long, obs_start_hour int, tiebreak long, y_prob double, risk_level string"
_STATE = "obs_start_hour int, tiebreak long, y_prob double, risk_level string"


def band_changes(scores: DataFrame) -> DataFrame:
    """Scores whose band differs from the subject's score before, the first one included.

    A subject has a few dozen windows at most.
    """
    before = F.lag("risk_level").over(W.partitionBy(*_SUBJECT).orderBy(*_ORDER))
    return (
        scores.withColumn("risk_level", risk_band("y_prob"))
        .withColumn("_before", before)
        .filter(~F.col("risk_level").eqNullSafe(F.col("_before")))
        .select(*_SUBJECT, *_ORDER, "risk_level")
    )


def batch_alerts(scores: DataFrame) -> DataFrame:
    """All alerts of a stored table."""
    return alert_columns(band_changes(scores))


def changes(scores: DataFrame, forget_after: str | None = None) -> DataFrame:
    """Band changes of a stream, and with ``late`` the scores that come before their subject's last one.

    A batch reads and writes the state of its own subjects only. The state of a subject is its scores, a few dozen
    at most, with the time of the batch that brought them; all work on it is done by column functions. With
    ``forget_after`` (``"30 days"``) a subject without a score for that long is forgotten, and its next score then
    alerts as if it were the first; that needs a timer, so a Python function sees each subject, many times slower.
    """
    banded = scores.select(
        F.col("model").cast("string"),
        F.col("subject_id").cast("long"),
        F.col("obs_start_hour").cast("int"),
        F.col("tiebreak").cast("long"),
        F.col("y_prob").cast("double"),
        risk_band("y_prob").alias("risk_level"),
    )
    return _timed_changes(banded, forget_after) if forget_after else _native_changes(banded)


def _native_changes(banded: DataFrame) -> DataFrame:
    now = F.unix_micros(F.current_timestamp())  # in a stream the time of the batch, also when it is run again
    entry = F.struct(F.struct(*_ORDER, "risk_level").alias("row"), "at")
    held = banded.withColumn("at", now).groupBy(*_SUBJECT).agg(F.collect_list(entry).alias("held")).withColumn("now", now)
    rows = lambda own: F.transform(F.filter("held", lambda e: (e["at"] == F.col("now")) == F.lit(own)), lambda e: e["row"])
    judged = held.select(*_SUBJECT, F.array_max(rows(False)).alias("last"), F.array_sort(rows(True)).alias("own"))
    # In order, the late scores of a batch come first; any other follows the one before it, or else the last of earlier batches.
    before = F.expr("transform(own, (r, i) -> struct(r AS row, coalesce(r < last, false) AS late, greatest(last, get(own, i - 1)).risk_level AS level))")
    return (
        judged.select(*_SUBJECT, F.inline(before))
        .filter(F.col("late") | ~F.col("row.risk_level").eqNullSafe(F.col("level")))
        .select(*_SUBJECT, "row.*", "late")
    )


def _timed_changes(banded: DataFrame, forget_after: str) -> DataFrame:
    def step(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        columns = [*_ORDER, "risk_level"]
        scored = sorted(row for part in parts for row in part[columns].itertuples(index=False, name=None))
        out = []
        for row in scored:
            late = last is not None and row[:3] < last[:3]
            if late or last is None or row[3] != last[3]:
                out.append((*key, *row, late))
            if not late:
                last = row
        state.update(last)
        state.setTimeoutDuration(forget_after)
        if out:
            yield pd.DataFrame(out, columns=[*_SUBJECT, *columns, "late"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout
    return banded.groupBy(*_SUBJECT).applyInPandasWithState(step, f"{_ROW}, late boolean", _STATE, "append", timeout)


def write_alerts(scores: DataFrame, folder: str, forget_after: str | None = None) -> StreamingQuery:
    """Write each batch's alerts to ``folder/alerts``, and late scores to ``folder/late``, so none is lost silently.

    The state store is RocksDB and its changes go to the checkpoint, so a batch costs what its own subjects
    cost. A batch that is run again replaces its own sub-folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        alert_columns(batch.filter("NOT late").drop("late")).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch_id}")
        batch.filter("late").select(*_SUBJECT, *_ORDER).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        batch.unpersist()

    with rocksdb(scores.sparkSession):
        return (
            changes(scores, forget_after)
            .writeStream.outputMode("append" if forget_after else "update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/alerts").drop("batch")


def read_late(spark: SparkSession, folder: str) -> DataFrame:
    """The scores that came too late to make an alert."""
    return spark.read.parquet(f"{folder}/late").drop("batch")
