"""Regular time series: stay-anchored bins, their merge and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icuflow.functions.time import MICROS, ceil_div, floor_div, hours_between, micros
from icuflow.params import Params, channel_features

STAY_COLUMNS = ("stay_id", "intime", "outtime", "deathtime")


def observation_end() -> Column:
    """A stay is observed until its event, or else until it ends."""
    return F.coalesce(F.col("deathtime"), F.col("outtime"))


def bin_count(p: Params) -> Column:
    """How many bins a stay has: whole stay rounded up, capped, stopping at the event."""
    width = p.bin_seconds * MICROS
    whole = ceil_div(micros("outtime") - micros("intime"), width)
    observed = ceil_div(micros(observation_end()) - micros("intime"), width)
    limits = [whole, observed] + ([F.lit(p.max_bins)] if p.max_bins is not None else [])
    return F.least(*limits).cast("int")


def within_stay(readings: DataFrame, stays: DataFrame) -> DataFrame:
    """Attach the stay and keep readings between its start and end, both included."""
    joined = readings.join(stays.select(*STAY_COLUMNS), "stay_id")
    return joined.filter(F.col("ts").between(F.col("intime"), F.col("outtime")))


def bin_spine(stays: DataFrame, p: Params) -> DataFrame:
    """One row per stay and bin, from the stay alone; the last bin ends with the stay."""
    width = p.bin_seconds * MICROS
    ids = [c for c in ("subject_id", "hadm_id", "stay_id") if c in stays.columns]
    start = micros("intime") + F.col("bin").cast("long") * width
    return (
        stays.withColumn("_n", bin_count(p))
        .filter(F.col("_n") > 0)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(
            *ids,
            "bin",
            F.timestamp_micros(start).alias("bin_start"),
            F.timestamp_micros(F.least(start + width, micros(observation_end()))).alias("bin_end"),
        )
    )


def assign_bin(inside: DataFrame, p: Params) -> DataFrame:
    """The bin of each reading, counted from the start of its stay.

    Missing for readings that no bin covers: after the event, beyond the cap,
    or at the very end of the last bin.
    """
    width = p.bin_seconds * MICROS
    position = floor_div(micros("ts") - micros("intime"), width).cast("int")
    covered = (F.col("ts") < observation_end()) & (position >= 0) & (position < bin_count(p))
    return inside.withColumn("bin", F.when(covered, position))


def _moment(df: DataFrame, tie: str | None) -> Column:
    """What orders readings: their instant, then ``tie``.

    A whole-number tie is packed behind the microseconds of the instant into one decimal, which a hash
    aggregate can hold; a struct would make it sort all readings.
    """
    if tie is None:
        return F.col("ts")
    if not isinstance(df.schema[tie].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct("ts", tie)
    least, width = (F.lit(str(n)).cast("decimal(20,0)") for n in (-(1 << 63), 2 * 10**19))
    rank = F.coalesce(F.col(tie).cast("decimal(20,0)"), least) - least
    return (micros("ts").cast("decimal(18,0)") * width + rank).cast("decimal(38,0)")


def _statistics(channel: str, at: str) -> list[Column]:
    mine = f"FILTER (WHERE channel = '{channel}')"
    known = f"FILTER (WHERE channel = '{channel}' AND value IS NOT NULL)"
    return [
        F.expr(f"avg(value) {mine} AS {channel}_mean"),
        F.expr(f"max_by(value, {at}) {known} AS {channel}_last"),
        F.expr(f"min(value) {mine} AS {channel}_min"),
        F.expr(f"max(value) {mine} AS {channel}_max"),
        F.expr(f"count(*) {mine} AS _rows_{channel}"),
    ]


def bin_aggregate(
    inside: DataFrame,
    channels: Sequence[str],
    p: Params,
    flag: tuple[str, str] | None = None,
    tie: str | None = None,
    plain_flag: bool = False,
) -> DataFrame:
    """Assign bins and aggregate. Rows of a stay that fall in no bin form the row without one."""
    return aggregate_bins(assign_bin(inside, p), channels, flag, tie, plain_flag)


def aggregate_bins(
    binned: DataFrame,
    channels: Sequence[str],
    flag: tuple[str, str] | None = None,
    tie: str | None = None,
    plain_flag: bool = False,
    keys: Sequence[str] = ("stay_id", "bin"),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Mean, last, min and max per stay, bin and channel in one pivoting aggregate.

    ``flag`` is ``(column, channel)``: any set flag among the channel's rows of
    the bin, missing when the channel has no value there (``plain_flag=True``
    gives 0 or 1 whenever it has a row). ``tie`` orders readings at the same
    instant, so that ``last`` does not depend on task order; the aggregate is hash
    based without it or with a whole-number tie. ``_rows_<channel>`` counts rows.
    """
    binned = binned.withColumn("_moment", _moment(binned, tie))
    aggs = [a for c in channels for a in _statistics(c, "_moment")]
    if flag is not None:
        name, channel = flag
        mine = F.col("channel") == channel
        seen = F.count(F.when(mine, F.lit(1) if plain_flag else F.col("value")))
        any_set = F.max(F.when(mine, F.coalesce(F.col(name), F.lit(0))))
        aggs.append(F.when(seen > 0, any_set).cast("int").alias(name))
    return binned.groupBy(*keys).agg(*aggs, *extra)


def present_stays(aggregated: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Stays that have at least one row of every channel inside the stay."""
    totals = aggregated.groupBy("stay_id").agg(*[F.sum(f"_rows_{c}").alias(c) for c in channels])
    every = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in channels])
    return totals.filter(every).select("stay_id")


def stay_channels(inside: DataFrame) -> DataFrame:
    """Which channels each stay has inside its period."""
    return inside.select("stay_id", "channel").distinct()


def bin_all(
    readings: DataFrame,
    stays: DataFrame,
    channels: Sequence[str],
    p: Params,
    flag: tuple[str, str] | None = None,
    tie: str | None = None,
    presence: dict[str, Sequence[str]] | None = None,
    plain_flag: bool = False,
) -> DataFrame:
    """Every bin of every stay that has all channels; bins without readings are empty.

    Equal to joining one table per channel on stay and bin, without the joins:
    the spine's rows go into the aggregate together with the readings, so a
    single pass over the readings gives full and empty bins alike. Which stays
    have all channels is then seen from the bins of the stay, at most the cap.

    ``presence`` maps a source to its channels when one row of any of them
    makes the source present (default: every channel on its own).
    """
    spine = bin_spine(stays, p)
    ids = [c for c in spine.columns if c not in ("stay_id", "bin")]
    binned = assign_bin(within_stay(readings, stays), p)
    columns = ["stay_id", "bin", "ts", "channel", "value"]
    columns += [c for c in (flag[0] if flag else None, tie) if c and c not in columns]
    together = binned.select(*columns).unionByName(spine, allowMissingColumns=True)
    aggregated = aggregate_bins(
        together, channels, flag, tie, plain_flag, extra=[F.max(c).alias(c) for c in ids]
    )
    sources = presence or {c: [c] for c in channels}
    counts = [" + ".join(f"_rows_{c}" for c in cs) for cs in sources.values()]
    has_all = F.expr(
        " AND ".join(f"sum({n}) OVER (PARTITION BY stay_id) > 0" for n in counts)
    )
    features = channel_features(channels, flag[0] if flag else None)
    head = [c for c in ids if c not in ("bin_start", "bin_end")]
    return (
        aggregated.withColumn("_all", has_all)
        .filter(F.col("_all") & F.col("bin").isNotNull())
        .select(*head, "stay_id", "bin", "bin_start", "bin_end", *features)
    )


def merge_channels(
    tables: Sequence[DataFrame],
    keys: Sequence[str] = ("stay_id", "bin", "bin_start", "bin_end"),
) -> DataFrame:
    """Inner join of per-channel bin tables on their keys."""
    return reduce(lambda a, b: a.join(b, list(keys)), tables)


def coverage(bins: DataFrame) -> DataFrame:
    """Per stay: first and last bin, number of bins, and the share of the range they fill."""
    per_stay = bins.groupBy("stay_id").agg(
        F.min("bin").alias("min_hour"),
        F.max("bin").alias("max_hour"),
        F.count("bin").alias("total_hours"),
        F.min("subject_id").alias("subject_id"),
    )
    return per_stay.withColumn("hour_range", F.col("max_hour") - F.col("min_hour") + 1).withColumn(
        "coverage_ratio", F.col("total_hours") / F.col("hour_range")
    )


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.agg(
        F.avg("coverage_ratio").alias("mean_coverage_ratio"),
        F.percentile("total_hours", 0.5).alias("median_total_hours"),
    )


def missing_rate(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Per column: missing share and count, total rows, and whether above the threshold."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.expr(f"count_if({c} IS NULL) AS {c}") for c in columns],
    )
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    rows = F.expr(f"stack({len(columns)}, {pairs}) AS (feature, missing_count)")
    rate = F.try_divide(F.col("missing_count"), F.col("total_count"))
    return (
        counts.select(F.col("_total").alias("total_count"), rows)
        .withColumn("missing_rate", rate)
        .withColumn("above_threshold", F.col("missing_rate") > threshold)
        .select("feature", "missing_rate", "missing_count", "total_count", "above_threshold")
    )


def sampling_density(
    df: DataFrame, key: str = "stay_id", ts: str = "ts"
) -> DataFrame:
    """Per stay: covered hours, number of readings, and mean hours between them."""
    spans = df.groupBy(key).agg(
        hours_between(F.min(ts), F.max(ts)).alias("time_span_hours"),
        F.count(F.lit(1)).alias("data_points"),
    )
    gap = F.when(
        F.col("data_points") > 1, F.col("time_span_hours") / (F.col("data_points") - 1)
    ).otherwise(0.0)
    return spans.withColumn("avg_interval_hours", gap)
