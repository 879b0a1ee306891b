"""Signal cleaning: range and quantile filters, context joins, source fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.ordering import quantile_bucket, running_totals
from icuflow.functions.time import floor_div, seconds
from icuflow.params import Channel, Params, PressureComponent

KEYS = ("stay_id",)


def filter_channels(df: DataFrame, ids: Sequence, column: str = "itemid") -> DataFrame:
    return df.filter(F.col(column).isin(*ids))


def restrict_to(df: DataFrame, cohort: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep rows whose keys are in the cohort.

    No broadcast is forced: the cohort grows with the data, so Spark broadcasts
    it only while its size is under the session's threshold and shuffles beyond.
    """
    return df.join(cohort.select(*keys), list(keys), "left_semi")


def in_range(value: Column, lo: float | None, hi: float | None, closed: str = "both") -> Column:
    """``lo`` to ``hi`` with both ends in, none, or only the left or the right one."""
    if closed not in ("both", "neither", "left", "right"):
        raise ValueError(f"unknown closed {closed!r}")
    tests = []
    if lo is not None:
        tests.append(value >= lo if closed in ("both", "left") else value > lo)
    if hi is not None:
        tests.append(value <= hi if closed in ("both", "right") else value < hi)
    return reduce(lambda a, b: a & b, tests, value.isNotNull())


def clip_range(
    df: DataFrame, lo: float | None, hi: float | None, closed: str = "both", value: str = "value"
) -> DataFrame:
    """Drop rows outside the range, and rows without a value."""
    return df.filter(in_range(F.col(value), lo, hi, closed))


def quantile_bounds(
    df: DataFrame, low: float, high: float, value: str = "value", method: str = "exact"
) -> DataFrame:
    """One row ``(lower, upper)``.

    ``exact`` takes the smallest value whose share of rows at or below it
    reaches the quantile. It counts equal values first and orders only the
    distinct ones, in parallel buckets. ``approx`` uses Spark's quantile sketch
    with a relative error of 0.001.
    """
    if method == "approx":
        return df.agg(
            F.percentile_approx(value, low, 1000).alias("lower"),
            F.percentile_approx(value, high, 1000).alias("upper"),
        )
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    cumulative = running_totals(counted, [], value, quantile_bucket(counted, [], value, ["n"]), ["n"])
    share = F.col("cum_n") / F.col("all_n")
    return cumulative.agg(
        F.min(F.when(share >= low, F.col(value))).alias("lower"),
        F.min(F.when(share >= high, F.col(value))).alias("upper"),
    )


def trim_quantiles(
    df: DataFrame, low: float, high: float, value: str = "value", method: str = "exact"
) -> DataFrame:
    """Keep values between two quantiles of the whole input, ends included."""
    bounds = quantile_bounds(df, low, high, value, method)
    limits = bounds.select(F.struct("lower", "upper").alias("limits")).scalar()
    return df.filter(
        (F.col(value) >= limits.getField("lower")) & (F.col(value) <= limits.getField("upper"))
    )


def converted(value: Column, channel_id: Column, rules: dict) -> Column:
    """``(value - offset) / divisor`` for ids with a rule, the value itself otherwise."""
    result = value
    for key, (offset, divisor) in rules.items():
        result = F.when(channel_id == key, (value - offset) / divisor).otherwise(result)
    return result


def convert_units(
    df: DataFrame, rules: dict, column: str = "itemid", value: str = "value", name: str = "value"
) -> DataFrame:
    return df.withColumn(name, converted(F.col(value), F.col(column), rules))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when a required input is empty. Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def clean_channel(
    readings: DataFrame,
    cohort: DataFrame | None,
    channel: Channel,
    keys: Sequence[str] = KEYS,
    column: str = "itemid",
    value: str = "value",
) -> DataFrame:
    """One channel: its ids, cohort stays, unit conversion, valid range."""
    return clean_channels(readings, cohort, [channel], keys, column, value).drop("channel")


def clean_channels(
    readings: DataFrame,
    cohort: DataFrame | None,
    channels: Sequence[Channel],
    keys: Sequence[str] = KEYS,
    column: str = "itemid",
    value: str = "value",
) -> DataFrame:
    """Several range-checked channels in one pass; adds the ``channel`` name."""
    ids = [i for c in channels for i in c.ids]
    rules = {k: r for c in channels for k, r in c.unit_rules.items()}
    name = F.lit(None).cast("string")
    valid = F.lit(False)
    for c in channels:
        mine = F.col(column).isin(*c.ids)
        name = F.when(mine, c.name).otherwise(name)
        valid = valid | (mine & in_range(F.col(value), c.lo, c.hi, c.closed))
    kept = filter_channels(readings, ids, column)
    if rules:
        kept = convert_units(kept, rules, column, value, value)
    for c in channels:
        if c.decimals is not None:
            mine = F.col(column).isin(*c.ids)
            shown = F.when(mine, F.round(value, c.decimals)).otherwise(F.col(value))
            kept = kept.withColumn(value, shown)
    kept = kept.filter(valid)
    if "channel" != column:
        kept = kept.withColumn("channel", name)
    return kept if cohort is None else restrict_to(kept, cohort, keys)


def distinct_instants(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    return df.select(*keys, ts).distinct()


def keep_if_same_instant(
    df: DataFrame, context: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts"
) -> DataFrame:
    return df.join(context.select(*keys, ts), [*keys, ts], "left_semi")


def context_reach(
    context: DataFrame, keys: Sequence[str], ts: str, tolerance_seconds: int
) -> DataFrame:
    """What a reading can see of the context from each time bucket, one row per bucket.

    Buckets are as wide as the tolerance. Everything in the reading's own
    bucket is in reach; of the bucket before only its latest instant matters,
    of the one after only its earliest. So the context shrinks to one row per
    (keys, bucket) and the join that follows can never multiply rows.
    """
    width = max(tolerance_seconds, 1)
    s = seconds(ts)
    own = context.filter(F.col(ts).isNotNull()).groupBy(
        *keys, floor_div(s, width).alias("_near")
    ).agg(F.min(s).alias("_first"), F.max(s).alias("_last"))
    empty = F.lit(None).cast("long")
    views = F.array(
        F.struct(F.col("_near").alias("_near"), F.lit(1).alias("_here"),
                 empty.alias("_before"), empty.alias("_after")),
        F.struct((F.col("_near") + 1).alias("_near"), F.lit(0).alias("_here"),
                 F.col("_last").alias("_before"), empty.alias("_after")),
        F.struct((F.col("_near") - 1).alias("_near"), F.lit(0).alias("_here"),
                 empty.alias("_before"), F.col("_first").alias("_after")),
    )
    return (
        own.select(*keys, F.inline(views))
        .groupBy(*keys, "_near")
        .agg(
            F.max("_here").alias("_here"),
            F.max("_before").alias("_before"),
            F.min("_after").alias("_after"),
        )
    )


def _in_reach(ts: Column, tolerance_seconds: int) -> Column:
    s = F.unix_seconds(ts.cast("timestamp"))
    return F.coalesce(
        (F.col("_here") == 1)
        | (s - F.col("_before") <= tolerance_seconds)
        | (F.col("_after") - s <= tolerance_seconds),
        F.lit(False),
    )


def flag_near(
    df: DataFrame,
    context: DataFrame,
    tolerance_seconds: int,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    name: str = "sedated_flag",
) -> DataFrame:
    """1 when any context instant of the same keys is within the tolerance, else 0.

    The context grows with the readings but compresses well, and would be broadcast for its
    compressed size; a merge join holds neither side.
    """
    reach = context_reach(context, keys, ts, tolerance_seconds)
    width = max(tolerance_seconds, 1)
    return (
        df.withColumn("_near", floor_div(seconds(ts), width))
        .join(reach.hint("merge"), [*keys, "_near"], "left")
        .select(
            *[F.col(c) for c in df.columns],
            _in_reach(F.col(ts), tolerance_seconds).cast("int").alias(name),
        )
    )


def keep_if_near(
    df: DataFrame,
    context: DataFrame,
    tolerance_seconds: int,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
) -> DataFrame:
    """Keep rows with a context instant of the same keys within the tolerance."""
    flagged = flag_near(df, context, tolerance_seconds, keys, ts, "_keep")
    return flagged.filter("_keep = 1").drop("_keep")


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def _sweep_events(context: DataFrame, keys: Sequence[str], ts: str, kind: str, reach: Column) -> DataFrame:
    """Context instants as events of the buckets they can reach."""
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in (*keys, ts)])
    rows = context.filter(known).select(*keys, ts).withColumn("_bucket", F.explode(reach))
    at = {"_near": F.when(F.lit(kind == "near"), seconds(ts)), "_same": F.when(F.lit(kind == "same"), F.lit(1))}
    return rows.select(*keys, F.col(ts).alias("_at"), "_bucket", *[c.alias(n) for n, c in at.items()], F.lit(None).cast("boolean").alias("_low"))


def clean_low_with_context(
    df: DataFrame,
    exact_context: DataFrame | None,
    near_context: DataFrame | None,
    p: Params,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Keep normal values, and low ones only with a context event; distinct rows.

    A low value stays when a context event has the same instant (``exact``) or
    lies within the tolerance (``near``). Readings and context are swept
    together in time order, in buckets as wide as the tolerance at least; near events
    are also put into the buckets beside theirs. Context is found and equal rows
    are merged in one shuffle, and ``df`` is read once.
    """
    width = max(p.near_seconds, 3600)
    own = floor_div(seconds(ts), width)
    names = [f"_c{i}" for i in range(len(df.columns))]
    low = F.col(value) <= p.low_cut
    readings = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias("_at"), own.alias("_bucket"), F.lit(None).cast("long").alias("_near"), F.lit(None).cast("int").alias("_same"),
        low.alias("_low"), F.struct(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)]).alias("_row"),
    )
    events = []
    if exact_context is not None:
        events.append(_sweep_events(exact_context, keys, ts, "same", F.array(own)))
    if near_context is not None:
        events.append(_sweep_events(near_context, keys, ts, "near", F.array(own - 1, own, own + 1)))
    swept = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [readings, *events])
    order = W.partitionBy(*keys, "_bucket").orderBy("_at")
    second = F.unix_seconds(F.col("_at").cast("timestamp"))
    before = F.max("_near").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min("_near").over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    same = F.max("_same").over(order.rangeBetween(W.currentRow, W.currentRow))
    near = (second - F.col("_before") <= p.near_seconds) | (F.col("_after") - second <= p.near_seconds)
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in (*keys, "_at")])
    kept = (
        swept.repartition(*keys, "_bucket")
        .select("*", before.alias("_before"), after.alias("_after"), same.alias("_exact"))
        .filter(F.col("_low").isNotNull())
        .filter(~F.col("_low") | (known & (F.col("_exact").isNotNull() | F.coalesce(near, F.lit(False)))))
    )
    # Merged by the sweep's own partitioning, so equal rows meet without another shuffle.
    merged = kept.groupBy(*keys, "_bucket", "_row").agg(F.count(F.lit(1)))
    return merged.select(*[F.col("_row")[n].alias(c) for c, n in zip(df.columns, names, strict=True)])


def rolling_stddev(
    df: DataFrame,
    window_seconds: int,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    value: str = "value",
    name: str = "rolling_std",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Sample standard deviation over the trailing time range, row itself and peers included.

    A stay is cut into time buckets at least as wide as the range. A row near
    the end of a bucket is copied once into the next one, where it only serves
    as history, so each bucket can be computed on its own and a stay with very
    many rows spreads over many tasks.
    """
    width = max(bucket_seconds or 3600, window_seconds, 1)
    s = seconds(ts)
    own = floor_div(s, width)
    spread = df.withColumn("_s", s).withColumn(
        "_bucket",
        F.explode(
            F.when(
                F.col("_s") + window_seconds >= (own + 1) * width, F.array(own, own + 1)
            ).otherwise(F.array(own))
        ),
    )
    frame = W.partitionBy(*keys, "_bucket").orderBy("_s").rangeBetween(-window_seconds, 0)
    return (
        spread.withColumn(name, F.stddev_samp(value).over(frame))
        .filter(F.col("_bucket") == floor_div(F.col("_s"), width))
        .drop("_s", "_bucket")
    )


def flag_flatline(
    df: DataFrame,
    threshold: float,
    std: str = "rolling_std",
    flag: str = "is_flat",
    valid: str = "is_valid",
) -> DataFrame:
    """Flat below the threshold; a missing deviation leaves both flags missing."""
    return df.withColumn(flag, F.col(std) < threshold).withColumn(valid, ~F.col(flag))


def prefer_source(
    df: DataFrame,
    primary: str,
    fallback: str,
    valid: str,
    value: str,
    source: str,
    labels: tuple[str, str, str] = ("IBP", "NIBP", "NA"),
) -> DataFrame:
    """The primary value when valid, else the fallback, with the name of the source used."""
    use_primary = F.col(valid) & F.col(primary).isNotNull()
    return df.withColumn(
        value, F.when(use_primary, F.col(primary)).otherwise(F.col(fallback))
    ).withColumn(
        source,
        F.when(use_primary, labels[0])
        .when(F.col(fallback).isNotNull(), labels[1])
        .otherwise(labels[2]),
    )


def fuse_sources(
    primary: DataFrame,
    fallback: DataFrame,
    component: PressureComponent,
    p: Params,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    value: str = "value",
    at: str | None = None,
    range_mode: str = "filter",
) -> DataFrame:
    """One component: ranges, flat-line check of the primary, full outer join, choice.

    ``at`` names the column that says which primary and fallback rows belong
    together (default: the instant). ``range_mode='flag'`` takes the deviation
    over all primary values and checks their range afterwards, and leaves the
    fallback unchecked.
    """
    if range_mode not in ("filter", "flag"):
        raise ValueError(f"unknown range_mode {range_mode!r}")
    at = at or ts
    name = component.name
    lo, hi = component.lo, component.hi
    if range_mode == "filter":
        primary = clip_range(primary, lo, hi, "both", value)
        fallback = clip_range(fallback, lo, hi, "both", value)
    checked = flag_flatline(
        rolling_stddev(primary, p.flat_seconds, keys, ts, value), p.flat_std
    )
    if range_mode == "flag":
        checked = checked.withColumn("is_valid", F.col(value).between(lo, hi) & F.col("is_valid"))
    left = checked.select(*keys, at, F.col(value).alias("_primary"), "is_valid")
    right = fallback.select(*keys, at, F.col(value).alias("_fallback"))
    merged = left.join(right, [*keys, at], "full_outer")
    chosen = prefer_source(
        merged, "_primary", "_fallback", "is_valid", f"final_{name}", f"{name}_source"
    )
    return chosen.select(*keys, at, f"final_{name}", f"{name}_source")


def combine_components(
    parts: Sequence[DataFrame], keys: Sequence[str] = KEYS, ts: str = "ts"
) -> DataFrame:
    """The full outer join of the parts on keys and instant, as one grouping.

    Rows of an instant are collected by part and multiplied out again, so an
    instant with several rows of a part gives the rows that the joins would give.
    Rows without a key or an instant meet nothing and stay as they are.
    """
    at = [*keys, ts]
    values = [[c for c in part.columns if c not in at] for part in parts]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in at])

    def tagged(i: int, part: DataFrame) -> DataFrame:
        row = F.struct(*values[i]).alias(f"_part{i}")
        alone = F.when(~known, F.xxhash64(F.lit(i), *part.columns))
        return part.select(*at, alone.alias("_alone"), row)

    rows = reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True),
        [tagged(i, part) for i, part in enumerate(parts)],
    )
    lists = [F.collect_list(f"_part{i}").alias(f"_part{i}") for i in range(len(parts))]
    rows = rows.groupBy(*at, "_alone").agg(*lists)
    for i in range(len(parts)):
        rows = rows.withColumn(f"_part{i}", F.explode_outer(f"_part{i}"))
    picked = [F.col(f"_part{i}")[c].alias(c) for i, cs in enumerate(values) for c in cs]
    return rows.select(*at, *picked)


def derive_map(
    df: DataFrame,
    mean: str = "final_map",
    systolic: str = "final_sbp",
    diastolic: str = "final_dbp",
) -> DataFrame:
    """A missing mean pressure becomes a third of systolic plus twice diastolic."""
    estimate = (F.col(diastolic) * 2 + F.col(systolic)) / 3.0
    return df.withColumn(mean, F.coalesce(F.col(mean), estimate))


def clean_pressure(
    readings: DataFrame,
    cohort: DataFrame | None,
    components: Sequence[PressureComponent],
    p: Params,
    keys: Sequence[str] = KEYS,
    column: str = "itemid",
    ts: str = "ts",
    value: str = "value",
    range_mode: str = "filter",
) -> DataFrame:
    """All pressure components by instant, mean pressure filled in.

    Equal to fusing primary and fallback of each component and joining the
    components by full outer joins, in one scan and one shuffle: readings go to their
    stay's time buckets (primary ones near the end of a bucket also to the next, as history), the
    deviation of each primary series is taken there, and the readings of an
    instant are grouped by source. Where an instant has several readings of a
    source they are multiplied out as the joins would. Readings without an instant take no part.
    """
    if range_mode not in ("filter", "flag"):
        raise ValueError(f"unknown range_mode {range_mode!r}")
    ids = [i for c in components for i in (*c.primary, *c.fallback)]
    rows = filter_channels(readings, ids, column).filter(F.col(ts).isNotNull())
    if cohort is not None:
        rows = restrict_to(rows, cohort, keys)
    roles = []  # even: primary of a component, odd: its fallback
    for i, c in enumerate(components):
        good = in_range(F.col(value), c.lo, c.hi) if range_mode == "filter" else F.lit(True)
        for j, source in enumerate((c.primary, c.fallback)):
            roles.append(F.when(F.col(column).isin(*source) & good, F.lit(2 * i + j)))
    rows = rows.select(*keys, ts, value, F.explode(F.array_compact(F.array(*roles))).alias("_role"))

    primary = F.col("_role") % 2 == 0
    width = max(3600, p.flat_seconds, 1)
    own = floor_div(F.col("_s"), width)
    reaches = primary & (F.col("_s") + p.flat_seconds >= (own + 1) * width)
    rows = rows.withColumn("_s", seconds(ts)).withColumn(
        "_bucket", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    series = W.partitionBy(*keys, "_bucket", "_role").orderBy("_s").rangeBetween(-p.flat_seconds, 0)
    rows = flag_flatline(
        rows.repartition(*keys, "_bucket").withColumn(
            "rolling_std", F.stddev_samp(F.when(primary, F.col(value))).over(series)
        ),
        p.flat_std,
    ).filter(F.col("_bucket") == own)
    if range_mode == "flag":
        inside = reduce(
            lambda otherwise, ic: F.when(F.col("_role") == 2 * ic[0], F.col(value).between(ic[1].lo, ic[1].hi)).otherwise(otherwise),
            enumerate(components),
            F.lit(None).cast("boolean"),
        )
        rows = rows.withColumn("is_valid", inside & F.col("is_valid"))

    def listed(role: int) -> Column:
        mine = F.when(F.col("_role") == role, F.struct(F.col(value).alias("v"), F.col("is_valid").alias("ok")))
        return F.collect_list(mine).alias(f"_role{role}")

    grouped = rows.groupBy(*keys, "_bucket", ts).agg(*[listed(r) for r in range(len(roles))])
    for i, c in enumerate(components):
        first, second = f"_role{2 * i}", f"_role{2 * i + 1}"
        grouped = grouped.withColumn("_seen", (F.size(first) > 0) | (F.size(second) > 0))
        grouped = grouped.withColumn(first, F.explode_outer(first)).withColumn(second, F.explode_outer(second))
        grouped = grouped.withColumns({"_primary": F.col(first)["v"], "_ok": F.col(first)["ok"], "_fallback": F.col(second)["v"]})
        grouped = prefer_source(grouped, "_primary", "_fallback", "_ok", f"final_{c.name}", f"{c.name}_source")
        grouped = grouped.withColumn(f"{c.name}_source", F.when(F.col("_seen"), F.col(f"{c.name}_source")))
    names = [n for c in components for n in (f"final_{c.name}", f"{c.name}_source")]
    return derive_map(grouped.select(*keys, ts, *names))
