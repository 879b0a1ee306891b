"""Running totals and ranks over large groups.

A window over a whole group runs in one task, so a group holding much of the
data would not scale. These helpers cut each group into ordered buckets, work
inside the buckets in parallel, and add offsets taken from the small table of
bucket totals. Buckets come from the row's own value, so recomputing a lost
task gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_HEX_DIGITS = 3


def value_bucket(value: Column, per_unit: int = 64) -> Column:
    """Ordered bucket of any number on a logarithmic grid; infinities get the outermost, NaN the last."""
    place = F.signum(value) * F.log1p(F.abs(value)) * F.lit(per_unit)
    inside = F.least(F.greatest(place, F.lit(-1e9)), F.lit(1e9))
    return F.when(F.isnan(value.cast("double")), F.lit(1_000_000_001)).otherwise(
        F.floor(inside).cast("int")
    )


def probability_bucket(p: Column, per_unit: int = 64) -> Column:
    """Ordered bucket of a probability, fine near 0 and near 1 (about 2,700 in all)."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    return F.floor(F.log(q / (F.lit(1.0) - q)) * F.lit(per_unit)).cast("int")


def _group(by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def _by_group(df: DataFrame, by: Sequence[str], value: Column) -> Column:
    """What a small table with one row per group holds for the row's group."""
    entries = F.collect_list(F.struct(_group(by).alias("k"), value.alias("v")))
    return F.try_element_at(df.agg(F.map_from_entries(entries).alias("m")).scalar(), _group(by))


def quantile_bucket(
    df: DataFrame, by: Sequence[str], key: str, counts: Sequence[str], parts: int = 128
) -> Column:
    """Ordered bucket of a key by approximate quantiles of its group's keys.

    Wherever the keys lie, and however narrow their band is, no bucket holds much more than its share of
    them. Groups are few: their cut points are one row. ``df`` should hold distinct keys, each met at
    least once by its ``counts``; as those are read here too, Spark can share the shuffle below ``df``.
    """
    met = F.when(sum((F.col(c) for c in counts), F.lit(0)) >= 0, F.col(key))
    at = F.percentile_approx(met, [i / parts for i in range(1, parts)], 20 * parts)
    points = _by_group(df.groupBy(*by).agg(at.alias("_points")), by, F.col("_points"))
    return F.array_position(F.sort_array(F.array_append(points, F.col(key))), F.col(key))


def kth_key(
    df: DataFrame, by: Sequence[str], key: str, quota: Callable[[Column], Column], levels: int = 2
) -> Column:
    """For each row the last of its group's first ``quota(size)`` keys; missing if that is none.

    ``key`` is an md5. Keys are counted by their leading digits, which narrows the place of the last one down
    to a 4096th of the keys a level; only those that are left are ordered. Groups are few.
    """
    by = list(by)
    rows, wanted = df.select(*by, key), None
    for level in range(levels):
        digits = F.substring(F.col(key), 1, _HEX_DIGITS * (level + 1))
        counts = rows.groupBy(*by, digits.alias(_BUCKET)).agg(F.count(F.lit(1)).alias("_n"))
        before = W.partitionBy(*by).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, 0)
        ends = counts.select(
            *by,
            _BUCKET,
            "_n",
            F.sum("_n").over(before).alias("_end"),
            F.sum("_n").over(W.partitionBy(*by)).alias("_size"),
        )
        if wanted is None:
            ends = ends.withColumn("_wanted", F.least(quota(F.col("_size")), F.col("_size")))
        else:
            ends = ends.withColumn("_wanted", wanted)
        met = ends.filter((F.col("_wanted") <= F.col("_end")) & (F.col("_wanted") > F.col("_end") - F.col("_n")))
        left = F.struct(F.col(_BUCKET).alias("digits"), (F.col("_wanted") - F.col("_end") + F.col("_n")).alias("n"))
        place = _by_group(met, by, left)
        rows, wanted = rows.filter(digits == place.getField("digits")), place.getField("n")
    order = F.row_number().over(W.partitionBy(*by).orderBy(key))
    last = rows.withColumn("_rn", order).filter(F.col("_rn") == wanted)
    return _by_group(last, by, F.col(key))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    bucket: Column,
    sums: Sequence[str],
    descending: bool = False,
    neighbours: bool = False,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum by ``key``) and ``all_<s>`` (group total).

    With ``neighbours`` also ``next_<s>``, the value at the key that follows in the group
    (missing at its end), and ``is_first``. Across bucket borders both come from the bucket table.

    ``bucket`` must grow with ``key``; ``key`` must be unique within a group
    and not missing. Both reads of ``df`` ask for the same columns and rows, so
    Spark can share the shuffle below them.
    """
    by = list(by)
    d = df.withColumn(_BUCKET, F.coalesce(bucket, F.lit(0)))
    order = F.col(key).desc() if descending else F.col(key).asc()
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    inside = W.partitionBy(*by, _BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    buckets = W.partitionBy(*by).orderBy(bucket_order)
    before = buckets.rowsBetween(W.unboundedPreceding, -1)
    edge, at_edge = (F.max, F.max_by) if descending else (F.min, F.min_by)
    heads, following, own, found = [], [], [], []
    if neighbours:
        heads = [edge(key).alias("_edge"), *[at_edge(s, key).alias(f"_head_{s}") for s in sums]]
        following = [
            edge("_edge").over(W.partitionBy(*by)).alias("_start"),
            *[F.lead(f"_head_{s}").over(buckets).alias(f"_after_{s}") for s in sums],
        ]
        ordered = W.partitionBy(*by, _BUCKET).orderBy(order)
        own = [F.lead(s).over(ordered).alias(f"_lead_{s}") for s in sums]
        found = [
            *[F.coalesce(f"_lead_{s}", f"_after_{s}").alias(f"next_{s}") for s in sums],
            (F.col(key) == F.col("_start")).alias("is_first"),
        ]
    totals = d.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(s) for s in sums], *heads)
    offsets = totals.select(
        *by,
        _BUCKET,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(W.partitionBy(*by)).alias(f"all_{s}") for s in sums],
        *following,
    )
    running = d.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums], *own)
    return running.join(offsets, [*by, _BUCKET]).select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
        *found,
    )


def ranked(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str | Column],
    rank: str = "rank",
    size: str = "size",
) -> DataFrame:
    """Add the row's 1-based ``rank`` within its group and the group's ``size``.

    Rows are ordered by ``bucket`` first and by ``order`` inside a bucket.
    """
    by = list(by)
    d = df.withColumn(_BUCKET, F.coalesce(bucket, F.lit(0)))
    counts = d.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        _BUCKET,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(*by)).alias(size),
    )
    inside = W.partitionBy(*by, _BUCKET).orderBy(*order)
    return (
        d.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*by, _BUCKET])
        .select(
            *[F.col(c) for c in df.columns],
            (F.col("_rn") + F.col("_off")).alias(rank),
            F.col(size),
        )
    )


def shuffle_key(seed: int | str, *ids: str | Column) -> Column:
    """Repeatable random order: the md5 of the seed and the row's ids."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
