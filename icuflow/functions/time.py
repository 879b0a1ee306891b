"""Time arithmetic on timestamp columns. The session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds(c: str | Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(col(c).cast("timestamp"))


def shift(c: str | Column, by_seconds: int | Column) -> Column:
    """The timestamp ``by_seconds`` later."""
    step = F.lit(by_seconds) if isinstance(by_seconds, int) else by_seconds
    return F.timestamp_micros(micros(c) + step.cast("long") * F.lit(MICROS))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def floor_div(num: Column, den: int) -> Column:
    """Integer division rounding down, exact for the whole range of longs."""
    d = F.lit(den).cast("long")
    return F.call_function("div", num - F.pmod(num, d), d)


def ceil_div(num: Column, den: int) -> Column:
    return -floor_div(-num, den)
