"""Column expressions on nested arrays (steps x features)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_steps(steps: int, width: int) -> Column:
    """An all-missing sequence."""
    return F.array_repeat(F.array_repeat(F.lit(None).cast("double"), width), steps)


def count_cells(x: str | Column, test) -> Column:
    """How many cells of a nested array satisfy ``test``."""
    c = F.col(x) if isinstance(x, str) else x
    return F.aggregate(
        c,
        F.lit(0).cast("long"),
        lambda total, row: total + F.size(F.filter(row, test)).cast("long"),
    )


def pick(row: Column, positions: Sequence[int]) -> Column:
    """The cells of ``row`` at the given 0-based positions, in that order."""
    return F.array(*[F.get(row, F.lit(i)) for i in positions])


def sanitize(c: Column) -> Column:
    """Missing and NaN become 0, infinities become plus or minus 1."""
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(0.0))
        .when(c == F.lit(float("inf")), F.lit(1.0))
        .when(c == F.lit(float("-inf")), F.lit(-1.0))
        .otherwise(c.cast("double"))
    )


def sanitize_sequence(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.transform(c, lambda row: F.transform(row, sanitize))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
