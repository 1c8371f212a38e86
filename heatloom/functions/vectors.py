"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (no root is taken)."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def argmax(values: Column) -> Column:
    """0-based position of the largest entry; the first wins on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")
