"""Arrays to rows.

The outer forms are used and the empty row is dropped afterwards: with the plain forms Spark puts
a not-empty filter under the generator, which computes an expensive array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, *keep, name: str = "term") -> DataFrame:
    """``keep`` columns and one row per entry. Entries must not be NULL."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def unnest_positions(df: DataFrame, array: Column | str, *keep, pos: str = "pos", name: str = "term") -> DataFrame:
    """The same with the 0-based position of each entry."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(name).isNotNull())


def unnest_structs(df: DataFrame, array: Column, *keep, required: str) -> DataFrame:
    """``keep`` columns and the fields of each struct; ``required`` is a field that is never NULL."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(required).isNotNull())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows by key when the files have fewer splits than there are cores.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
