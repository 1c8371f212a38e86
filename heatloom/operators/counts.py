"""Counts, summaries and set operations over terms and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.unnest import unnest, unnest_positions


def explode_words(df: DataFrame, words: str = "words", keep: list[str] = ()) -> DataFrame:
    return unnest(df, words, *keep)


def positions(df: DataFrame, words: str = "words", keep: list[str] = ("doc_id",)) -> DataFrame:
    return unnest_positions(df, words, *keep)


def count_by(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def counts_in_row(words: Column) -> Column:
    """Array of ``(term, tf)`` of one row's words: sorted, then the places where the word changes and the gaps
    between them."""
    def runs(s: Column) -> Column:
        place = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.aggregate(F.array(place), F.array().cast("array<struct<term:string,tf:bigint>>"), lambda _, p: F.transform(
            p, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.aggregate(F.array(F.sort_array(words)), F.array().cast("array<struct<term:string,tf:bigint>>"), lambda _, s: runs(s))


def counted(row: np.ndarray, words: pa.Array, use=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, number of the word and count of each distinct word of each row, and the words; ``use`` tells which of these count."""
    coded = words.dictionary_encode()
    names = coded.dictionary
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    fits = codes >= 0
    if use is not None and len(names):
        fits &= use(names)[codes]
    n = max(1, len(names))
    cell, count = np.unique(row[fits] * n + codes[fits], return_counts=True)
    return cell // n, cell % n, count.astype(np.int64), names


def rare_terms(terms: DataFrame, min_count: int = 2) -> DataFrame:
    """Terms seen fewer than ``min_count`` times."""
    return count_by(terms, "term").filter(F.col("cnt") < min_count)


def prefix_count_in_row(df: DataFrame, row_key: str, values: Column, length: int) -> DataFrame:
    """Count the prefixes of a multi-valued column within each row."""
    prefixes = unnest(df, values, row_key, name="value")
    prefixes = prefixes.select(row_key, F.substring("value", 1, length).alias("prefix"))
    return count_by(prefixes, row_key, "prefix")


def column_summary(df: DataFrame, values: str) -> DataFrame:
    """Mean, sample variance and minimum of every position of an array column."""
    metrics = Summarizer.metrics("mean", "variance", "min")
    stats = df.select(metrics.summary(array_to_vector(values)).alias("s"))
    columns = [vector_to_array(F.col(f"s.{m}")).alias(m) for m in ("mean", "variance", "min")]
    stats = stats.select(F.arrays_zip(*columns).alias("z"))
    return stats.select(F.posexplode("z").alias("pos", "z")).select(
        "pos", F.col("z.mean").alias("mean"), F.col("z.variance").alias("variance"),
        F.col("z.min").alias("minimum"),
    )


def top_by_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group with their rank.

    Spark cuts each partition to its own first ``n`` rows per group before the shuffle, so a
    group that holds most rows does not meet in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def clamp_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text cells as non-negative numbers: what is no number, or below 0, becomes 0."""
    clean = {c: F.greatest(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.withColumns(clean)
