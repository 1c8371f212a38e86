"""A training corpus from raw documents: rules, near duplicates, repeated strings, mixture, token ids.

Each stage takes all rows that the one before it kept and its decision takes effect on rows or texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatloom.llm import bpe, bpe_queries, minhash, mixing, quality, repeats
from heatloom.session import scratch_path, ship_package


# Passages of 50 words: words of the corpus take five bytes at least, with the blank behind them, in any of its languages.
PASSAGE_BYTES = 256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are frequent on their host go from the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return minhash.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` bytes and more that occur twice go from the texts."""
    return repeats.without_repeats(docs, length=PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the order of the mixture."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their digest and that of the text they decode to, with slot and place in the mixture.

    Files that are read again come in any order, so the mixture is carried by columns: it depends on ids and sources only,
    which the stage before leaves as they are.
    """
    return mixing.with_places(bpe.digests(docs, bpe_queries.RANKS), docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

# Neither the run-length index nor the merges of the tokenizer can be put in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; the result in the order of the mixture."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = scratch_path(spark, "pipeline-result")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path).orderBy(*mixing.mixture_order())
