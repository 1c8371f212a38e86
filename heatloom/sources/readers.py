"""Readers for the input formats. Every path may be on any Hadoop file system.

The delimited formats carry no quoting, so quote handling is switched off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS_SCHEMA = "index LONG, text STRING, time STRING, recall INT"
FORUM_SCHEMA = (
    "title STRING, content STRING, text STRING, name STRING, time STRING, recall INT, net STRING"
)
REVIEWS_SCHEMA = "score DOUBLE, customer_type STRING, comments STRING"
SEGMENTED_SCHEMA = (
    "index LONG, splitwords STRING, score DOUBLE, comments STRING, customer_type STRING"
)
CLUSTER_DOCS_SCHEMA = (
    "post_num LONG, index LONG, topic_distribution STRING, max_probability DOUBLE, prediction INT, "
    "time STRING, recall INT"
)
SEARCH_LOG_SCHEMA = "time STRING, user_id LONG, keyword STRING, rank STRING, url STRING"


def _delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, quote="", mode="FAILFAST")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, POSTS_SCHEMA)


def read_forum(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, FORUM_SCHEMA)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, REVIEWS_SCHEMA).select("score", "comments", "customer_type")


def read_segmented_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, SEGMENTED_SCHEMA)


def read_cluster_docs(spark: SparkSession, path: str) -> DataFrame:
    """The exchange format between clustering and heat, fields between blanks."""
    return _delimited(spark, path, CLUSTER_DOCS_SCHEMA, sep=" ")


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, SEARCH_LOG_SCHEMA, sep="\t")


def read_labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(key, category, features, label)`` from quoted TSV lines; ``?`` is a missing number.

    Column 0 is the key, column 3 the category, columns 4.. are numbers, the last is the label.
    """
    cells = F.split(F.regexp_replace("value", '"', ""), "\t")
    raw = F.slice(F.col("cells"), 5, F.size("cells") - 5)
    numbers = F.transform(raw, lambda x: F.when(x == "?", 0.0).otherwise(x.cast("double")))
    return (
        spark.read.text(path)
        .select(cells.alias("cells"))
        .select(
            F.col("cells")[0].alias("key"),
            F.col("cells")[3].alias("category"),
            numbers.alias("features"),
            F.element_at("cells", -1).cast("int").alias("label"),
        )
    )


def path_label(path):
    """Name of the folder a file lies in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def path_name(path):
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def read_documents_dir(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: ``(label, name, text)``, the label from the parent folder."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(
        path_label(F.col("path")).alias("label"), path_name(F.col("path")).alias("name"),
        F.col("value").alias("text"),
    )


def read_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line: columns are reached by name, all as strings."""
    return spark.read.csv(path, header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
