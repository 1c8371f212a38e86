"""Inputs of the jobs, derived from the driver's tables.

Derived columns use integer arithmetic only, so Spark and SQL compute the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.text import ws_words
from heatloom.functions.unnest import spread
from heatloom.plans.registry import Tables

AS_OF = "2024-03-01 00:00:00"
CLUSTERS = 13

# SQL twins of the functions below.
DOCS_SQL = f"""SELECT doc_id, text, lang, source, doc_id % {CLUSTERS} AS prediction,
 0.3::DOUBLE + (doc_id * 31 % 70) / 100.0::DOUBLE AS p, (doc_id * 7919) % 251 AS replies,
 (doc_id * 37 % 43200) * 60 AS age_s FROM documents"""
WORDS_SQL = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
TOKENS_SQL = f"""SELECT doc_id, i - 1 AS pos, w[i] AS term
 FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents) d, unnest(range(1, len(w) + 1)) u(i)"""
TF_SQL = f"SELECT doc_id, term, count(*) AS tf FROM ({TOKENS_SQL}) GROUP BY doc_id, term"
TFIDF_SQL = f"""SELECT tf.doc_id, tf.term, tf.tf,
 tf.tf * ln(((SELECT count(*) FROM documents) + 1) / (d.df + 1.0::DOUBLE)) AS tfidf
 FROM ({TF_SQL}) tf JOIN (SELECT term, count(*) AS df FROM ({TF_SQL}) GROUP BY term) d
 ON tf.term = d.term"""


def labelled_docs(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    """Documents with a given cluster, its probability, the reply count and the age."""
    return (t.documents if docs is None else docs).select(
        "doc_id", "text", "lang", "source",
        (F.col("doc_id") % CLUSTERS).alias("prediction"),
        (F.lit(0.3) + (F.col("doc_id") * 31 % 70) / F.lit(100.0)).alias("p"),
        (F.col("doc_id") * 7919 % 251).alias("replies"),
        (F.col("doc_id") * 37 % 43200 * 60).alias("age_s"),
    )


def texts(t: Tables, *columns: str) -> DataFrame:
    """Document texts for work that needs no grouping by document."""
    return spread(t.documents.select("doc_id", "text", *columns), "doc_id")


def doc_words(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", ws_words(F.col("text")).alias("words"))


def post_time(age_s: str = "age_s"):
    return F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, 0, 0, {age_s})")


def posts(t: Tables) -> DataFrame:
    """Forum posts: running number, blank-joined words, time and reply count."""
    docs = labelled_docs(t)
    plain = F.trim(F.regexp_replace("text", r"\W+", " "))
    return docs.select(
        F.col("doc_id").alias("index"), plain.alias("text"),
        F.date_format(post_time(), "yyyy-MM-dd HH:mm").alias("time"),
        F.col("replies").cast("int").alias("recall"),
    )


POSTS_SQL = rf"""SELECT doc_id AS "index", trim(regexp_replace(text, '\W+', ' ', 'g')) AS text,
 strftime(TIMESTAMP '{AS_OF}' - to_seconds(age_s), '%Y-%m-%d %H:%M') AS "time",
 replies::INTEGER AS recall FROM ({DOCS_SQL})"""
