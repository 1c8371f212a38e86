"""Result tables in the shape the charts take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.operators.counts import count_by

# Charted series, words in the cloud and its scale, keywords per topic, trend step.
HEAT_SERIES = ["support", "attention", "timeliness", "burst", "purity", "heat", "intensity_share", "total_heat"]
CLOUD_WORDS, CLOUD_SCALE = 47, 1000
TOPIC_KEYWORDS = 6
TREND_STEP = "3 days"
ROOT = "hot topics"


def heat_series(total: DataFrame) -> DataFrame:
    """``(series, prediction, value)``; timeliness is charted without its sign."""
    shown = total.withColumn("timeliness", F.abs("timeliness"))
    return shown.unpivot("prediction", HEAT_SERIES, "series", "value")


def heat_trend(rows: DataFrame, time: str, key: str, value: str, step: str = TREND_STEP) -> DataFrame:
    """``(window_start, key, cnt, total)`` per step; takes batch and streaming tables alike."""
    grouped = rows.groupBy(F.window(time, step), key)
    sums = grouped.agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), key, "cnt", "total")


def topic_graph_nodes(keywords: DataFrame) -> DataFrame:
    """Root, topic and keyword nodes ``(name, kind, topic, weight)`` of ``(prediction, term, score)``."""
    root = keywords.select(F.lit(ROOT).alias("name"), F.lit("root").alias("kind"),
                           F.lit(None).cast("long").alias("topic"), F.lit(None).cast("double").alias("weight")).distinct()
    topics = keywords.select(_topic_name().alias("name"), F.lit("topic").alias("kind"),
                             F.col("prediction").cast("long").alias("topic"),
                             F.lit(None).cast("double").alias("weight")).distinct()
    words = keywords.select(F.col("term").alias("name"), F.lit("keyword").alias("kind"),
                            F.col("prediction").cast("long").alias("topic"), F.col("score").alias("weight"))
    return root.unionByName(topics).unionByName(words)


def topic_graph_links(keywords: DataFrame) -> DataFrame:
    """``(source, target)``: the root to each topic, each keyword to its topic."""
    topics = keywords.select(F.lit(ROOT).alias("source"), _topic_name().alias("target")).distinct()
    return topics.unionByName(keywords.select(F.col("term").alias("source"), _topic_name().alias("target")))


def _topic_name():
    return F.concat(F.lit("topic "), F.col("prediction"))


def word_cloud(terms: DataFrame, n: int = CLOUD_WORDS, scale: int = CLOUD_SCALE) -> DataFrame:
    """The ``n`` most frequent terms with a weight in proportion to the first one's."""
    top = count_by(terms, "term").orderBy(F.col("cnt").desc(), "term").limit(n)
    # the window spans the n rows of the cloud
    largest = F.max("cnt").over(Window.partitionBy())
    return top.withColumn("weight", F.round(F.col("cnt") * scale / largest).cast("long"))

