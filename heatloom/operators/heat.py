"""Topic heat: how much, how recently and how purely a cluster is talked about."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.operators.counts import count_by, top_by_group

# Documents scored per cluster, scale bases and weights of the heat formula.
TOP_DOCS = 15
REPLY_BASE = 20
AGE_BASE = 6000
WEIGHTS = {"support": 0.3, "attention": 0.3, "timeliness": 0.2, "burst": 0.1, "purity": 0.1}
INTENSITY_WEIGHT = 0.1
TIME_FORMAT = "yyyy-MM-dd,HH:mm"


def post_age(docs: DataFrame, as_of: str, time: str = "time", fmt: str = TIME_FORMAT) -> DataFrame:
    """Add ``age_s``, the seconds between a post and ``as_of``; a later post has age 0."""
    now = F.lit(as_of).cast("timestamp_ntz")
    posted = F.to_timestamp_ntz(F.col(time), F.lit(fmt))
    return docs.withColumn("age_s", F.greatest(F.timestamp_diff("SECOND", posted, now), F.lit(0)))


def cluster_docs(docs: DataFrame, take: int = TOP_DOCS) -> DataFrame:
    """The ``take`` documents of each cluster with the highest probability."""
    return top_by_group(docs, ["prediction"], [F.col("p").desc(), F.col("doc_id")], take)


def _log_scaled(value: str, base: int) -> Column:
    """``log10(value + 1)`` against ``log10(base ** 10)``."""
    return F.log10(F.col(value) + 1) / (10 * math.log10(base))


def weighted_heat(measures: dict[str, Column] | None = None) -> Column:
    parts = measures or {name: F.col(name) for name in WEIGHTS}
    return sum((parts[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0))


def _support(sizes: DataFrame, corpus_size: int | None) -> DataFrame:
    # without a given size, a window over one row per cluster adds them up
    total = F.sum("post_num").over(Window.partitionBy()) if corpus_size is None else F.lit(corpus_size)
    return sizes.select("prediction", "post_num", (F.col("post_num") / total).alias("support"))


def _measures(top: DataFrame, by: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """The measures of the top documents of each cluster."""
    entropy = F.sum(F.col("p") * F.log2("p"))
    return top.groupBy(*by).agg(
        F.avg(_log_scaled("replies", REPLY_BASE)).alias("attention"),
        (-F.avg(_log_scaled("age_s", AGE_BASE))).alias("timeliness"),
        (F.var_pop("p") * F.sum("p")).alias("burst"),
        F.when(entropy != 0, -1 / entropy).alias("purity"),
    )


def topic_heat(docs: DataFrame, take: int = TOP_DOCS, corpus_size: int | None = None) -> DataFrame:
    """The measures and the heat of each cluster.

    ``docs`` has ``doc_id, prediction, p, replies, age_s``. The size of a cluster counts all its
    documents, the other measures its top ``take``. Purity, and so the heat, is NULL when every
    probability is 1.
    """
    support = _support(count_by(docs, "prediction", name="post_num"), corpus_size)
    top = cluster_docs(docs.select("doc_id", "prediction", "p", "replies", "age_s"), take)
    return support.join(_measures(top), "prediction").withColumn("heat", weighted_heat())


TOP_FIELDS = ("p", "doc_id", "replies", "age_s")


def window_tops(docs: DataFrame, step: str, take: int = TOP_DOCS) -> DataFrame:
    """``(window_start, prediction, post_num, top)``: size and best ``take`` documents of each cluster at each step.

    ``docs`` has ``doc_id, prediction, p, replies, time``; rows without a time or a cluster are left out. Ages are taken at the
    end of the step. These rows merge: those of parts of a cluster may stand side by side.
    """
    rows = docs.filter("time IS NOT NULL AND prediction IS NOT NULL").withColumn("_w", F.window("time", step))
    age = F.unix_timestamp("_w.end") - F.unix_timestamp(F.col("time").cast("timestamp"))
    rows = rows.select(F.col("_w.start").alias("window_start"), "prediction", "p", "doc_id", F.col("replies").cast("long"), age.alias("age_s"))
    by = ["window_start", "prediction"]
    best = top_by_group(rows, by, [F.col("p").desc(), F.col("doc_id")], take)
    top = best.groupBy(*by).agg(F.collect_list(F.struct(*TOP_FIELDS)).alias("top"))  # ``take`` entries at most
    return count_by(rows, *by, name="post_num").join(top, by)


def heat_by_window(tops: DataFrame, intensity: DataFrame | None = None, take: int = TOP_DOCS) -> DataFrame:
    """The measures, the heat and with ``intensity`` the total heat of each cluster at each step.

    A step's support is the cluster's share of the posts of that step, so a step has the values that ``topic_heat`` gives
    for its posts alone.
    """
    by = ["window_start", "prediction"]
    sizes = tops.groupBy(*by).agg(F.sum("post_num").alias("post_num"))
    posts = sizes.groupBy("window_start").agg(F.sum("post_num").alias("_posts"))  # a row for each step
    support = sizes.join(posts, "window_start").select(*by, "post_num", (F.col("post_num") / F.col("_posts")).alias("support"))
    top = top_by_group(tops.select(*by, F.inline("top")), by, [F.col("p").desc(), F.col("doc_id")], take)
    out = support.join(_measures(top, tuple(by)), by).withColumn("heat", weighted_heat())
    return out if intensity is None else total_heat(out, intensity)


def exchange_rows(docs: DataFrame, take: int = TOP_DOCS) -> DataFrame:
    """The top documents of each cluster in the order of the exchange format.

    ``docs`` has ``doc_id, distribution, p, prediction, time, replies``.
    """
    sizes = count_by(docs, "prediction", name="post_num")
    top = cluster_docs(docs, take).join(sizes, "prediction")
    return top.select("post_num", F.col("doc_id").alias("index"), F.array_join("distribution", ",").alias("topic_distribution"),
                      F.col("p").alias("max_probability"), "prediction", F.translate("time", " ", ",").alias("time"), F.col("replies").alias("recall"))


def heat_of_exchange(rows: DataFrame, as_of: str, corpus_size: int | None = None) -> DataFrame:
    """The heat of clusters handed over in the exchange format."""
    docs = post_age(rows, as_of).withColumnsRenamed({"max_probability": "p", "recall": "replies"})
    sizes = docs.groupBy("prediction").agg(F.max("post_num").alias("post_num"))
    return _support(sizes, corpus_size).join(_measures(docs), "prediction").withColumn("heat", weighted_heat())


def total_heat(heat: DataFrame, intensity: DataFrame) -> DataFrame:
    """Add the weighted topic intensity; ``intensity`` is ``(prediction, intensity)``."""
    share = F.col("intensity") * INTENSITY_WEIGHT
    joined = heat.join(intensity, "prediction")
    return joined.withColumn("total_heat", F.col("heat") + share)


def intensity_from_weights(weights: DataFrame) -> DataFrame:
    """Sum of each topic's term weights divided by the number of terms."""
    n_terms = weights.select("term").distinct().count()
    return weights.groupBy("topic").agg((F.sum("weight") / F.lit(n_terms)).alias("intensity"))
