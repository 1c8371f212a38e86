"""The complete jobs on small inputs, and the trend as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from heatloom.operators.feeds import heat_trend
from heatloom.plans import jobs
from heatloom.plans.registry import Tables
from heatloom.streaming.trend import stream_trend, write_available

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(11)
    themes = ["engine brake wheel road fuel".split(), "room bed breakfast lobby pool".split(), "goal match team coach cup".split()]
    rows = [(i, " ".join(rng.choice(themes[i % 3]) for _ in range(12)), f"2017-03-{1 + i % 9:02d} 08:00", i % 7) for i in range(45)]
    rows.append((99, "solitary solitary odd", "2017-03-01 08:00", 1))
    return spark.createDataFrame(rows, "index long, text string, time string, recall int").repartition(3)


def test_lda_topics(posts):
    out = jobs.hot_topics(posts, k=3, max_iter=5, as_of="2017-03-20 00:00:00", vector_size=8)
    heat = out["heat"].collect()
    assert sum(r["post_num"] for r in heat) == 46
    for row in heat:
        assert row["total_heat"] == pytest.approx(row["heat"] + 0.1 * row["intensity"])
    for name in ("topic_terms", "hot_words", "keywords", "hot_keywords", "synonyms"):
        assert out[name].count() > 0, name


@pytest.mark.parametrize("model", ["kmeans", "bisecting"])
def test_kmeans_topics(posts, model):
    out = jobs.hot_topics(posts, model, k=4, max_iter=10, vector_size=8)
    assert out["labels"].count() == 46
    assert out["top_docs"].groupBy("prediction").count().agg(F.max("count")).first()[0] <= 20
    for name in ("nearest_docs", "hot_words", "keywords", "hot_keywords", "synonyms"):
        assert out[name].count() > 0, name


def test_single_document_cluster_uses_counts(spark):
    top = spark.createDataFrame([(0, 5, 1, ["b", "a", "b"])], "prediction int, doc_id long, rank int, words array<string>")
    got = jobs.cluster_hot_words(top, 5).orderBy("rank").collect()
    assert [(r["term"], r["score"]) for r in got] == [("b", 2.0), ("a", 1.0)]


def test_forum_and_reviews(spark):
    forum = spark.createDataFrame(
        [("t", "c", "好车 ok", "n1", "2017-03-10 08:00", 150, "x"), ("t", "c", "好房", "n2", "2017-03-11 08:00", 3, "x")],
        "title string, content string, text string, name string, time string, recall int, net string")
    lexicon = spark.createDataFrame([("好",), ("好车",)], "word string")
    out = jobs.prepare_forum(forum, lexicon)
    assert [tuple(r) for r in out["posts"].orderBy("index").collect()] == [
        (1, "好车 ok", "2017-03-10 08:00", 150), (2, "好", "2017-03-11 08:00", 3)]
    assert out["high_reply"].count() == 1 and out["distinct_words"].first()[0] == 3
    reviews = spark.createDataFrame([(4.0, "好车", "solo")], "score double, comments string, customer_type string")
    assert jobs.prepare_reviews(reviews, lexicon).first()["splitwords"] == "好车"


def test_review_topics(spark, posts):
    segmented = posts.select("index", F.col("text").alias("splitwords"), F.lit(4.0).alias("score"),
                             F.lit("c").alias("comments"), F.lit("solo").alias("customer_type"))
    out = jobs.review_topics(segmented, ["room"], k=3, max_iter=3, sweeps=10)
    for name, frame in out.items():
        assert frame.count() > 0, name


def test_news(spark):
    docs = Tables(spark, ROOT).documents.select("doc_id", F.col("lang").alias("label"), "text")
    out = jobs.classify_news(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"))
    assert out["accuracy"].first()[0] > 0.5
    assert 0 < out["weighted_f1"].first()["weighted_f1"] <= 1


def test_classifier_study(spark):
    rng = random.Random(4)
    rows = [(str(i), rng.choice("xyz"), [rng.gauss(i % 2, 1), rng.gauss(0, 2)], i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "key string, category string, features array<double>, label int")
    out = jobs.study_classifiers(frame)
    assert out["summary"].count() == 2 and out["metrics"].count() == 12 and out["sweeps"].count() == 26


def test_document_keywords(spark):
    lines = spark.createDataFrame([(1, "a b c d e f a b"), (2, "x")], "doc_id long, value string")
    assert {r["doc_id"] for r in jobs.document_keywords(lines).collect()} == {1, 2}


def test_stream_gives_the_batch_trend(spark, tmp_path):
    events = Tables(spark, ROOT).events
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    out = str(tmp_path / "out")
    write_available(stream_trend(stream, "ts", "event_type", "value"), out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out)
    batch = heat_trend(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    # final once the watermark, one day behind the last event, has passed the end of the step
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = batch.filter(F.col("window_start") + F.expr("INTERVAL 4 DAYS") < F.lit(last))
    assert closed.count() > 0
    keys = ["window_start", "event_type", "cnt"]
    assert got.select(keys).exceptAll(batch.select(keys)).count() == 0
    assert closed.select(keys).exceptAll(got.select(keys)).count() == 0
