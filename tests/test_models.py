"""Closed forms against MLlib, distances and neighbours against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.evaluation import BinaryClassificationMetrics
from pyspark.sql import functions as F

from heatloom.operators import classify, clusters, nearest, weights


@pytest.fixture(scope="module")
def news(spark):
    rng = random.Random(5)
    pools = {"a": "red blue green sea".split(), "b": "red car road wheel".split(), "c": "sea car sun moon".split()}
    rows = []
    for i in range(60):
        label = rng.choice("abc")
        rows.append((i, label, [rng.choice(pools[label]) for _ in range(rng.randrange(1, 9))]))
    return spark.createDataFrame(rows, "doc_id long, label string, words array<string>").persist()


def test_term_bayes_equals_mllib(spark, news):
    model = classify.fit_term_bayes(news, weights.term_frequency(news, ["doc_id", "label"]))
    ours = model.predict(news.select("doc_id", "label"), weights.term_frequency(news))
    indexed = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(news).transform(news)
    counted = CountVectorizer(inputCol="words", outputCol="x").fit(indexed).transform(indexed)
    theirs = NaiveBayes(featuresCol="x", labelCol="y").fit(counted).transform(counted)
    both = ours.join(theirs.select("doc_id", F.col("prediction").alias("p"), vector_to_array("rawPrediction").alias("raw")), "doc_id")
    for row in both.collect():
        assert row["prediction"] == "abc"[int(row["p"])]
        assert row["scores"] == pytest.approx(row["raw"], abs=1e-9)


def test_areas_equal_mllib(spark):
    rng = random.Random(1)
    rows = [("m", int(rng.random() < 0.4), int(rng.random() < 0.5)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "model string, label int, prediction int")
    ours = classify.hard_label_areas(frame).first()
    pairs = spark.sparkContext.parallelize([(float(p), float(y)) for _, y, p in rows])
    theirs = BinaryClassificationMetrics(pairs)
    assert ours["roc"] == pytest.approx(theirs.areaUnderROC)
    assert ours["pr"] == pytest.approx(theirs.areaUnderPR)


def test_areas_without_a_positive_prediction(spark):
    frame = spark.createDataFrame([("m", 1, 0), ("m", 0, 0)], "model string, label int, prediction int")
    row = classify.hard_label_areas(frame).first()
    assert row["pr"] == 0.5 and row["roc"] == 0.5
    frame = spark.createDataFrame([("m", int(k < 3), 0) for k in range(10)], "model string, label int, prediction int")
    scores = frame.rdd.map(lambda r: (float(r.prediction), float(r.label)))
    assert classify.hard_label_areas(frame).first()["pr"] == pytest.approx(BinaryClassificationMetrics(scores).areaUnderPR) == pytest.approx(0.3)


def test_weighted_f1_equals_mllib(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(3)), float(rng.randrange(3))) for _ in range(100)]
    frame = spark.createDataFrame(rows, "label double, prediction double")
    want = MulticlassClassificationEvaluator(metricName="weightedFMeasure").evaluate(frame)
    assert classify.weighted_f1(frame).first()["weighted_f1"] == pytest.approx(want)


def test_descent_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    frame = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "features array<double>, label int")
    w = np.zeros(3)
    for i in range(1, 6):
        gradient = ((1 / (1 + np.exp(-x @ w)) - y)[:, None] * x).mean(axis=0)
        w = w * (1 - 0.5 / math.sqrt(i) * 0.1) - 0.5 / math.sqrt(i) * gradient
    assert classify.descend_logistic(frame, 5, 0.5, 0.1, 0.0) == pytest.approx(w.tolist())


def test_split_depends_on_the_key_alone(spark):
    a = classify.hash_split(spark.range(2000).withColumnRenamed("id", "k"), "k")
    shares = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert 0.5 < shares["train"] / 2000 < 0.7
    b = classify.hash_split(spark.range(2000, numPartitions=7).withColumnRenamed("id", "k"), "k")
    assert a.exceptAll(b).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, rng.normal(i % 4, 0.3, 5).tolist()) for i in range(80)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>").persist()


def test_model_distance_adds_up_to_the_cost(points):
    dense = points.select("id", array_to_vector("v").alias("features"))
    model = clusters.fit_kmeans(dense, 4, 20)
    total = clusters.cluster_sizes(model, dense).agg(F.sum("wssse")).first()[0]
    assert total == pytest.approx(model.summary.trainingCost)


def test_sparse_distance(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c", f"w{i % 5}"][i % 3:]) for i in range(30)], "doc_id int, words array<string>")
    vectors = clusters.hashed_tfidf(docs, 64)
    model = clusters.fit_kmeans(vectors, 3, 20)
    centers = np.array(model.clusterCenters())
    placed = clusters.model_distance(model, model.transform(vectors)).withColumn("x", vector_to_array("features"))
    for row in placed.select("x", "prediction", "sq_dist").collect():
        assert row["sq_dist"] == pytest.approx(((np.array(row["x"]) - centers[row["prediction"]]) ** 2).sum(), abs=1e-9)


def test_assign_nearest_and_own_center(points):
    centers = clusters.group_means(points, "label", "v")
    known = {r["label"]: np.array(r["center"]) for r in centers.collect()}
    for row in clusters.assign_nearest(points, centers, "label", "v").collect():
        d = {k: ((np.array(row["v"]) - c) ** 2).sum() for k, c in known.items()}
        assert row["prediction"] == min(d, key=d.get) and row["sq_dist"] == pytest.approx(min(d.values()))
    for row in clusters.center_distance(points, centers, "label", "v").collect():
        assert row["sq_dist"] == pytest.approx(((np.array(row["v"]) - known[row["label"]]) ** 2).sum())


@pytest.mark.parametrize("queries_per_pass", [2000, 3])
def test_nearest_by_cosine(points, queries_per_pass):
    queries = points.filter("id < 10").select(F.col("id").alias("query"), F.col("label").alias("scope"), "v")
    candidates = points.select(F.col("id").alias("candidate"), "v", F.array("label", F.lit(9)).alias("scopes")).repartition(6)
    found = nearest.nearest_by_cosine(queries, candidates, 3, queries_per_pass).collect()
    rows = points.collect()

    def cosine(a, b):
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    for q in rows[:10]:
        near = sorted((-round(cosine(q["v"], c["v"]), 9), c["id"]) for c in rows if c["label"] == q["label"] and c["id"] != q["id"])
        got = sorted((r["rank"], r["candidate"]) for r in found if r["query"] == q["id"])
        assert [c for _, c in got] == [c for _, c in near[:3]]


def test_cosine_of_pairs(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, ["d"])], "doc_id long, words array<string>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 1)], "left_id long, right_id long")
    got = {(r["left_id"], r["right_id"]): r["cosine"] for r in weights.cosine_pairs(weights.term_frequency(docs), pairs, "tf").collect()}
    assert got[(1, 2)] == pytest.approx(2 / math.sqrt(5) / math.sqrt(2))
    assert got[(2, 3)] == 0 and got[(1, 1)] == pytest.approx(1)


@pytest.mark.parametrize("at_once", [1, 256])
def test_cosine_of_odd_pairs(spark, monkeypatch, at_once):
    """the terms of a document travel as one row, however its rows lie; no group of pair and term is built."""
    monkeypatch.setattr(weights, "PAIRS_AT_ONCE", at_once)
    rows = [(1, "a", 3.0), (2, "a", 1.0), (1, "\u00e9", 4.0), (2, "\u00e9", 1.0), (2, "a", 1.0), (4, "a", 0.0), (None, "a", 2.0), (1, "", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, term string, w double").coalesce(1)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, 1), (1, 4), (3, 5), (None, 1)], "left_id long, right_id long")
    cosine = weights.cosine_pairs(frame, pairs, "w")
    got = [(r["left_id"], r["right_id"], r["cosine"] and round(r["cosine"], 9)) for r in cosine.collect()]
    want = [(1, 2, round((3 * 2 + 4) / 5 / math.sqrt(5), 9)), (1, 3, None), (1, 4, None), (3, 1, None), (None, 1, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "term" not in cosine._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]


def test_registered_sweep_is_the_whole_sweep(spark, monkeypatch):
    from heatloom.operators import topics
    from heatloom.plans.catalogue import QUERIES

    fits = []
    monkeypatch.setattr(topics, "fit_online", lambda docs, ks, max_iter: fits.append((ks, max_iter)))
    monkeypatch.setattr(topics, "online_bounds", lambda fit: [(k, -1.0, 1.0) for k in fits[0][0]])
    found = QUERIES["lda_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert [r.k for r in found] == [3, 5, 7, 10, 15, 20, 25, 30, 40, 50, 70, 100, 120, 150, 200, 500]
    assert fits == [([r.k for r in found], 150)]
