"""Invariants of the queries that SQL cannot express: fits, samples and hashed features."""

import pytest

from heatloom.plans.catalogue import ORACLES, QUERIES
from heatloom.plans.registry import Tables

ROOT = "/root/testdata/sf0.001"


def rows(spark, name):
    return QUERIES[name](spark, ROOT).collect()


def test_every_fit_is_listed():
    assert set(QUERIES) - set(ORACLES) == {
        "textrank_per_doc", "hashing_tf", "sample_docs", "word2vec", "hotword_synonyms", "lda_fit", "lda_topic_terms",
        "topic_intensity", "lda_assign", "lda_online_terms", "lda_sweep", "kmeans_fit", "bisecting_fit", "kmeans_elbow",
        "logreg", "linear_svm", "decision_tree", "model_metrics", "tuning_sweep", "holdout_sweep"}


def test_lda(spark):
    assigned = rows(spark, "lda_assign")
    n_docs = Tables(spark, ROOT).documents.count()
    assert len(assigned) == n_docs
    for row in assigned:
        shares = [float(x) for x in row["distribution"].split(",")]
        assert abs(sum(shares) - 1) < 1e-4 and 0 <= row["prediction"] < 13
        assert row["p"] == pytest.approx(max(shares), abs=1e-5)
    terms = rows(spark, "lda_topic_terms")
    assert len(terms) == 130 and all(r["weight"] > 0 for r in terms)


def test_topic_intensity_sums_to_tokens_per_term(spark):
    total = sum(r["intensity"] for r in rows(spark, "topic_intensity"))
    counts = QUERIES["distinct_tokens"](spark, ROOT).first()
    assert total == pytest.approx(counts["terms"] / counts["distinct_terms"], rel=1e-6)


@pytest.mark.parametrize("name", ["kmeans_fit", "bisecting_fit"])
def test_cluster_fits(spark, name):
    found = rows(spark, name)
    assert sum(r["cnt"] for r in found) == Tables(spark, ROOT).documents.count()
    assert all(r["wssse"] >= 0 for r in found)


def test_elbow_falls(spark):
    found = sorted(rows(spark, "kmeans_elbow"))
    assert [r["k"] for r in found] == list(range(3, 21))
    assert found[-1]["wssse"] < found[0]["wssse"]


def test_hashed_counts_keep_every_word(spark):
    for row in rows(spark, "hashing_tf"):
        assert row["hashed_words"] == row["words"] and row["buckets"] <= row["words"]


def test_sample_is_from_the_table(spark):
    ids = {r["doc_id"] for r in Tables(spark, ROOT).documents.select("doc_id").collect()}
    assert {r["doc_id"] for r in rows(spark, "sample_docs")} <= ids


def test_every_hot_word_has_synonyms(spark):
    for row in rows(spark, "hotword_synonyms"):
        assert row["line"].startswith(row["term"] + ":") and len(row["line"]) > len(row["term"]) + 1


def test_word_vectors_cover_the_vocabulary(spark):
    assert len(rows(spark, "word2vec")) == QUERIES["distinct_tokens"](spark, ROOT).first()["distinct_terms"]


@pytest.mark.parametrize("name", ["logreg", "linear_svm", "decision_tree"])
def test_classifiers_predict_every_row(spark, name):
    found = rows(spark, name)
    assert len(found) == Tables(spark, ROOT).labels.count()
    assert {r["prediction"] for r in found} <= {0.0, 1.0}


def test_metrics_are_shares(spark):
    found = rows(spark, "model_metrics")
    assert len(found) == 12 and all(r["value"] is None or 0 <= r["value"] <= 1 for r in found)
    assert len(rows(spark, "tuning_sweep")) == 26
    assert len(rows(spark, "holdout_sweep")) == 10


def test_lda_sweep(spark):
    found = rows(spark, "lda_sweep")
    assert all(r["log_likelihood"] < 0 < r["log_perplexity"] for r in found)
