"""The complete jobs: from read tables to result tables. Every result is a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.text import format_tokens, space_words, ws_words
from heatloom.functions.unnest import unnest
from heatloom.operators import classify, clusters, counts, heat, nearest, terms, topics, weights
from heatloom.operators import textrank as tr
from heatloom.operators.kwic import REVIEW_TARGETS, kwic
from heatloom.operators.order import row_index
from heatloom.operators.small import checked_broadcast
from heatloom.session import checkpoint_root

# Top documents, hot words per document and synonyms of the two kinds of job.
LDA_SHAPE = {"take": heat.TOP_DOCS, "hot_words": 3, "synonyms": nearest.LDA_SYNONYMS}
KMEANS_SHAPE = {"take": 20, "hot_words": 5, "synonyms": nearest.KMEANS_SYNONYMS}
NEAREST_LISTED = 10
REVIEW_HOT_WORDS, REVIEW_WINDOW, REVIEW_KEYWORDS = 4, 7, 50
MAX_TOP_DOCS = 100_000


def hot_topics(posts: DataFrame, model: str = "lda", k: int = topics.K, max_iter: int = topics.MAX_ITER,
               as_of: str | None = None, optimizer: str = "em", time_format: str = "yyyy-MM-dd HH:mm",
               vector_size: int = 100, seed: int = 1) -> dict[str, DataFrame]:
    """Topics of ``posts (index, text, time, recall)`` and what describes them.

    ``model`` is ``lda``, ``kmeans`` or ``bisecting``. All give ``labels``, ``top_docs``,
    ``hot_words``, ``keywords``, ``hot_keywords`` and ``synonyms``; LDA also gives
    ``topic_terms``, ``intensity`` and, with ``as_of``, ``heat``.
    """
    checkpoint_root(posts.sparkSession)
    docs = posts.select(F.col("index").alias("doc_id"), ws_words(F.col("text")).alias("words"), "time",
                        F.col("recall").alias("replies"))
    out: dict[str, DataFrame] = {}
    if model == "lda":
        shape, order = LDA_SHAPE, [F.col("p").desc(), F.col("doc_id")]
        fitted = topics.fit_topics(docs.select("doc_id", "words"), k, max_iter, optimizer)
        labels = fitted.assign().select("doc_id", "prediction", "p", "distribution").checkpoint()
        out["topic_terms"] = fitted.terms(topics.TOPIC_TERMS)
        out["intensity"] = fitted.intensity()
        if as_of is not None:
            aged = heat.post_age(docs.select("doc_id", "time", "replies"), as_of, fmt=time_format)
            placed = aged.join(labels, "doc_id")
            out["cluster_docs"] = heat.exchange_rows(placed)
            scored = heat.topic_heat(placed)
            out["heat"] = heat.total_heat(scored, out["intensity"])
    else:
        shape, order = KMEANS_SHAPE, [F.round("sq_dist", 9), F.col("doc_id")]
        vectors = clusters.hashed_tfidf(docs.select("doc_id", "words")).select("doc_id", "features")
        fitted = clusters.fit_kmeans(vectors, k, max_iter, seed, bisecting=model == "bisecting")
        placed = clusters.model_distance(fitted, fitted.transform(vectors))
        labels = placed.select("doc_id", "prediction", "sq_dist").checkpoint()
        out["nearest_docs"] = counts.top_by_group(labels, ["prediction"], order, NEAREST_LISTED)
    top = counts.top_by_group(labels, ["prediction"], order, shape["take"])
    # narrow rows are ranked first; the texts of the few top documents are fetched afterwards
    ranked = checked_broadcast(top.select("doc_id", "prediction", "rank"), MAX_TOP_DOCS)
    top_words = docs.select("doc_id", "words").join(ranked, "doc_id").checkpoint()
    hot = cluster_hot_words(top_words, shape["hot_words"])
    members = docs.select("doc_id", "words").join(labels.select("doc_id", "prediction"), "doc_id")
    word_model = nearest.fit_word2vec(docs.select("words"), vector_size, seed=seed)
    out |= {
        "labels": labels, "top_docs": top, "hot_words": hot,
        "keywords": tr.textrank_groups(tr.stacked_texts(top_words, "prediction", "rank"), "prediction"),
        "hot_keywords": hot_word_keywords(hot),
        "synonyms": nearest.hotword_synonyms(hot, members, word_model, shape["synonyms"]),
    }
    return out


def cluster_hot_words(top_words: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each top document, weighted inside its cluster.

    In a cluster of one document every TF-IDF weight is 0, so plain counts decide there.
    """
    weighted = weights.group_tfidf(top_words, "prediction")
    alone = counts.count_by(top_words, "prediction", name="m").filter("m = 1").withColumn("alone", F.lit(True))
    score = F.when(F.col("alone"), F.col("tf").cast("double")).otherwise(F.col("tfidf"))
    scored = weighted.join(alone, "prediction", "left").withColumn("score", score)
    return weights.top_terms(scored, n, "score", ["prediction", "doc_id"]).select(
        "prediction", "doc_id", "term", "score", "rank")


def hot_word_keywords(hot: DataFrame) -> DataFrame:
    """TextRank over the hot words of a cluster, document after document."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x.term)
    words = hot.groupBy("prediction", "doc_id").agg(lists.alias("words"))
    return tr.textrank_groups(tr.stacked_texts(words, "prediction", "doc_id"), "prediction")


def prepare_forum(rows: DataFrame, lexicon: DataFrame, stopwords: DataFrame | None = None,
                  hot_replies: int = 100) -> dict[str, DataFrame]:
    """Forum rows numbered, cut into words and joined: the input of ``hot_topics``."""
    order = [F.col("time"), F.col("name"), F.col("title"), F.xxhash64("text")]
    numbered = row_index(rows, order)
    cut = terms.segment_corpus(numbered.select("index", "text"), lexicon, stopwords, "index")
    segmented = cut.select("index", format_tokens(F.col("words")).alias("splitwords"))
    joined = numbered.join(segmented, "index")
    return {
        "high_reply": numbered.filter(F.col("recall") >= hot_replies),
        "posts": joined.select("index", F.col("splitwords").alias("text"), "time", "recall"),
        "distinct_words": unnest(cut, "words").agg(F.countDistinct("term").alias("distinct_words")),
    }


def prepare_reviews(reviews: DataFrame, lexicon: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Reviews numbered and cut: ``(index, splitwords, score, comments, customer_type)``."""
    numbered = row_index(reviews, [F.col("comments"), F.col("score"), F.col("customer_type")])
    cut = terms.segment_corpus(numbered, lexicon, stopwords, "index", "comments")
    return cut.select("index", format_tokens(F.col("words")).alias("splitwords"), "score", "comments", "customer_type")


def review_topics(segmented: DataFrame, targets: list[str] = REVIEW_TARGETS, k: int = topics.REVIEW_K,
                  max_iter: int = topics.MAX_ITER, sweeps: int = tr.SWEEPS, seed: int = 1) -> dict[str, DataFrame]:
    """Hot words, corpus keywords, topics and contexts of segmented reviews."""
    docs = segmented.select(F.col("index").alias("doc_id"), ws_words(F.col("splitwords")).alias("words"))
    hot = weights.joined_terms(weights.top_terms(weights.tfidf(docs), REVIEW_HOT_WORDS), ["doc_id"])
    from_hot = hot.select("doc_id", space_words(F.col("hotwords")).alias("words"))
    ranked = {"window": REVIEW_WINDOW, "top": REVIEW_KEYWORDS, "sweeps": sweeps, "cross_document": True,
              "order": ["doc_id"], "tolerance": 1e-6}
    return {
        "hot_words": segmented.join(hot.withColumnRenamed("doc_id", "index"), "index"),
        "keywords": tr.textrank(docs, [], **ranked),
        "hot_keywords": tr.textrank(from_hot, [], **ranked),
        "topic_terms": topics.fit_topics(docs, k, max_iter).terms(topics.TOPIC_TERMS),
        "contexts": kwic(docs, targets, cross_document=True),
    }


def classify_news(train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """News by label: ``(doc_id, label, text)`` twice; counts, predictions and their quality."""
    train_tf, test_tf = terms.news_terms(train, ["doc_id", "label"]), terms.news_terms(test)
    model = classify.fit_term_bayes(train, train_tf, classify.NEWS_SMOOTHING, use_idf=True, min_count=2)
    guess = model.predict(test.select("doc_id", "label"), test_tf).select("doc_id", "label", "prediction")
    return {
        "label_counts": counts.count_by(train, "label").orderBy(F.col("cnt").desc(), "label"),
        "predictions": guess,
        "accuracy": guess.agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy")),
        "weighted_f1": classify.weighted_f1(guess),
    }


def study_classifiers(rows: DataFrame) -> dict[str, DataFrame]:
    """Labelled pages ``(key, category, features, label)``: model comparison and parameter studies."""
    encoded = classify.one_hot(rows, "category")
    clamped = F.transform("features", lambda x: F.greatest(x, F.lit(0.0)))
    vectors = encoded.select("key", "label", "encoded", classify.array_to_vector("features").alias("numbers"),
                             classify.array_to_vector(clamped).alias("clamped"))
    joined = classify.assemble(classify.assemble(vectors, ["encoded", "numbers"], "joined"),
                               ["encoded", "clamped"], "nonnegative")
    data = classify.standardize(joined, "joined", "features").select("key", "label", "features", "nonnegative")
    return {
        "summary": counts.column_summary(rows, "features"),
        "metrics": classify.hard_label_scores(classify.predictions(classify.standard_models(), data, data)),
        "sweeps": classify.tune(data, data, classify.sweep_grid()),
    }


def document_keywords(lines: DataFrame, window: int = tr.WINDOW, top: int = tr.TOP) -> DataFrame:
    """Keywords of each line of ``(doc_id, value)``, words between blanks."""
    groups = lines.select("doc_id", F.array(space_words(F.col("value"))).alias("texts"))
    return tr.textrank_groups(groups, "doc_id", window, top)
