"""Registered queries: projections, filters, running numbers, joins, counts, order and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions.text import (
    NEWS_STOPWORDS, format_tokens, percent, safe_key, ws_words,
)
from heatloom.functions.vectors import argmax, as_doubles
from heatloom.operators import counts
from heatloom.operators.classify import hard_label_areas, hard_label_scores, weighted_f1
from heatloom.operators.clusters import center_distance, group_means
from heatloom.operators.counts import count_by
from heatloom.operators.order import row_index, zip_index, zip_rows
from heatloom.operators.weights import joined_terms, term_frequency, tfidf, top_terms
from heatloom.plans.fixtures import (
    DOCS_SQL, POSTS_SQL, TF_SQL, TFIDF_SQL, TOKENS_SQL, WORDS_SQL, doc_words, labelled_docs, posts,
)
from heatloom.plans.registry import Tables, query
from heatloom.plans.source_queries import SEARCH_LOG_SQL, search_log

STOPWORDS_SQL = ", ".join(f"'{w}'" for w in NEWS_STOPWORDS)


@query("project_posts", f"""SELECT "index" AS post_id, "time" AS posted_at, recall AS replies
 FROM ({POSTS_SQL})""")
def project_posts(t: Tables):
    return posts(t).select(F.col("index").alias("post_id"), F.col("time").alias("posted_at"),
                           F.col("recall").alias("replies"))


@query("high_reply_posts", f"""SELECT "index", "time", recall FROM ({POSTS_SQL})
 WHERE recall >= 100""")
def high_reply_posts(t: Tables):
    return posts(t).filter("recall >= 100").select("index", "time", "recall")


@query("filter_contains", "SELECT page_id, url FROM pages WHERE contains(url, '/fr/')")
def filter_contains(t: Tables):
    return t.pages.filter(F.col("url").contains("/fr/")).select("page_id", "url")


@query("row_index", """SELECT row_number() OVER (ORDER BY source, doc_id) AS "index", doc_id, source
 FROM documents""")
def row_index_query(t: Tables):
    order = [F.col("source"), F.col("doc_id")]
    return row_index(t.documents.select("doc_id", "source"), order)


@query("zip_index", """SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS row_id, doc_id,
 n_chars FROM documents""")
def zip_index_query(t: Tables):
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return zip_index(t.documents.select("doc_id", "n_chars"), order)


@query("nb_clamp", """SELECT doc_id, greatest(coalesce(quality, 0)::DOUBLE, 0) AS quality,
 greatest((n_chars - 2000)::DOUBLE, 0) AS length FROM documents LEFT JOIN labels USING (doc_id)""")
def nb_clamp(t: Tables):
    marked = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("?")).alias("quality"),
        (F.col("n_chars") - 2000).cast("string").alias("length"))
    return counts.clamp_numbers(marked, ["quality", "length"])


@query("safe_key", r"""SELECT page_id, CASE WHEN k = '' THEN 'Null' ELSE k END AS key FROM (SELECT page_id,
 regexp_replace(url, '[^(a-zA-Z0-9\x{4e00}-\x{9fa5})]', '', 'g') AS k FROM pages)""")
def safe_key_query(t: Tables):
    return t.pages.select("page_id", safe_key(F.col("url")).alias("key"))


@query("join_index", f"""SELECT d.doc_id, d.source, d.n_chars, s.splitwords FROM documents d JOIN
 (SELECT doc_id, array_to_string({WORDS_SQL}, ' ') AS splitwords FROM documents) s
 ON d.doc_id = s.doc_id""")
def join_index(t: Tables):
    segmented = doc_words(t).select("doc_id", F.array_join("words", " ").alias("splitwords"))
    return t.documents.select("doc_id", "source", "n_chars").join(segmented, "doc_id")


TOP_TERMS_SQL = """SELECT doc_id, term, tf, tfidf, "rank" FROM (SELECT *, row_number() OVER (
 PARTITION BY doc_id ORDER BY round({score}, 9) DESC, term) AS "rank" FROM ({weights}))
 WHERE "rank" <= {n}"""


@query("doc_hotwords", f"""SELECT doc_id, source, n_chars, hotwords FROM documents JOIN
 (SELECT doc_id, string_agg(term, ' ' ORDER BY "rank") AS hotwords
 FROM ({TOP_TERMS_SQL.format(weights=TFIDF_SQL, n=4, score='tfidf')}) GROUP BY doc_id) USING (doc_id)""")
def doc_hotwords(t: Tables):
    hot = joined_terms(top_terms(tfidf(doc_words(t)), 4), ["doc_id"])
    return t.documents.select("doc_id", "source", "n_chars").join(hot, "doc_id")


@query("zip_join", """SELECT a.row_id, a.doc_id, b.doc_id AS ranked_doc_id, b.n_chars FROM
 (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents) a JOIN
 (SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row_id, doc_id, n_chars FROM documents) b
 ON a.row_id = b.row_id""")
def zip_join(t: Tables):
    ranked = t.documents.select(F.col("doc_id").alias("ranked_doc_id"), "n_chars")
    return zip_rows(t.documents.select("doc_id"), [F.col("doc_id")],
                    ranked, [F.col("n_chars"), F.col("ranked_doc_id")])


@query("stopword_anti", f"""SELECT term, count(*) AS cnt FROM ({TOKENS_SQL})
 WHERE term NOT IN ({STOPWORDS_SQL}) GROUP BY term""")
def stopword_anti(t: Tables):
    stop = t.spark.createDataFrame([(w,) for w in NEWS_STOPWORDS], "term string")
    terms = counts.explode_words(doc_words(t))
    # a fixed list of a few words
    return count_by(terms.join(F.broadcast(stop), "term", "left_anti"), "term")


@query("vocab_semi", f"""SELECT doc_id, count(*) AS known_words FROM ({TOKENS_SQL}) WHERE term IN
 (SELECT unnest({WORDS_SQL}) FROM benchmark) GROUP BY doc_id""")
def vocab_semi(t: Tables):
    known = t.benchmark.select(F.explode(ws_words(F.col("text"))).alias("term")).distinct()
    terms = counts.explode_words(doc_words(t), keep=["doc_id"])
    return count_by(terms.join(known, "term", "left_semi"), "doc_id", name="known_words")


@query("label_counts", "SELECT lang, count(*) AS cnt FROM documents GROUP BY lang")
def label_counts(t: Tables):
    return count_by(t.documents, "lang").orderBy(F.col("cnt").desc(), "lang")


@query("word_count", f"SELECT term, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY term")
def word_count(t: Tables):
    return count_by(counts.explode_words(doc_words(t)), "term").orderBy(F.col("cnt").desc(), "term")


@query("row_prefix_count", """SELECT p_partkey, prefix, count(*) AS cnt FROM (SELECT p_partkey,
 substring(unnest(string_split(p_name, ' ')), 1, 2) AS prefix FROM part) GROUP BY ALL""")
def row_prefix_count(t: Tables):
    return counts.prefix_count_in_row(t.part, "p_partkey", F.split("p_name", " "), 2)


@query("distinct_tokens", f"""SELECT count(DISTINCT term) AS distinct_terms, count(*) AS terms
 FROM ({TOKENS_SQL})""")
def distinct_tokens(t: Tables):
    per_term = count_by(counts.explode_words(doc_words(t)), "term")
    return per_term.agg(F.count(F.lit(1)).alias("distinct_terms"), F.sum("cnt").alias("terms"))


@query("search_keyword_groups", f"""SELECT keyword, count(*) AS cnt, count(DISTINCT user_id) AS users,
 min("time") AS first_time, max("time") AS last_time FROM ({SEARCH_LOG_SQL}) GROUP BY keyword""")
def search_keyword_groups(t: Tables):
    return search_log(t).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("user_id").alias("users"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query("column_summary", """SELECT i - 1 AS pos, round(avg(x), 6) AS mean,
 round(var_samp(x), 6) AS variance, round(min(x), 6) AS minimum FROM (SELECT i, embedding[i]::DOUBLE AS x
 FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)) GROUP BY i""")
def column_summary(t: Tables):
    vectors = t.embeddings.select(as_doubles(F.col("embedding")).alias("v"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "variance", "minimum")]
    return counts.column_summary(vectors, "v").select(F.col("pos").cast("long"), *rounded)


@query("tfidf_minmax", f"""SELECT round(min(tfidf), 6) AS min_tfidf, round(max(tfidf), 6) AS max_tfidf
 FROM ({TFIDF_SQL}) WHERE tfidf <> 0""")
def tfidf_minmax(t: Tables):
    weights = tfidf(doc_words(t)).filter("tfidf <> 0")
    return weights.agg(F.round(F.min("tfidf"), 6).alias("min_tfidf"),
                       F.round(F.max("tfidf"), 6).alias("max_tfidf"))


# A rule that guesses the language by a common word, and one that guesses quality by length.
LANG_GUESS_SQL = """SELECT doc_id, lang AS label, CASE WHEN contains(text, ' the ') THEN 'en'
 WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' le ') THEN 'fr' ELSE 'es' END AS prediction
 FROM documents"""
QUALITY_GUESS_SQL = """SELECT quality AS label, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS long_text,
 CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS not_toxic FROM documents JOIN labels USING (doc_id)"""


def guessed_lang(t: Tables):
    has = F.col("text").contains
    guess = F.when(has(" the "), "en").when(has(" der "), "de").when(has(" le "), "fr").otherwise("es")
    return t.documents.select("doc_id", F.col("lang").alias("label"), guess.alias("prediction"))


def guessed_quality(t: Tables):
    """``(model, label, prediction)`` of two rules, one below the other."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    rules = {"long_text": F.col("n_chars") >= 1000, "not_toxic": F.col("toxic") == 0}
    parts = [rows.select(F.lit(m).alias("model"), F.col("quality").alias("label"),
                         rule.cast("int").alias("prediction")) for m, rule in rules.items()]
    return parts[0].unionByName(parts[1])


@query("accuracy", f"""SELECT round(avg((label = prediction)::INT), 6) AS accuracy, count(*) AS cnt
 FROM ({LANG_GUESS_SQL})""")
def accuracy(t: Tables):
    correct = (F.col("label") == F.col("prediction")).cast("int")
    return guessed_lang(t).agg(F.round(F.avg(correct), 6).alias("accuracy"), F.count(F.lit(1)).alias("cnt"))


WEIGHTED_F1_SQL = """SELECT round(sum(n * CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n + predicted) END)
 / sum(n), 6) AS weighted_f1 FROM (SELECT c.label, c.n, coalesce(p.predicted, 0) AS predicted,
 c.tp FROM (SELECT label, count(*) AS n, count(*) FILTER (label = prediction) AS tp FROM guess GROUP BY label) c
 LEFT JOIN (SELECT prediction, count(*) AS predicted FROM guess GROUP BY prediction) p ON c.label = p.prediction)"""


@query("weighted_f1", f"WITH guess AS ({LANG_GUESS_SQL}) {WEIGHTED_F1_SQL}")
def weighted_f1_query(t: Tables):
    return weighted_f1(guessed_lang(t)).select(F.round("weighted_f1", 6).alias("weighted_f1"))


QUALITY_LONG_SQL = f"""SELECT model, label, prediction FROM (
 SELECT 'long_text' AS model, label, long_text AS prediction FROM ({QUALITY_GUESS_SQL}) UNION ALL
 SELECT 'not_toxic', label, not_toxic FROM ({QUALITY_GUESS_SQL}))"""
CONFUSION_SQL = """SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
 count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1) AS pos,
 count(*) FILTER (label = 0) AS neg FROM ({rows}) GROUP BY model"""
AREAS_SQL = f"""SELECT model, (tp / pos::DOUBLE + 1 - fp / neg::DOUBLE) / 2 AS roc, CASE WHEN tp + fp = 0 THEN pos / (pos + neg)::DOUBLE ELSE
 (tp / pos::DOUBLE) * (tp / (tp + fp)::DOUBLE) + (1 - tp / pos::DOUBLE) *
 (tp / (tp + fp)::DOUBLE + pos / (pos + neg)::DOUBLE) / 2 END AS pr
 FROM ({CONFUSION_SQL.format(rows=QUALITY_LONG_SQL)})"""


@query("auc_hard", f"SELECT model, round(pr, 6) AS pr, round(roc, 6) AS roc FROM ({AREAS_SQL})")
def auc_hard(t: Tables):
    areas = hard_label_areas(guessed_quality(t))
    return areas.select("model", F.round("pr", 6).alias("pr"), F.round("roc", 6).alias("roc"))


@query("union_metrics", f"""SELECT model, 'pr' AS metric, round(pr, 6) AS "value" FROM ({AREAS_SQL}) UNION ALL
 SELECT model, 'roc', round(roc, 6) FROM ({AREAS_SQL}) UNION ALL SELECT model, 'accuracy',
 round(avg((label = prediction)::INT), 6) FROM ({QUALITY_LONG_SQL}) GROUP BY model""")
def union_metrics(t: Tables):
    scores = hard_label_scores(guessed_quality(t))
    return scores.select("model", "metric", F.round("value", 6).alias("value"))


@query("metric_report", f"""SELECT model, printf('%.4f%%', pr * 100) AS pr, printf('%.4f%%', roc * 100) AS roc
 FROM ({AREAS_SQL})""")
def metric_report(t: Tables):
    areas = hard_label_areas(guessed_quality(t))
    return areas.select("model", percent(F.col("pr")).alias("pr"), percent(F.col("roc")).alias("roc"))


@query("rare_tokens", f"SELECT term, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY term HAVING count(*) < 2")
def rare_tokens(t: Tables):
    return counts.rare_terms(counts.explode_words(doc_words(t)))


@query("cluster_top_docs", f"""SELECT prediction, doc_id, round(p, 6) AS p, "rank" FROM (SELECT *,
 row_number() OVER (PARTITION BY prediction ORDER BY p DESC, doc_id) AS "rank" FROM ({DOCS_SQL}))
 WHERE "rank" <= 15""")
def cluster_top_docs(t: Tables):
    docs = labelled_docs(t).select("prediction", "doc_id", "p")
    top = counts.top_by_group(docs, ["prediction"], [F.col("p").desc(), F.col("doc_id")], 15)
    return top.withColumn("p", F.round("p", 6))


CENTERS_SQL = """SELECT label, i AS pos, avg(embedding[i]::DOUBLE) AS c FROM embeddings,
 unnest(range(1, len(embedding) + 1)) u(i) GROUP BY label, i"""
CENTER_DIST_SQL = f"""SELECT e.vec_id, e.label, sum((e.x - c.c) * (e.x - c.c)) AS sq_dist FROM
 (SELECT vec_id, label, i AS pos, embedding[i]::DOUBLE AS x FROM embeddings,
 unnest(range(1, len(embedding) + 1)) u(i)) e JOIN ({CENTERS_SQL}) c ON e.label = c.label AND e.pos = c.pos
 GROUP BY e.vec_id, e.label"""


def vectors(t: Tables):
    return t.embeddings.select("vec_id", "label", as_doubles(F.col("embedding")).alias("v"))


@query("cluster_nearest_docs", f"""SELECT label, vec_id, round(sq_dist, 6) AS sq_dist, "rank" FROM (SELECT *,
 row_number() OVER (PARTITION BY label ORDER BY round(sq_dist, 9), vec_id) AS "rank" FROM ({CENTER_DIST_SQL}))
 WHERE "rank" <= 10""")
def cluster_nearest_docs(t: Tables):
    v = vectors(t)
    near = center_distance(v, group_means(v, "label", "v"), "label", "v").select("label", "vec_id", "sq_dist")
    top = counts.top_by_group(near, ["label"], [F.round("sq_dist", 9), F.col("vec_id")], 10)
    return top.withColumn("sq_dist", F.round("sq_dist", 6))


@query("tfidf_top_terms", f"""SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf, "rank"
 FROM ({TOP_TERMS_SQL.format(weights=TFIDF_SQL, n=3, score='tfidf')})""")
def tfidf_top_terms(t: Tables):
    return top_terms(tfidf(doc_words(t)), 3).withColumn("tfidf", F.round("tfidf", 6))


@query("tf_top_terms", f"""SELECT doc_id, term, tf, "rank" FROM (SELECT *, row_number() OVER (
 PARTITION BY doc_id ORDER BY tf DESC, term) AS "rank" FROM ({TF_SQL})) WHERE "rank" <= 5""")
def tf_top_terms(t: Tables):
    return top_terms(term_frequency(doc_words(t)), 5, score="tf")


@query("argmax_label", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS topic,
 round(list_max(embedding)::DOUBLE, 6) AS p FROM embeddings""")
def argmax_label(t: Tables):
    v = vectors(t)
    return v.select("vec_id", argmax(F.col("v")).alias("topic"), F.round(F.array_max("v"), 6).alias("p"))


@query("distinct_words", f"SELECT DISTINCT term FROM ({TOKENS_SQL})")
def distinct_words(t: Tables):
    return counts.explode_words(doc_words(t)).distinct()


@query("format_tokens", r"""SELECT conv_id, turn, replace(regexp_replace(array_to_string(
 string_split(text, ' '), ','), '[\[\]() ]', '', 'g'), ',', ' ') AS line FROM conversations""")
def format_tokens_query(t: Tables):
    return t.conversations.select("conv_id", "turn", format_tokens(F.split("text", " ")).alias("line"))
