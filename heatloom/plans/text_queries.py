"""Registered queries: tokens, segmentation, keywords in context, heat and chart feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions.text import NEWS_STOPWORDS, is_numeric, ws_words
from heatloom.functions.unnest import spread, unnest
from heatloom.operators import feeds, heat, terms
from heatloom.operators.counts import count_by, explode_words, positions, top_by_group
from heatloom.operators.kwic import kwic
from heatloom.operators.small import checked_broadcast
from heatloom.operators.weights import best_first, group_tfidf
from heatloom.plans.fixtures import AS_OF, CLUSTERS, DOCS_SQL, TF_SQL, TOKENS_SQL, WORDS_SQL, doc_words, labelled_docs, post_time, texts
from heatloom.plans.registry import Tables, query
from heatloom.plans.row_queries import STOPWORDS_SQL
from heatloom.session import checkpoint_root, scratch_path
from heatloom.sources.readers import read_cluster_docs
from heatloom.sources.sinks import write_delimited
from heatloom.streaming.heat import stream_window_tops
from heatloom.streaming.trend import write_available

KWIC_WORDS = ["the", "sich", "avec"]
MAX_TOP_DOCS = 100_000
KWIC_SQL = ", ".join(f"'{w}'" for w in KWIC_WORDS)


@query("tokenize_ws", TOKENS_SQL)
def tokenize_ws(t: Tables):
    out = positions(doc_words(t))
    return out.withColumn("pos", F.col("pos").cast("long"))


NEWS_TF_SQL = rf"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, lower(unnest(
 string_split_regex(text, '\W+'))) AS term FROM documents) WHERE NOT regexp_matches(term, '[0-9]')
 AND length(term) >= 2 AND term NOT IN ({STOPWORDS_SQL}) GROUP BY doc_id, term"""


@query("tokenize_clean", f"""WITH tf AS ({NEWS_TF_SQL}) SELECT * FROM tf WHERE term IN
 (SELECT term FROM tf GROUP BY term HAVING sum(tf) >= 2)""")
def tokenize_clean(t: Tables):
    return terms.clean_terms(texts(t)).select("doc_id", "term", "tf")


# Words of ``source (text)``: runs of a-z cut by the benchmark's words, other runs as they are.
SEGMENT_SQL = rf"""WITH RECURSIVE lexicon AS MATERIALIZED (SELECT DISTINCT word FROM
 (SELECT unnest({WORDS_SQL}) AS word FROM benchmark) WHERE regexp_full_match(word, '[a-z]{{1,7}}')),
 runs AS MATERIALIZED (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(text),
 '[a-z]+')) AS run FROM SOURCE) GROUP BY run),
 steps AS (SELECT run, 1 AS i, NULL::VARCHAR AS word FROM runs UNION ALL
 SELECT run, i + CASE WHEN w IS NULL THEN 1 ELSE length(w) END, w FROM (SELECT s.run, s.i,
 (SELECT max_by(l.word, length(l.word)) FROM lexicon l, range(1, 8) n(k)
 WHERE l.word = substring(s.run, s.i, n.k::INT) AND s.i + n.k - 1 <= length(s.run)) AS w
 FROM steps s WHERE s.i <= length(s.run))),
 others AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[a-z]+', ' ', 'g'), '[\p{{L}}\p{{N}}]+')) AS word FROM SOURCE),
 found AS (SELECT word, times FROM steps JOIN runs USING (run) WHERE word IS NOT NULL UNION ALL SELECT word, 1 FROM others)
 SELECT word AS term, sum(times)::BIGINT AS cnt FROM found WHERE word NOT IN ({STOPWORDS_SQL}) AND EXTRA GROUP BY word"""


def cut_by_benchmark(t: Tables, docs, doc: str):
    stop = t.spark.createDataFrame([(w,) for w in NEWS_STOPWORDS], "word string")
    lexicon = t.benchmark.select(F.explode(ws_words(F.col("text"))).alias("word"))
    return explode_words(terms.segment_corpus(docs, lexicon, stop, doc=doc, dictionary_chars="a-z"))


@query("chat_word_count", SEGMENT_SQL.replace("SOURCE", "conversations").replace(
    "EXTRA", "length(word) > 1 AND NOT regexp_full_match(word, '[0-9]*')"))
def chat_word_count(t: Tables):
    chats = spread(t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("line"), "text"), "line")
    words = cut_by_benchmark(t, chats, "line").filter(~is_numeric(F.col("term")) & (F.length("term") > 1))
    return count_by(words, "term").orderBy(F.col("cnt").desc(), "term")


@query("segment_corpus", SEGMENT_SQL.replace("SOURCE", "documents").replace("EXTRA", "true"))
def segment_corpus_query(t: Tables):
    """Text cut by the words of the benchmark items."""
    return count_by(cut_by_benchmark(t, texts(t), "doc_id"), "term")


# A small lexicon of our own.
SYNONYMS = {
    "the": ["der", "le", "el"], "and": ["und", "et"], "with": ["mit", "avec", "con"],
    "of": ["von", "de"], "for": ["pour", "por"], "from": ["aus"], "this": ["dies"],
}
SYNONYMS_SQL = ", ".join(f"('{w}', {s!r})" for w, s in SYNONYMS.items())


@query("synonym_expand", f"""WITH tok AS ({TOKENS_SQL}) SELECT doc_id, pos, term AS origin, term FROM tok
 UNION ALL SELECT doc_id, pos, term AS origin, unnest(syn) AS term FROM tok
 JOIN (VALUES {SYNONYMS_SQL}) l(word, syn) ON term = word""")
def synonym_expand(t: Tables):
    lexicon = t.spark.createDataFrame(list(SYNONYMS.items()), "word string, synonyms array<string>")
    tokens = positions(doc_words(t)).withColumn("pos", F.col("pos").cast("long"))
    return terms.expand_synonyms(tokens, lexicon)


CONTEXT_SQL = """SELECT {cols}, term AS word, array_to_string(list_concat(list_concat(coalesce(before, []),
 ['(' || term || ')']), list_concat(coalesce(after, []), [''])), ' ') AS context FROM (SELECT *,
 list(term) OVER ({part} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before,
 list(term) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after
 FROM ({tokens})) WHERE term IN ({words})"""


@query("kwic", CONTEXT_SQL.format(cols="doc_id, pos", part="PARTITION BY doc_id ORDER BY pos",
                                  tokens=TOKENS_SQL, words=KWIC_SQL))
def kwic_query(t: Tables):
    return kwic(doc_words(t), KWIC_WORDS).withColumn("pos", F.col("pos").cast("long"))


@query("kwic_cross_document", CONTEXT_SQL.format(
    cols="pos", part="ORDER BY pos", words=KWIC_SQL,
    tokens=f"SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, term FROM ({TOKENS_SQL})"))
def kwic_cross_document(t: Tables):
    return kwic(doc_words(t), KWIC_WORDS, cross_document=True)


@query("post_age", f"SELECT doc_id, age_s FROM ({DOCS_SQL})")
def post_age(t: Tables):
    written = F.date_format(post_time(), heat.TIME_FORMAT)
    posts = labelled_docs(t).select("doc_id", written.alias("time"))
    return heat.post_age(posts, AS_OF).select("doc_id", "age_s")


@query("cluster_docs", f"""SELECT post_num, doc_id AS "index", printf('%.4f', p) AS max_probability, prediction,
 strftime(TIMESTAMP '{AS_OF}' - to_seconds(age_s), '%Y-%m-%d,%H:%M') AS "time", replies AS recall
 FROM (SELECT *, row_number() OVER (PARTITION BY prediction ORDER BY p DESC, doc_id) AS rn,
 count(*) OVER (PARTITION BY prediction) AS post_num FROM ({DOCS_SQL})) WHERE rn <= 15""")
def cluster_docs(t: Tables):
    docs = labelled_docs(t).drop("text")
    top = heat.cluster_docs(docs).join(count_by(docs, "prediction", name="post_num"), "prediction")
    return top.select("post_num", F.col("doc_id").alias("index"), F.format_string("%.4f", "p").alias("max_probability"),
                      "prediction", F.date_format(post_time(), heat.TIME_FORMAT).alias("time"),
                      F.col("replies").alias("recall"))


HEAT_SQL = f"""SELECT prediction, post_num, support, attention, timeliness, burst, purity,
 0.3 * support + 0.3 * attention + 0.2 * timeliness + 0.1 * burst + 0.1 * purity AS heat FROM (
 SELECT t.prediction, any_value(s.post_num) AS post_num,
 any_value(s.post_num) / (SELECT count(*) FROM documents)::DOUBLE AS support,
 avg(log10(replies + 1)) / (10 * log10(20)) AS attention, -avg(log10(age_s + 1)) / (10 * log10(6000)) AS timeliness,
 var_pop(p) * sum(p) AS burst, -1 / sum(p * log2(p)) AS purity FROM (SELECT *, row_number() OVER (
 PARTITION BY prediction ORDER BY p DESC, doc_id) AS rn FROM ({DOCS_SQL})) t
 JOIN (SELECT prediction, count(*) AS post_num FROM ({DOCS_SQL}) GROUP BY prediction) s
 ON t.prediction = s.prediction WHERE rn <= 15 GROUP BY t.prediction)"""
MEASURES = ["support", "attention", "timeliness", "burst", "purity", "heat"]
ROUNDED_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)
# The share is charted, the intensity itself is given as 1 + prediction / 10.
TOTAL_SQL = f"""SELECT *, (1 + prediction / 10.0::DOUBLE) * 0.1 AS intensity_share,
 heat + (1 + prediction / 10.0::DOUBLE) * 0.1 AS total_heat FROM ({HEAT_SQL})"""


# Fixed value: corpus size of the published scores.
PUBLISHED_CORPUS = 4958


@query("heat_of_exchange", f"""SELECT prediction, post_num, round(post_num / {PUBLISHED_CORPUS}::DOUBLE, 6) AS support,
 round(heat - 0.3 * support + 0.3 * post_num / {PUBLISHED_CORPUS}::DOUBLE, 6) AS heat FROM ({HEAT_SQL})""")
def heat_of_exchange(t: Tables):
    """Heat from files in the exchange format, with the corpus size given."""
    docs = labelled_docs(t).select("doc_id", "p", "prediction", "replies",
                                   F.date_format(post_time(), heat.TIME_FORMAT).alias("time"))
    share = (1 - F.col("p")) / (CLUSTERS - 1)
    spread_out = F.transform(F.sequence(F.lit(0), F.lit(CLUSTERS - 1)),
                             lambda i: F.when(i == F.col("prediction"), F.col("p")).otherwise(share))
    path = scratch_path(t.spark, "clusterdocs")
    write_delimited(heat.exchange_rows(docs.withColumn("distribution", spread_out)), path, sep=" ")
    scores = heat.heat_of_exchange(read_cluster_docs(t.spark, path), AS_OF, PUBLISHED_CORPUS)
    return scores.select("prediction", "post_num", F.round("support", 6).alias("support"), F.round("heat", 6).alias("heat"))


def scored(t: Tables):
    return heat.topic_heat(labelled_docs(t))


def total_scored(t: Tables):
    given = labelled_docs(t).select("prediction").distinct()
    intensity = given.withColumn("intensity", 1 + F.col("prediction") / F.lit(10.0))
    total = heat.total_heat(scored(t), intensity)
    return total.withColumn("intensity_share", F.col("intensity") * heat.INTENSITY_WEIGHT)


@query("topic_heat", f"SELECT prediction, post_num, {ROUNDED_SQL} FROM ({HEAT_SQL})")
def topic_heat(t: Tables):
    return scored(t).select("prediction", "post_num", *[F.round(m, 6).alias(m) for m in MEASURES])


@query("total_heat", f"""SELECT prediction, post_num, {ROUNDED_SQL}, round(intensity_share, 6) AS intensity_share,
 round(total_heat, 6) AS total_heat FROM ({TOTAL_SQL})""")
def total_heat(t: Tables):
    columns = MEASURES + ["intensity_share", "total_heat"]
    return total_scored(t).select("prediction", "post_num", *[F.round(m, 6).alias(m) for m in columns])


@query("topic_intensity_given", f"""SELECT prediction AS topic, round(sum(weight) / (SELECT count(DISTINCT term)
 FROM ({TOKENS_SQL})), 6) AS intensity FROM (SELECT prediction, term, sum(p) AS weight FROM ({DOCS_SQL}) d
 JOIN ({TOKENS_SQL}) k ON d.doc_id = k.doc_id GROUP BY prediction, term) GROUP BY prediction""")
def topic_intensity_given(t: Tables):
    words = unnest(spread(labelled_docs(t), "doc_id"), ws_words(F.col("text")), "prediction", "p")
    weights = words.groupBy(F.col("prediction").alias("topic"), "term").agg(F.sum("p").alias("weight"))
    return heat.intensity_from_weights(weights).withColumn("intensity", F.round("intensity", 6))


@query("heat_series", f"""SELECT prediction, series, round("value", 6) AS "value" FROM (SELECT prediction, support,
 attention, abs(timeliness) AS timeliness, burst, purity, heat, intensity_share, total_heat FROM ({TOTAL_SQL}))
 UNPIVOT ("value" FOR series IN (support, attention, timeliness, burst, purity, heat, intensity_share, total_heat))""")
def heat_series(t: Tables):
    return feeds.heat_series(total_scored(t)).withColumn("value", F.round("value", 6))


@query("heat_trend", """SELECT strftime(time_bucket(INTERVAL '3 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')
 AS window_start, event_type, count(*) AS cnt, round(sum("value"), 4) AS total FROM events GROUP BY 1, 2""")
def heat_trend(t: Tables):
    trend = feeds.heat_trend(t.events, "ts", "event_type", "value")
    return trend.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                        "cnt", F.round("total", 4).alias("total"))


DATE_STEP, LATENESS = "3 days", "1 day"
# Posts of each step, the best 15 of each cluster in it, ages at the end of the step.
HEAT_BY_DATE_SQL = f"""WITH d AS (SELECT doc_id, prediction, p, replies, TIMESTAMP '{AS_OF}' - to_seconds(age_s) AS posted FROM ({DOCS_SQL})),
 w AS (SELECT *, time_bucket(INTERVAL '{DATE_STEP}', posted, TIMESTAMP '1970-01-01') AS window_start FROM d),
 r AS (SELECT *, date_diff('second', posted, window_start + INTERVAL '{DATE_STEP}') AS age, count(*) OVER (PARTITION BY window_start)
 AS posts, count(*) OVER (PARTITION BY window_start, prediction) AS post_num, row_number() OVER (PARTITION BY window_start, prediction
 ORDER BY p DESC, doc_id) AS rn FROM w),
 m AS (SELECT window_start, prediction, any_value(post_num) AS post_num, any_value(post_num) / any_value(posts)::DOUBLE AS support,
 avg(log10(replies + 1)) / (10 * log10(20)) AS attention, -avg(log10(age + 1)) / (10 * log10(6000)) AS timeliness,
 var_pop(p) * sum(p) AS burst, -1 / sum(p * log2(p)) AS purity FROM r WHERE rn <= 15 GROUP BY window_start, prediction),
 h AS (SELECT *, 0.3 * support + 0.3 * attention + 0.2 * timeliness + 0.1 * burst + 0.1 * purity AS heat FROM m)
 SELECT strftime(window_start, '%Y-%m-%d') AS "date", prediction, post_num, {ROUNDED_SQL},
 round(heat + (1 + prediction / 10.0::DOUBLE) * 0.1, 6) AS total_heat FROM h"""


def dated_docs(docs):
    return docs.select("doc_id", "prediction", "p", "replies", post_time().cast("timestamp").alias("time"))


def dated_heat(tops):
    given = tops.select("prediction").distinct().withColumn("intensity", 1 + F.col("prediction") / F.lit(10.0))
    rows = heat.heat_by_window(tops, given)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("date"), "prediction", "post_num",
                       *[F.round(m, 6).alias(m) for m in [*MEASURES, "total_heat"]])


@query("heat_by_date", HEAT_BY_DATE_SQL)
def heat_by_date(t: Tables):
    """Total heat of each cluster at each date, from the posts of that date."""
    return dated_heat(heat.window_tops(dated_docs(labelled_docs(t)), DATE_STEP))


@query("heat_by_date_stream", f"""{HEAT_BY_DATE_SQL} WHERE window_start + INTERVAL '{DATE_STEP}'
 < (SELECT max(posted) FROM d) - INTERVAL '{LATENESS}'""")
def heat_by_date_stream(t: Tables):
    """The same as a stream over the documents: the dates that are finished."""
    docs = t.documents
    posts = t.spark.readStream.schema(docs.schema).parquet(f"{t.root}/documents.parque[t]")  # a pattern may name a file too
    tops = stream_window_tops(dated_docs(labelled_docs(t, posts)), DATE_STEP, LATENESS)
    path = scratch_path(t.spark, "heat-tops")
    write_available(tops, path).awaitTermination()
    return dated_heat(t.spark.read.schema(tops.schema).parquet(path))


# The IDF is fitted inside the top documents of each cluster.
GROUP_TFIDF_SQL = f"""WITH top AS MATERIALIZED (SELECT doc_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY
 prediction ORDER BY p DESC, doc_id) AS rn FROM ({DOCS_SQL})) WHERE rn <= 15),
 tf AS MATERIALIZED (SELECT prediction, doc_id, term, tf FROM ({TF_SQL}) JOIN top USING (doc_id)),
 w AS MATERIALIZED (SELECT tf.prediction, doc_id, tf.term, tf, tf * ln((m + 1) / (df + 1.0::DOUBLE)) AS tfidf FROM tf
 JOIN (SELECT prediction, term, count(*) AS df FROM tf GROUP BY ALL) d
 ON tf.prediction = d.prediction AND tf.term = d.term
 JOIN (SELECT prediction, count(*) AS m FROM top GROUP BY prediction) s ON tf.prediction = s.prediction)"""


def top_cluster_words(t: Tables):
    # ranks come from narrow rows; the texts of the few top documents are fetched afterwards
    top = heat.cluster_docs(labelled_docs(t).select("doc_id", "prediction", "p"))
    top = checked_broadcast(top.select("doc_id", "prediction", "rank"), MAX_TOP_DOCS)
    words = t.documents.select("doc_id", "text").join(top, "doc_id")
    words = words.select("prediction", "doc_id", "rank", ws_words(F.col("text")).alias("words"))
    checkpoint_root(t.spark)
    return words.checkpoint()  # a few documents per cluster, read once from the whole table


def cluster_weights(t: Tables):
    return group_tfidf(top_cluster_words(t), "prediction")


@query("cluster_tfidf", f"{GROUP_TFIDF_SQL} SELECT prediction, doc_id, term, tf, round(tfidf, 6) AS tfidf FROM w")
def cluster_tfidf(t: Tables):
    return cluster_weights(t).withColumn("tfidf", F.round("tfidf", 6))


KEYWORDS_SQL = """, kw AS (SELECT prediction, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
 PARTITION BY prediction ORDER BY round(score, 9) DESC, term) AS rn FROM (SELECT prediction, term, sum(tfidf) AS score
 FROM w GROUP BY ALL)) WHERE rn <= 6)"""


def cluster_keywords(t: Tables):
    sums = cluster_weights(t).groupBy("prediction", "term").agg(F.sum("tfidf").alias("score"))
    top = top_by_group(sums, ["prediction"], best_first("score"), feeds.TOPIC_KEYWORDS)
    return top.select("prediction", "term", F.round("score", 6).alias("score"))


@query("topic_graph_nodes", f"""{GROUP_TFIDF_SQL}{KEYWORDS_SQL} SELECT 'hot topics' AS name, 'root' AS kind,
 NULL::BIGINT AS topic, NULL::DOUBLE AS weight UNION ALL SELECT DISTINCT 'topic ' || prediction, 'topic', prediction,
 NULL FROM kw UNION ALL SELECT term, 'keyword', prediction, score FROM kw""")
def topic_graph_nodes(t: Tables):
    return feeds.topic_graph_nodes(cluster_keywords(t))


@query("topic_graph_links", f"""{GROUP_TFIDF_SQL}{KEYWORDS_SQL} SELECT DISTINCT 'hot topics' AS source,
 'topic ' || prediction AS target FROM kw UNION ALL SELECT term, 'topic ' || prediction FROM kw""")
def topic_graph_links(t: Tables):
    return feeds.topic_graph_links(cluster_keywords(t))


@query("word_cloud", f"""SELECT term, cnt, round(cnt * 1000 / (max(cnt) OVER ())::DOUBLE)::BIGINT AS weight FROM (
 SELECT term, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY term ORDER BY cnt DESC, term LIMIT 47)""")
def word_cloud(t: Tables):
    return feeds.word_cloud(explode_words(doc_words(t)))
