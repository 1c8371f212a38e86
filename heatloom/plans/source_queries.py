"""Registered queries: readers and writers, each fed through its own file format."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions.text import safe_key, ws_words
from heatloom.functions.unnest import unnest
from heatloom.plans.fixtures import DOCS_SQL, POSTS_SQL, WORDS_SQL, labelled_docs, posts, texts
from heatloom.plans.registry import Tables, query
from heatloom.session import scratch_path
from heatloom.sources import readers, sinks
from heatloom.sources.lexicon import load_lexicon


@query("scan_posts", POSTS_SQL)
def scan_posts(t: Tables):
    path = scratch_path(t.spark, "posts")
    sinks.write_delimited(posts(t), path)
    back = readers.read_posts(t.spark, path)
    # a text without any word is an empty cell, which CSV gives back as NULL
    return back.withColumn("text", F.coalesce("text", F.lit("")))


@query("scan_forum", rf"""SELECT source AS title, lang AS content,
 trim(regexp_replace(text, '\W+', ' ', 'g')) AS text, 'user' || (doc_id % 97) AS name,
 replies::INTEGER AS recall, 'forum' AS net FROM ({DOCS_SQL})""")
def scan_forum(t: Tables):
    plain = F.trim(F.regexp_replace("text", r"\W+", " "))
    rows = labelled_docs(t).select(
        F.col("source").alias("title"), F.col("lang").alias("content"), plain.alias("text"),
        F.concat(F.lit("user"), F.col("doc_id") % 97).alias("name"),
        F.lit("2024-01-01 00:00").alias("time"), F.col("replies").cast("int").alias("recall"),
        F.lit("forum").alias("net"),
    )
    path = scratch_path(t.spark, "forum")
    sinks.write_delimited(rows, path)
    back = readers.read_forum(t.spark, path).drop("time")
    return back.withColumn("text", F.coalesce("text", F.lit("")))


@query("scan_reviews", r"""SELECT quality::DOUBLE AS score,
 trim(regexp_replace(text, '\W+', ' ', 'g')) AS comments, source AS customer_type
 FROM documents JOIN labels USING (doc_id)""")
def scan_reviews(t: Tables):
    plain = F.trim(F.regexp_replace("text", r"\W+", " "))
    rows = t.documents.join(t.labels, "doc_id").select(
        F.col("quality").cast("double"), "source", plain.alias("comments")
    )
    path = scratch_path(t.spark, "reviews")
    sinks.write_delimited(rows, path)
    back = readers.read_reviews(t.spark, path)
    return back.withColumn("comments", F.coalesce("comments", F.lit("")))


SEARCH_LOG_SQL = """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "time", user_id,
 '[' || event_type || ']' AS keyword, (event_id % 10)::VARCHAR AS "rank", url
 FROM events JOIN pages ON event_id % (SELECT count(*) FROM pages) = page_id"""


def search_log(t: Tables):
    """A search log: each event is a query for its type, its click a page."""
    n_pages = t.pages.count()
    log = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "user_id",
        F.concat(F.lit("["), "event_type", F.lit("]")).alias("keyword"),
        (F.col("event_id") % 10).cast("string").alias("rank"),
        (F.col("event_id") % n_pages).alias("page_id"),
    )
    return log.join(t.pages.select("page_id", "url"), "page_id").drop("page_id")


@query("scan_search_log", SEARCH_LOG_SQL)
def scan_search_log(t: Tables):
    path = scratch_path(t.spark, "searchlog")
    sinks.write_delimited(search_log(t), path, sep="\t")
    return readers.read_search_log(t.spark, path)


@query("search_log_split", rf"""SELECT regexp_replace(keyword, '[^(a-zA-Z0-9)]', '', 'g') AS folder,
 count(*) AS cnt, count(DISTINCT user_id) AS users FROM ({SEARCH_LOG_SQL}) GROUP BY 1""")
def search_log_split(t: Tables):
    path = scratch_path(t.spark, "bykey")
    keyed = search_log(t).withColumn("key", safe_key(F.col("keyword")))
    sinks.write_by_key(keyed, "key", path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("folder").cast("string")).agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("user_id").alias("users")
    )


@query("scan_labelled", f"""SELECT doc_id::VARCHAR AS key, lang AS category, n_chars::DOUBLE AS f0,
 CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE len({WORDS_SQL})::DOUBLE END AS f1, quality AS label
 FROM documents JOIN labels USING (doc_id)""")
def scan_labelled(t: Tables):
    n_words = F.size(ws_words(F.col("text"))).cast("string")
    rows = t.documents.join(t.labels, "doc_id")
    cells = [F.col("doc_id").cast("string"), F.col("source"), F.lit("-"), F.col("lang"),
             F.col("n_chars").cast("string"), F.when(F.col("toxic") == 1, "?").otherwise(n_words),
             F.col("quality").cast("string")]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in cells]
    path = scratch_path(t.spark, "labelled")
    sinks.write_lines(rows.select(F.concat_ws("\t", *quoted).alias("value")), path)
    back = readers.read_labelled_tsv(t.spark, path)
    return back.select("key", "category", F.col("features")[0].alias("f0"),
                       F.col("features")[1].alias("f1"), "label")


@query("doc_label_from_path", """SELECT page_id, string_split(url, '/')[-2] AS label,
 string_split(url, '/')[-1] AS name FROM pages""")
def doc_label_from_path(t: Tables):
    url = F.col("url")
    return t.pages.select("page_id", readers.path_label(url).alias("label"),
                          readers.path_name(url).alias("name"))


@query("scan_header_csv", """SELECT p_name AS name, p_brand AS brand, p_size::VARCHAR AS size
 FROM part""")
def scan_header_csv(t: Tables):
    path = scratch_path(t.spark, "header")
    rows = t.part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
                         F.col("p_name").alias("name"))
    sinks.write_delimited(rows, path, header=True)
    return readers.read_header_csv(t.spark, path).select("name", "brand", "size")


@query("scan_lines", r"""SELECT line, count(*) AS cnt FROM (SELECT unnest(string_split(
 regexp_replace(text, '\r', '', 'g'), chr(10))) AS line FROM conversations) GROUP BY line""")
def scan_lines(t: Tables):
    path = scratch_path(t.spark, "lines")
    clean = F.regexp_replace("text", "\r", "")
    sinks.write_lines(t.conversations.select(clean.alias("value")), path)
    lines = readers.read_lines(t.spark, path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


@query("sink_roundtrip", f"""SELECT prediction, count(*) AS cnt, sum(replies)::BIGINT AS replies
 FROM ({DOCS_SQL}) GROUP BY prediction""")
def sink_roundtrip(t: Tables):
    path = scratch_path(t.spark, "table")
    sinks.write_table(labelled_docs(t).drop("text"), path)
    report = t.spark.read.parquet(path).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("replies").alias("replies"))
    sinks.write_report(report, path + "-report")
    return t.spark.read.schema(report.schema).csv(path + "-report", header=True)


@query("lexicon_load", f"""SELECT word, 'n' AS pos, string_agg(lang, ',' ORDER BY lang) AS synonyms,
 sum(cnt)::BIGINT AS freq, 'EN_WORD' AS "type" FROM (SELECT word, lang, count(*) AS cnt
 FROM (SELECT lang, unnest({WORDS_SQL}) AS word FROM documents)
 WHERE regexp_full_match(word, '[a-z]+') GROUP BY word, lang) GROUP BY word""")
def lexicon_load(t: Tables):
    words = unnest(texts(t, "lang"), ws_words(F.col("text")), "lang", name="word")
    words = words.filter(F.col("word").rlike("^[a-z]+$"))
    entries = words.groupBy("word").agg(
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
        F.count(F.lit(1)).alias("freq"))
    line = F.concat_ws("/", "word", F.lit("n"), F.lit("null"), "langs", "freq")
    path = scratch_path(t.spark, "lexicon")
    sinks.write_delimited(entries.select(line.alias("EN_WORD")), path, sep="\t", header=True)
    return load_lexicon(t.spark, path).select(
        "word", "pos", F.array_join("synonyms", ",").alias("synonyms"), "freq", "type")
