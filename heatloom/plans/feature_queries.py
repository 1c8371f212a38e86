"""Registered queries: term weights, vectors, encodings, splits and nearest vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from heatloom.operators import classify, clusters, nearest, weights, wordvec
from heatloom.operators.counts import explode_words
from heatloom.plans.fixtures import TF_SQL, TFIDF_SQL, TOKENS_SQL, WORDS_SQL, doc_words, labelled_docs
from heatloom.plans.graph_queries import hot_words
from heatloom.plans.registry import Tables, query
from heatloom.plans.row_queries import CENTERS_SQL, vectors
from heatloom.functions.text import ws_words


@query("term_frequency", TF_SQL)
def term_frequency(t: Tables):
    return weights.term_frequency(doc_words(t))


@query("vocabulary", f"""SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS term_id
 FROM (SELECT term, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY term)""")
def vocabulary(t: Tables):
    return weights.vocabulary(explode_words(doc_words(t)))


@query("hashing_tf")
def hashing_tf(t: Tables):
    hashed = clusters.hashed_tfidf(doc_words(t))
    tf, weight = vector_to_array("hashed_tf"), vector_to_array("features")
    total = F.aggregate(tf, F.lit(0.0), lambda acc, x: acc + x)
    used = F.size(F.filter(tf, lambda x: x > 0))
    return hashed.select("doc_id", F.size("words").alias("words"), total.alias("hashed_words"), used.alias("buckets"),
                         F.round(F.array_max(weight), 6).alias("max_tfidf"))


@query("tfidf", f"SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM ({TFIDF_SQL})")
def tfidf(t: Tables):
    return weights.tfidf(doc_words(t)).withColumn("tfidf", F.round("tfidf", 6))


# A list of common words and one of uncommon words, the last in no document.
LISTED = [("the", "common"), ("of", "common"), ("and", "common"), ("thatin", "uncommon"), ("hehely", "uncommon"),
          ("telescope", "uncommon")]
LISTED_SQL = ", ".join(str(row) for row in LISTED)


@query("term_idf_lookup", f"""SELECT l.term, l.kind, coalesce(df, 0) AS df,
 round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1.0::DOUBLE)), 6) AS tfidf
 FROM (VALUES {LISTED_SQL}) l(term, kind) LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM ({TOKENS_SQL})
 GROUP BY term) d ON l.term = d.term""")
def term_idf_lookup(t: Tables):
    listed = t.spark.createDataFrame(LISTED, "term string, kind string")
    found = weights.listed_idf(doc_words(t), [term for term, _ in LISTED])
    return listed.join(found, "term").select("term", "kind", "df", F.round("idf", 6).alias("tfidf"))


@query("doc_cosine", f"""WITH w AS MATERIALIZED ({TFIDF_SQL}), n AS (SELECT doc_id, sqrt(sum(tfidf * tfidf)) AS norm FROM w
 GROUP BY doc_id), p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM documents a JOIN documents b
 ON b.doc_id = a.doc_id + 1) SELECT left_id, right_id, round(coalesce(dot, 0) / (l.norm * r.norm), 6) AS cosine FROM p
 LEFT JOIN (SELECT left_id, right_id, sum(x.tfidf * y.tfidf) AS dot FROM p JOIN w x ON x.doc_id = left_id
 JOIN w y ON y.doc_id = right_id AND x.term = y.term GROUP BY left_id, right_id) d USING (left_id, right_id)
 JOIN n l ON l.doc_id = left_id JOIN n r ON r.doc_id = right_id""")
def doc_cosine(t: Tables):
    """Each document against the one with the next number."""
    ids = t.documents.select("doc_id")
    following = ids.select((F.col("doc_id") - 1).alias("left_id"), F.col("doc_id").alias("right_id"))
    pairs = following.join(ids.select(F.col("doc_id").alias("left_id")), "left_id", "left_semi")
    cosine = weights.cosine_pairs(weights.tfidf(doc_words(t)), pairs)
    return cosine.withColumn("cosine", F.round("cosine", 6))


@query("sample_docs")
def sample_docs(t: Tables):
    return t.documents.select("doc_id", "lang").sample(True, 0.1, 42)


NUMBERS_SQL = f"""SELECT doc_id, lang, quality AS label, n_chars::DOUBLE AS n_chars, len({WORDS_SQL})::DOUBLE AS n_words
 FROM documents JOIN labels USING (doc_id)"""


def numbers(t: Tables):
    """Labelled pages: category, two numbers and a 0/1 label."""
    docs = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double"),
                              F.size(ws_words(F.col("text"))).cast("double").alias("n_words"))
    labels = t.labels.select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


@query("standardize", f"""WITH x AS ({NUMBERS_SQL}) SELECT doc_id,
 round((n_chars - (SELECT avg(n_chars) FROM x)) / (SELECT stddev_samp(n_chars) FROM x), 6) AS n_chars,
 round((n_words - (SELECT avg(n_words) FROM x)) / (SELECT stddev_samp(n_words) FROM x), 6) AS n_words FROM x""")
def standardize(t: Tables):
    scaled = classify.standardize(classify.assemble(numbers(t), ["n_chars", "n_words"]))
    z = vector_to_array("scaled")
    return scaled.select("doc_id", F.round(z[0], 6).alias("n_chars"), F.round(z[1], 6).alias("n_words"))


@query("one_hot", """WITH c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang
 FROM documents)) SELECT doc_id, i::INTEGER AS category_index, (SELECT string_agg(CASE WHEN o.i = c.i THEN '1' ELSE '0' END,
 ',' ORDER BY o.i) FROM c o) AS encoded FROM documents JOIN c USING (lang)""")
def one_hot(t: Tables):
    encoded = classify.one_hot(t.documents.select("doc_id", "lang"), "lang")
    cells = F.transform(vector_to_array("encoded"), lambda x: x.cast("int").cast("string"))
    return encoded.select("doc_id", F.col("category_index").cast("int"), F.array_join(cells, ",").alias("encoded"))


@query("dense_vector", """WITH k AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part),
 v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS i FROM k GROUP BY term),
 tf AS (SELECT p_partkey, term, count(*) AS tf FROM k GROUP BY ALL)
 SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, p_partkey, (SELECT string_agg(coalesce(tf.tf, 0)::VARCHAR, ','
 ORDER BY v.i) FROM v LEFT JOIN tf ON tf.term = v.term AND tf.p_partkey = part.p_partkey) AS dense FROM part""")
def dense_vector(t: Tables):
    """Count vectors over the few words of the part names, as dense rows with a running number."""
    rows = t.part.select("p_partkey", ws_words(F.col("p_name")).alias("words"))
    terms = weights.vocabulary(explode_words(rows)).orderBy("term_id")
    model = CountVectorizerModel.from_vocabulary([r["term"] for r in terms.collect()], "words", "counts")
    cells = F.transform(vector_to_array("counts"), lambda x: x.cast("int").cast("string"))
    dense = model.transform(rows).select("p_partkey", F.array_join(cells, ",").alias("dense"))
    return weights.zip_index(dense, [F.col("p_partkey")])


@query("hash_split", """SELECT doc_id, CASE WHEN ((doc_id % 1000003 + 123) * 2654435761) % 4294967296
 < floor(0.6 * 4294967296) THEN 'train' ELSE 'test' END AS split FROM documents""")
def hash_split(t: Tables):
    return classify.hash_split(t.documents.select("doc_id"), "doc_id")


@query("nearest_vectors", f"""WITH c AS MATERIALIZED (SELECT label, list(c ORDER BY pos) AS v FROM ({CENTERS_SQL}) GROUP BY label)
 SELECT label, vec_id, round(cosine, 6) AS cosine, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY label
 ORDER BY round(cosine, 9) DESC, vec_id) AS "rank" FROM (SELECT c.label, e.vec_id,
 list_cosine_similarity(c.v, e.embedding::DOUBLE[]) AS cosine FROM c JOIN embeddings e ON e.label = c.label))
 WHERE "rank" <= 3""")
def nearest_vectors(t: Tables):
    """The vectors nearest to the mean of their own label."""
    v = vectors(t)
    means = clusters.group_means(v, "label", "v")
    # negative numbers, so that no mean carries the name of a vector
    queries = means.select((-1 - F.col("label")).cast("long").alias("query"), F.col("label").alias("scope"), F.col("center").alias("v"))
    candidates = v.select(F.col("vec_id").alias("candidate"), "v", F.array("label").alias("scopes"))
    best = nearest.nearest_by_cosine(queries, candidates, 3)
    return best.select(F.col("scope").alias("label"), F.col("candidate").alias("vec_id"),
                       F.round("cosine", 6).alias("cosine"), "rank")


@query("word2vec")
def word2vec(t: Tables):
    model = nearest.fit_word2vec(doc_words(t))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return nearest.word_vectors(model).select("term", F.size("v").alias("dims"), norm.alias("norm"))


@query("hotword_synonyms")
def hotword_synonyms(t: Tables):
    model = nearest.fit_word2vec(doc_words(t))
    docs = labelled_docs(t).select("prediction", ws_words(F.col("text")).alias("words"))
    return nearest.hotword_synonyms(hot_words(t), docs, model)


# Pairs within the window, drawn terms, then two updates of four-wide vectors; ``u`` and ``v`` are the vectors by position.
WIDE, NEAR, DRAWN, LEAST, VECTOR_STEPS = 4, 2, 2, 5, 2
_VEC_HASH = "('0x' || substr(md5({}), 1, {}))::BIGINT"
SKIPGRAM_SQL = f"""WITH tok AS MATERIALIZED ({TOKENS_SQL}), n AS (SELECT term, count(*) AS n FROM tok GROUP BY term HAVING count(*) >= {LEAST}),
 voc AS MATERIALIZED (SELECT term, w, sum(w) OVER (ORDER BY term) - w AS id FROM (SELECT term, greatest(1, round(pow(n, 0.75)))::BIGINT AS w FROM n)),
 pair AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS n FROM tok l JOIN range(1, {NEAR + 1}) r(d) ON true JOIN tok k
 ON l.doc_id = k.doc_id AND k.pos = l.pos + d JOIN voc x ON x.term = l.term JOIN voc y ON y.term = k.term GROUP BY x.id, y.id),
 both_ways AS MATERIALIZED (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM pair UNION ALL SELECT b, a, n FROM pair) GROUP BY a, b),
 slot AS (SELECT id, id + unnest(range(0, w)) AS slot FROM voc),
 ex AS MATERIALIZED (SELECT a, b, label, sum(n)::DOUBLE AS n FROM (SELECT a, b, 1 AS label, n FROM both_ways UNION ALL
 SELECT p.a, s.id, 0, p.n FROM (SELECT *, {_VEC_HASH.format("a || ':' || b || ':' || j", 15)} % (SELECT sum(w) FROM voc)::BIGINT AS slot
 FROM both_ways, range(1, {DRAWN + 1}) g(j)) p JOIN slot s ON s.slot = p.slot WHERE s.id <> p.b) GROUP BY a, b, label),
 u0 AS (SELECT id, i, ({_VEC_HASH.format("term || ':' || i", 8)} / 4294967296.0::DOUBLE - 0.5) / {WIDE} AS x FROM voc, range(1, {WIDE + 1}) r(i)),
 v0 AS (SELECT id, i, 0.0::DOUBLE AS x FROM u0)"""
for _i in range(VECTOR_STEPS):
    SKIPGRAM_SQL += f""", g{_i} AS MATERIALIZED (SELECT a, b, any_value(ex.n) AS n, label, any_value(ex.n) * (label - 1 / (1 + exp(-sum(u.x * v.x)))) AS g
 FROM ex JOIN u{_i} u ON u.id = a JOIN v{_i} v ON v.id = b AND v.i = u.i GROUP BY a, b, label),
 u{_i + 1} AS MATERIALIZED (SELECT u.id, u.i, u.x + coalesce(d.x, 0) * {wordvec.RATE * (1 - _i / VECTOR_STEPS)}::DOUBLE AS x FROM u{_i} u LEFT JOIN (SELECT a AS id, v.i, sum(g * v.x) / sum(n) AS x
 FROM g{_i} JOIN v{_i} v ON v.id = b GROUP BY a, v.i) d ON u.id = d.id AND u.i = d.i),
 v{_i + 1} AS MATERIALIZED (SELECT v.id, v.i, v.x + coalesce(d.x, 0) * {wordvec.RATE * (1 - _i / VECTOR_STEPS)}::DOUBLE AS x FROM v{_i} v LEFT JOIN (SELECT b AS id, u.i, sum(g * u.x) / sum(n) AS x
 FROM g{_i} JOIN u{_i} u ON u.id = a GROUP BY b, u.i) d ON v.id = d.id AND v.i = d.i)"""


@query("word2vec_steps", f"""{SKIPGRAM_SQL} SELECT term, i::INTEGER AS pos, round(x, 6) AS x FROM u{VECTOR_STEPS} u JOIN voc ON u.id = voc.id""")
def word2vec_steps(t: Tables):
    """Two updates of the vectors of all words that stand five times."""
    fitted = wordvec.fit_word_vectors(doc_words(t), WIDE, NEAR, DRAWN, LEAST, VECTOR_STEPS, shards=3)
    cells = fitted.table().select("term", F.posexplode("v").alias("pos", "x"))
    return cells.select("term", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))
