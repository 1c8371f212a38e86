"""Registered queries: topic models, clustering and classification."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from heatloom.functions.text import ws_words
from heatloom.operators import classify, clusters, curves, kmeans, terms, topics, tree, weights
from heatloom.operators.lda import em_scores
from heatloom.plans.feature_queries import NUMBERS_SQL, numbers
from heatloom.plans.fixtures import TF_SQL, TOKENS_SQL, doc_words, texts
from heatloom.plans.registry import Tables, query
from heatloom.plans.row_queries import CENTER_DIST_SQL, CENTERS_SQL, STOPWORDS_SQL, WEIGHTED_F1_SQL, vectors
from heatloom.session import checkpoint_root

# Iterations of the registered model fits.
EM_ITER = topics.MAX_ITER


def fitted_topics(t: Tables, optimizer: str = "em"):
    return topics.fit_topics(doc_words(t), max_iter=EM_ITER, optimizer=optimizer)


@query("lda_fit")
def lda_fit(t: Tables):
    fitted = fitted_topics(t)
    row = (fitted.model.k, fitted.terms_count, fitted.docs_count, *em_scores(fitted))
    return t.spark.createDataFrame(
        [row], "topics long, vocabulary long, docs long, log_likelihood double, log_prior double")


@query("lda_topic_terms")
def lda_topic_terms(t: Tables):
    return fitted_topics(t).terms(topics.TOPIC_TERMS)


@query("topic_intensity")
def topic_intensity(t: Tables):
    return fitted_topics(t).intensity()


def listed(distribution: str):
    return F.array_join(F.transform(distribution, lambda x: F.format_string("%.6f", x)), ",")


@query("lda_assign")
def lda_assign(t: Tables):
    placed = fitted_topics(t).assign()
    return placed.select("doc_id", "prediction", "p", listed("distribution").alias("distribution"))


@query("lda_online_terms")
def lda_online_terms(t: Tables):
    return fitted_topics(t, "online").terms(topics.TOPIC_TERMS)


@query("lda_sweep")
def lda_sweep(t: Tables):
    return topics.sweep_topics(doc_words(t))


STEP_K, STEP_UPDATES = 3, 3
# ``link`` has a row per document, term and topic; each update shares out the counts by the term's and the document's part.
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_START = "(({h} * (2 * k + 1) * 40503 + k * 12345) % 65537 + 1) / 65538.0::DOUBLE"
EM_SQL = f"""tf AS MATERIALIZED ({TF_SQL}), v AS (SELECT count(DISTINCT term) AS v FROM tf),
 link AS MATERIALIZED (SELECT doc_id, term, k, tf, {_HASH.format('term')} AS ht, {_HASH.format('doc_id::VARCHAR')} AS hd
 FROM tf, range(0, {STEP_K}) r(k)),
 f0 AS (SELECT doc_id, term, k, tf, {_START.format(h='ht')} * {_START.format(h='hd')} AS f FROM link)"""
for _i in range(1, STEP_UPDATES + 1):
    EM_SQL += f""", s{_i} AS MATERIALIZED (SELECT doc_id, term, k, tf, tf * f / sum(f) OVER (PARTITION BY doc_id, term) AS c FROM f{_i - 1}),
 w{_i} AS MATERIALIZED (SELECT term, k, sum(c) AS n FROM s{_i} GROUP BY term, k),
 d{_i} AS MATERIALIZED (SELECT doc_id, k, sum(c) AS n FROM s{_i} GROUP BY doc_id, k),
 k{_i} AS MATERIALIZED (SELECT k, sum(n) AS n FROM w{_i} GROUP BY k),
 f{_i} AS (SELECT s.doc_id, s.term, s.k, s.tf, (w.n + 0.1) / (t.n + v * 0.1) * (d.n + 50.0::DOUBLE / {STEP_K}) AS f FROM s{_i} s
 JOIN w{_i} w ON s.term = w.term AND s.k = w.k JOIN d{_i} d ON s.doc_id = d.doc_id AND s.k = d.k JOIN k{_i} t ON s.k = t.k, v)"""


@query("lda_em_steps", f"""WITH {EM_SQL} SELECT k::INTEGER AS topic, "rank"::INTEGER AS "rank", term, round(weight, 6) AS weight FROM (
 SELECT w.k, term, w.n / t.n AS weight, row_number() OVER (PARTITION BY w.k ORDER BY round(w.n / t.n, 9) DESC, term) AS "rank"
 FROM w{STEP_UPDATES} w JOIN k{STEP_UPDATES} t ON w.k = t.k) WHERE "rank" <= 50""")
def lda_em_steps(t: Tables):
    """Three updates of three topics: their fifty heaviest terms."""
    fitted = topics.fit_topics(doc_words(t), STEP_K, STEP_UPDATES)
    return fitted.terms(50).withColumn("weight", F.round("weight", 6))


@query("lda_em_assign_steps", f"""WITH {EM_SQL} SELECT doc_id, any_value(prediction)::INTEGER AS prediction, round(max(share), 6) AS p,
 round(min(share), 6) AS least FROM (SELECT doc_id, share, first_value(k) OVER (PARTITION BY doc_id ORDER BY share DESC, k) AS prediction
 FROM (SELECT doc_id, k, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM d{STEP_UPDATES})) GROUP BY doc_id""")
def lda_em_assign_steps(t: Tables):
    """Three updates of three topics: the likeliest topic of each document."""
    placed = topics.fit_topics(doc_words(t), STEP_K, STEP_UPDATES).assign()
    return placed.select("doc_id", "prediction", F.round("p", 6).alias("p"), F.round(F.array_min("distribution"), 6).alias("least"))


def fitted_sizes(t: Tables, fitted: kmeans.KMeansFit):
    rows = [(i, int(n), float(c)) for i, (n, c) in enumerate(zip(fitted.sizes, fitted.costs))]
    return t.spark.createDataFrame(rows, "prediction int, cnt long, wssse double")


@query("kmeans_fit")
def kmeans_fit(t: Tables):
    features = clusters.hashed_tfidf(doc_words(t)).select("doc_id", "features")
    return fitted_sizes(t, kmeans.fit_kmeans(features, clusters.K, clusters.MAX_ITER, id_col="doc_id"))


@query("bisecting_fit")
def bisecting_fit(t: Tables):
    features = clusters.hashed_tfidf(doc_words(t)).select("doc_id", "features")
    return fitted_sizes(t, kmeans.fit_bisecting(features, clusters.K, id_col="doc_id"))


# Vectors by position, and the vectors whose ids have the smallest digests as starting centres.
SEEDS, LLOYD_STEPS, LEAF_STEPS = 7, 4, 3
POSITIONS_SQL = """e AS MATERIALIZED (SELECT vec_id, i AS pos, embedding[i]::DOUBLE AS x FROM embeddings,
 unnest(range(1, len(embedding) + 1)) u(i))"""
LLOYD_SQL = f"""WITH {POSITIONS_SQL}, s AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS c
 FROM embeddings), c0 AS MATERIALIZED (SELECT c, pos, x FROM s JOIN e USING (vec_id) WHERE c < {SEEDS})"""
for _i in range(LLOYD_STEPS + 1):
    LLOYD_SQL += f""", a{_i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c,
 sum((e.x - k.x) * (e.x - k.x)) AS d FROM e JOIN c{_i} k ON e.pos = k.pos GROUP BY vec_id, c) GROUP BY vec_id),
 c{_i + 1} AS MATERIALIZED (SELECT k.c, k.pos, coalesce(m.x, k.x) AS x FROM c{_i} k LEFT JOIN (SELECT c, pos, avg(x) AS x
 FROM a{_i} JOIN e USING (vec_id) GROUP BY c, pos) m ON k.c = m.c AND k.pos = m.pos)"""


@query("kmeans_steps", f"""{LLOYD_SQL} SELECT vec_id, c::INTEGER AS prediction, round(d, 6) AS sq_dist FROM a{LLOYD_STEPS}""")
def kmeans_steps(t: Tables):
    """Four updates from given centres."""
    rows = vectors(t).select("vec_id", "v")
    first = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(SEEDS).collect()
    starts = np.array([r["v"] for r in first])
    fitted = kmeans.fit_all(kmeans.prepared(rows, "v", "vec_id"), {0: starts}, LLOYD_STEPS, tolerance=-1.0)[0]
    return kmeans.assign(rows, fitted, "v").select("vec_id", "prediction", F.round("sq_dist", 6).alias("sq_dist"))


# Both children of each leaf start at its mean minus and plus half its deviation; ``g`` is the path from the root.
BISECT_SQL = f"WITH {POSITIONS_SQL}, p0 AS (SELECT vec_id, '' AS g FROM embeddings)"
for _i in (1, 2):
    BISECT_SQL += f""", m{_i} AS MATERIALIZED (SELECT g, pos, avg(x) AS x, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS s
 FROM p{_i - 1} JOIN e USING (vec_id) GROUP BY g, pos), c{_i}_0 AS MATERIALIZED (SELECT g, b, pos, x + (b * 2 - 1) * 0.5 * s AS x
 FROM m{_i}, range(0, 2) r(b))"""
    for _j in range(LEAF_STEPS + 1):
        BISECT_SQL += f""", a{_i}_{_j} AS MATERIALIZED (SELECT vec_id, g, arg_min(b, (d, b)) AS b, min(d) AS d FROM (SELECT e.vec_id, p.g,
 k.b, sum((e.x - k.x) * (e.x - k.x)) AS d FROM p{_i - 1} p JOIN e ON p.vec_id = e.vec_id JOIN c{_i}_{_j} k ON k.g = p.g AND k.pos = e.pos
 GROUP BY e.vec_id, p.g, k.b) GROUP BY vec_id, g), c{_i}_{_j + 1} AS MATERIALIZED (SELECT k.g, k.b, k.pos, coalesce(m.x, k.x) AS x
 FROM c{_i}_{_j} k LEFT JOIN (SELECT g, b, pos, avg(x) AS x FROM a{_i}_{_j} JOIN e USING (vec_id) GROUP BY g, b, pos) m
 ON k.g = m.g AND k.b = m.b AND k.pos = m.pos)"""
    BISECT_SQL += f", p{_i} AS MATERIALIZED (SELECT vec_id, g || b::VARCHAR AS g, d FROM a{_i}_{LEAF_STEPS})"


@query("bisecting_steps", f"""{BISECT_SQL} SELECT vec_id, (dense_rank() OVER (ORDER BY g) - 1)::INTEGER AS prediction,
 round(d, 6) AS sq_dist FROM p2""")
def bisecting_steps(t: Tables):
    """Four leaves: two levels of the frontier, three updates each."""
    rows = vectors(t).select("vec_id", "v")
    fitted = kmeans.fit_bisecting(rows, 4, LEAF_STEPS, "v", "vec_id")
    return kmeans.assign(rows, fitted, "v").select("vec_id", "prediction", F.round("sq_dist", 6).alias("sq_dist"))


@query("kmeans_elbow")
def kmeans_elbow(t: Tables):
    return clusters.elbow(vectors(t).select(F.col("v").alias("features")))


@query("center_distance", f"SELECT vec_id, label, round(sq_dist, 6) AS sq_dist FROM ({CENTER_DIST_SQL})")
def center_distance(t: Tables):
    v = vectors(t)
    near = clusters.center_distance(v, clusters.group_means(v, "label", "v"), "label", "v")
    return near.select("vec_id", "label", F.round("sq_dist", 6).alias("sq_dist"))


NEAREST_SQL = f"""SELECT vec_id, arg_min(label, d) AS prediction, min(d) AS sq_dist FROM (
 SELECT e.vec_id, c.label, sum((e.x - c.c) * (e.x - c.c)) AS d FROM (SELECT vec_id, i AS pos, embedding[i]::DOUBLE AS x
 FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)) e JOIN ({CENTERS_SQL}) c ON e.pos = c.pos
 GROUP BY e.vec_id, c.label) GROUP BY vec_id"""


def assigned(t: Tables):
    v = vectors(t)
    return clusters.assign_nearest(v.select("vec_id", "v"), clusters.group_means(v, "label", "v"), "label", "v")


@query("kmeans_assign", f"SELECT vec_id, prediction, round(sq_dist, 6) AS sq_dist FROM ({NEAREST_SQL})")
def kmeans_assign(t: Tables):
    return assigned(t).select("vec_id", "prediction", F.round("sq_dist", 6).alias("sq_dist"))


@query("wssse_given_centers", f"SELECT round(sum(sq_dist), 6) AS wssse, count(*) AS cnt FROM ({NEAREST_SQL})")
def wssse_given_centers(t: Tables):
    return assigned(t).agg(F.round(F.sum("sq_dist"), 6).alias("wssse"), F.count(F.lit(1)).alias("cnt"))


# --- classification ----------------------------------------------------------------------------

SPLIT_SQL = "((doc_id % 1000003 + 123) * 2654435761) % 4294967296 < floor(0.6 * 4294967296)"
# ``train (doc_id, label, term, w)``, ``test (doc_id, term, w)`` and ``docs (doc_id, label, is_train)`` are given.
BAYES_SQL = """, cls AS (SELECT label, ln((count(*) + {s}) / ((SELECT count(*) FROM docs WHERE is_train) +
 {s} * (SELECT count(DISTINCT label) FROM docs WHERE is_train))) AS prior FROM docs WHERE is_train GROUP BY label),
 cell AS MATERIALIZED (SELECT label, term, sum(w) AS w FROM train GROUP BY label, term),
 voc AS MATERIALIZED (SELECT DISTINCT term FROM cell),
 tot AS (SELECT label, ln(sum(w) + {s} * (SELECT count(*) FROM voc)) AS total FROM cell GROUP BY label),
 score AS MATERIALIZED (SELECT d.doc_id, d.label AS truth, c.label, any_value(c.prior) + coalesce(sum(x.w * (
 ln(coalesce(cell.w, 0) + {s}) - tot.total)), 0) AS score FROM docs d JOIN cls c ON NOT d.is_train JOIN tot ON tot.label = c.label
 LEFT JOIN (SELECT * FROM test WHERE term IN (SELECT term FROM voc)) x ON x.doc_id = d.doc_id
 LEFT JOIN cell ON cell.label = c.label AND cell.term = x.term GROUP BY d.doc_id, d.label, c.label),
 guess AS (SELECT doc_id, any_value(truth) AS label, arg_max(label, score) AS prediction, max(score) AS score
 FROM score GROUP BY doc_id)"""


def split_docs(t: Tables):
    """News by language: ``(doc_id, label, text, split)``."""
    docs = texts(t, "lang").withColumnRenamed("lang", "label")
    return classify.hash_split(docs, "doc_id")


@query("naive_bayes", f"""WITH docs AS (SELECT doc_id, lang AS label, {SPLIT_SQL} AS is_train FROM documents),
 tf AS MATERIALIZED (SELECT doc_id, term, count(*)::DOUBLE AS w FROM ({TOKENS_SQL}) GROUP BY doc_id, term),
 train AS (SELECT tf.doc_id, label, term, w FROM tf JOIN docs USING (doc_id) WHERE is_train),
 test AS (SELECT tf.doc_id, term, w FROM tf JOIN docs USING (doc_id) WHERE NOT is_train)
 {BAYES_SQL.format(s='1.0::DOUBLE')} SELECT doc_id, label, prediction, round(score, 4) AS score FROM guess""")
def naive_bayes(t: Tables):
    docs = split_docs(t).withColumn("words", ws_words(F.col("text")))
    train, test = (docs.filter(F.col("split") == part) for part in ("train", "test"))
    model = classify.fit_term_bayes(train, weights.term_frequency(train, ["doc_id", "label"]))
    guess = model.predict(test.select("doc_id", "label"), weights.term_frequency(test))
    return guess.select("doc_id", "label", "prediction", F.round(F.array_max("scores"), 4).alias("score"))


@query("news_nb", rf"""WITH docs AS (SELECT doc_id, lang AS label, text, {SPLIT_SQL} AS is_train FROM documents),
 tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, lower(unnest(string_split_regex(text, '\W+')))
 AS term FROM documents) WHERE NOT regexp_matches(term, '[0-9]') AND length(term) >= 2 AND term NOT IN ({STOPWORDS_SQL})
 GROUP BY doc_id, term),
 stats AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM docs WHERE is_train) + 1) / (count(*) + 1.0::DOUBLE)) AS idf
 FROM tf JOIN docs USING (doc_id) WHERE is_train GROUP BY term HAVING sum(tf) >= 2),
 train AS (SELECT doc_id, label, term, tf * idf AS w FROM tf JOIN docs USING (doc_id) JOIN stats USING (term) WHERE is_train),
 test AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN docs USING (doc_id) JOIN stats USING (term) WHERE NOT is_train)
 {BAYES_SQL.format(s='0.1::DOUBLE')}, acc AS (SELECT round(avg((label = prediction)::INT), 6) AS accuracy,
 count(*) AS cnt FROM guess) SELECT accuracy, cnt, weighted_f1 FROM acc, ({WEIGHTED_F1_SQL})""")
def news_nb(t: Tables):
    guess = news_guess(split_docs(t)).select("label", "prediction")
    correct = (F.col("label") == F.col("prediction")).cast("int")
    cells = classify.weighted_f1(guess)
    accuracy = guess.agg(F.round(F.avg(correct), 6).alias("accuracy"), F.count(F.lit(1)).alias("cnt"))
    return accuracy.join(cells.withColumn("weighted_f1", F.round("weighted_f1", 6)), "cnt")


def news_guess(docs):
    """Clean terms, TF-IDF fitted on the training part, Naive Bayes, labels of the test part."""
    train, test = (docs.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    train_tf, test_tf = terms.news_terms(train, ["doc_id", "label"]), terms.news_terms(test)
    model = classify.fit_term_bayes(train, train_tf, classify.NEWS_SMOOTHING, use_idf=True, min_count=2)
    return model.predict(test.select("doc_id", "label"), test_tf)


def labelled_features(t: Tables):
    """Category 1-of-k and two numbers: ``features`` standardised, ``nonnegative`` as they are."""
    encoded = classify.one_hot(numbers(t), "lang")
    raw = classify.assemble(encoded, ["encoded", "n_chars", "n_words"], "nonnegative")
    return classify.standardize(raw, "nonnegative", "features").select("doc_id", "label", "features", "nonnegative")


STEPS = classify.ITERATIONS
GD_SQL = f"""WITH x AS ({NUMBERS_SQL}), z AS MATERIALIZED (SELECT doc_id, label,
 (n_chars - (SELECT avg(n_chars) FROM x)) / (SELECT stddev_samp(n_chars) FROM x) AS a,
 (n_words - (SELECT avg(n_words) FROM x)) / (SELECT stddev_samp(n_words) FROM x) AS b FROM x),
 w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb)"""
for _i in range(1, STEPS + 1):
    GD_SQL += f""", w{_i} AS MATERIALIZED (SELECT any_value(wa) - avg(r * a) / sqrt({_i}) AS wa, any_value(wb) - avg(r * b) / sqrt({_i}) AS wb
 FROM (SELECT a, b, wa, wb, 1 / (1 + exp(-(wa * a + wb * b))) - label AS r FROM z, w{_i - 1}))"""


@query("logreg_gd_steps", f"""{GD_SQL} SELECT doc_id, label, round(1 / (1 + exp(-(wa * a + wb * b))), 6) AS score
 FROM z, w{STEPS}""")
def logreg_gd_steps(t: Tables):
    scaled = classify.standardize(classify.assemble(numbers(t), ["n_chars", "n_words"]))
    rows = scaled.select("doc_id", "label", vector_to_array("scaled").alias("features"))
    model = classify.descend_logistic(rows, STEPS, tolerance=0.0)
    return classify.predict_logistic(rows, model).select("doc_id", "label", F.round("score", 6).alias("score"))


def predicted(t: Tables, name: str):
    rows = labelled_features(t)
    fitted = classify.standard_models()[name].fit(rows)
    return fitted.transform(rows)


@query("logreg")
def logreg(t: Tables):
    return predicted(t, "logistic_regression").select("doc_id", "label", "prediction", vector_to_array("probability")[1].alias("p"))


@query("linear_svm")
def linear_svm(t: Tables):
    return predicted(t, "linear_svm").select("doc_id", "label", "prediction")


@query("decision_tree")
def decision_tree(t: Tables):
    return predicted(t, "decision_tree").select("doc_id", "label", "prediction")


# Each level divides its open nodes by the largest fall of entropy over 32 even bins of each feature.
TREE_BINS = tree.BINS
ENTROPY_SQL = "CASE WHEN {p} = 0 OR {p} = {n} THEN 0.0::DOUBLE ELSE -({p} / {n}::DOUBLE * log2({p} / {n}::DOUBLE) + (1 - {p} / {n}::DOUBLE) * log2(1 - {p} / {n}::DOUBLE)) END"
TREE_SQL = f"""WITH x AS MATERIALIZED ({NUMBERS_SQL}), long AS MATERIALIZED (SELECT doc_id, label, 0 AS feature, n_chars AS v FROM x UNION ALL
 SELECT doc_id, label, 1, n_words FROM x UNION ALL SELECT doc_id, label, 2, n_chars / (n_words + 1) FROM x),
 ends AS (SELECT feature, min(v) AS a, max(v) AS b FROM long GROUP BY feature),
 edge AS MATERIALIZED (SELECT feature, j - 1 AS bin, a + (b - a) * j / {TREE_BINS} AS e FROM ends, range(1, {TREE_BINS}) r(j) WHERE b > a),
 bins AS MATERIALIZED (SELECT doc_id, any_value(label) AS label, l.feature, count(*) FILTER (e < v) AS bin FROM long l
 LEFT JOIN edge ON l.feature = edge.feature GROUP BY doc_id, l.feature), at0 AS (SELECT doc_id, 1 AS node FROM x)"""
for _i in range(tree.MAX_DEPTH):
    TREE_SQL += f""", h{_i} AS (SELECT node, feature, bin, count(*) AS c, sum(label) AS s FROM at{_i} JOIN bins USING (doc_id) GROUP BY node, feature, bin),
 w{_i} AS (SELECT node, feature, bin, sum(c) OVER up AS ln, sum(s) OVER up AS lp, sum(c) OVER (PARTITION BY node, feature) AS n,
 sum(s) OVER (PARTITION BY node, feature) AS pos FROM h{_i} WINDOW up AS (PARTITION BY node, feature ORDER BY bin)),
 g{_i} AS (SELECT *, round({ENTROPY_SQL.format(p='pos', n='n')} - ln / n::DOUBLE * {ENTROPY_SQL.format(p='lp', n='ln')}
 - (n - ln) / n::DOUBLE * {ENTROPY_SQL.format(p='(pos - lp)', n='(n - ln)')}, 9) AS gain FROM w{_i} WHERE ln < n),
 s{_i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS r FROM g{_i} WHERE gain > 0) WHERE r = 1),
 at{_i + 1} AS MATERIALIZED (SELECT o.doc_id, o.node * 2 + (b.bin > s.bin)::INT AS node FROM at{_i} o JOIN s{_i} s ON o.node = s.node
 JOIN bins b ON b.doc_id = o.doc_id AND b.feature = s.feature)"""
_INNER_SQL = " UNION ALL ".join(f"SELECT node, n, pos, feature, bin FROM s{_i}" for _i in range(tree.MAX_DEPTH))
_SEEN_SQL = " UNION ALL ".join(f"SELECT doc_id, node, {_i} AS level FROM at{_i}" for _i in range(tree.MAX_DEPTH + 1))


def measured(t: Tables):
    """Three numbers of each labelled page as ``features``; the texts are read once for all passes over them."""
    ratio = F.col("n_chars") / (F.col("n_words") + 1)
    checkpoint_root(t.spark)
    return numbers(t).select("doc_id", "label", F.array("n_chars", "n_words", ratio).alias("features")).checkpoint()


def grown(rows):
    return tree.fit_tree(rows, tree.even_edges(rows))


@query("tree_splits", f"""{TREE_SQL} SELECT i.node::BIGINT AS node, n::BIGINT AS n, pos::BIGINT AS pos, i.feature::INTEGER AS feature,
 round(e, 6) AS threshold FROM ({_INNER_SQL}) i JOIN edge ON edge.feature = i.feature AND edge.bin = i.bin""")
def tree_splits(t: Tables):
    """The inner nodes of a tree of depth 5."""
    nodes = grown(measured(t)).table(t.spark).filter("feature IS NOT NULL")
    return nodes.select("node", "n", "pos", "feature", F.round("threshold", 6).alias("threshold"))


@query("tree_predictions", f"""{TREE_SQL}, leaf AS (SELECT doc_id, arg_max(node, level) AS node FROM ({_SEEN_SQL}) GROUP BY doc_id)
 SELECT doc_id, label, node::BIGINT AS node, round(avg(label) OVER (PARTITION BY node), 6) AS p,
 (sum(label) OVER (PARTITION BY node) * 2 > count(*) OVER (PARTITION BY node))::INTEGER AS prediction FROM leaf JOIN x USING (doc_id)""")
def tree_predictions(t: Tables):
    rows = measured(t)
    return grown(rows).predict(rows).select("doc_id", "label", "node", F.round("p", 6).alias("p"), "prediction")


# Two scorers of the same rows: the descended model and the plain number of characters.
SCORED_SQL = f"""scored AS MATERIALIZED (SELECT 'descent' AS model, label, round(1 / (1 + exp(-(wa * a + wb * b))), 9) AS score
 FROM z, w{STEPS} UNION ALL SELECT 'n_chars', label, n_chars FROM x),
 ties AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY model, score),
 curve AS MATERIALIZED (SELECT *, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER (PARTITION BY model) AS p,
 sum(neg) OVER (PARTITION BY model) AS n FROM ties WINDOW up AS (PARTITION BY model ORDER BY score DESC))"""


def scored(t: Tables):
    given = numbers(t)
    scaled = classify.standardize(classify.assemble(given, ["n_chars", "n_words"]))
    rows = scaled.select("label", "n_chars", vector_to_array("scaled").alias("features"))
    model = classify.descend_logistic(rows, STEPS, tolerance=0.0)
    guess = classify.predict_logistic(rows, model).select(F.lit("descent").alias("model"), "label", F.round("score", 9).alias("score"))
    return guess.unionByName(rows.select(F.lit("n_chars").alias("model"), "label", F.col("n_chars").alias("score")))


@query("auc_scored", f"""{GD_SQL}, {SCORED_SQL}, areas AS (SELECT model, sum(pos * (tp / (tp + fp)::DOUBLE + CASE WHEN tp + fp = pos + neg
 THEN tp / (tp + fp)::DOUBLE ELSE (tp - pos) / (tp - pos + fp - neg)::DOUBLE END) / 2) / max(p) AS pr,
 sum(neg * (2 * tp - pos) / 2.0::DOUBLE) / (max(p) * max(n)) AS roc FROM curve GROUP BY model)
 SELECT model, 'pr' AS metric, round(pr, 6) AS "value" FROM areas UNION ALL SELECT model, 'roc', round(roc, 6) FROM areas""")
def auc_scored(t: Tables):
    areas = curves.scored_areas(scored(t)).unpivot("model", ["pr", "roc"], "metric", "value")
    return areas.select("model", "metric", F.round("value", 6).alias("value"))


@query("score_curve", f"""{GD_SQL}, {SCORED_SQL} SELECT model, round(score, 6) AS score, round(tp / p::DOUBLE, 6) AS recall,
 round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(fp / n::DOUBLE, 6) AS fpr FROM curve""")
def score_curve(t: Tables):
    points = curves.curve_points(curves.score_curve(scored(t)))
    return points.select("model", *[F.round(c, 6).alias(c) for c in ("score", "recall", "precision", "fpr")])


@query("model_metrics")
def model_metrics(t: Tables):
    rows = labelled_features(t)
    return classify.hard_label_scores(classify.predictions(classify.standard_models(), rows, rows))


@query("tuning_sweep")
def tuning_sweep(t: Tables):
    rows = labelled_features(t)
    return classify.tune(rows, rows, classify.sweep_grid())


@query("holdout_sweep")
def holdout_sweep(t: Tables):
    rows = classify.hash_split(labelled_features(t), "doc_id")
    train, test = (rows.filter(F.col("split") == part) for part in ("train", "test"))
    grid = {f"l2={r}": classify.descent_fit(l2=r) for r in classify.HOLDOUT_L2_GRID}
    return classify.tune_parts(train, {"test": test, "train": train}, grid)
