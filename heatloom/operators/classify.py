"""Classification: closed-form Naive Bayes, gradient descent, MLlib models, metrics and sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.vectors import argmax
from heatloom.operators.weights import idf
from heatloom.session import checkpoint_root

# Iterations, depth, smoothing and the parameters tried in the sweeps.
ITERATIONS, MAX_DEPTH, NEWS_SMOOTHING = 10, 5, 0.1
ITERATION_GRID = [1, 5, 10, 50]
STEP_GRID = [0.001, 0.01, 0.1, 1.0, 10.0]
L2_GRID = [0.001, 0.01, 0.1, 1.0, 10.0]
DEPTH_GRID = [1, 2, 3, 4, 5, 10, 20]
SMOOTHING_GRID = [0.001, 0.01, 0.1, 1.0, 10.0]
HOLDOUT_L2_GRID = [0.0, 0.001, 0.0025, 0.005, 0.01]


# --- metrics on predicted labels ---------------------------------------------------------------

def _counts(rows: DataFrame) -> DataFrame:
    hit, yes = F.col("label") == 1, F.col("prediction") == 1
    return rows.groupBy("model").agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(~hit & yes).alias("fp"),
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))


def hard_label_areas(rows: DataFrame) -> DataFrame:
    """Area under the PR and ROC curves of 0/1 predictions: ``(model, pr, roc)``.

    ``rows`` is ``(model, label, prediction)``. The curve of a 0/1 prediction has one inner
    point, so both areas are closed forms of the confusion counts, and one pass serves all models.
    """
    recall = F.try_divide("tp", "pos")
    base = F.col("pos") / (F.col("pos") + F.col("neg"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), base)  # no positive prediction: the base rate
    pr = recall * precision + (1 - recall) * (precision + base) / 2
    roc = (recall + 1 - F.try_divide("fp", "neg")) / 2
    return _counts(rows).select("model", pr.alias("pr"), roc.alias("roc"))


def hard_label_scores(rows: DataFrame) -> DataFrame:
    """The areas and the accuracy in long form ``(model, metric, value)``."""
    areas = hard_label_areas(rows)
    correct = rows.groupBy("model").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("value"))
    long = areas.unpivot("model", ["pr", "roc"], "metric", "value")
    return long.unionByName(correct.select("model", F.lit("accuracy").alias("metric"), "value"))


def weighted_f1(rows: DataFrame) -> DataFrame:
    """Class F1 weighted by class share, from the confusion counts of ``(label, prediction)``."""
    cells = rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("label") == F.col("prediction")
    actual = cells.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    guessed = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("guessed"))
    per_class = actual.join(guessed, "label", "left").na.fill(0, ["guessed"])
    f1 = 2.0 * F.col("tp") / (F.col("n") + F.col("guessed"))
    return per_class.agg((F.sum(F.col("n") * f1) / F.sum("n")).alias("weighted_f1"), F.sum("n").alias("cnt"))


# --- Naive Bayes over terms --------------------------------------------------------------------

@dataclass
class TermBayes:
    """Multinomial Naive Bayes. ``weights`` has one row per term: the weight of one occurrence (``unit``) and ``gains``,
    for each label that has the term the position of the label and ``ln(w + s) - ln(s)``."""

    labels: list
    log_prior: list[float]
    log_total: list[float]
    weights: DataFrame
    smoothing: float

    def predict(self, docs: DataFrame, terms: DataFrame) -> DataFrame:
        """Most likely label of each document of ``terms (doc_id, term, tf)``, with the ``scores`` of all labels.

        Terms unknown to the model do not count.
        """
        known = terms.join(self.weights, "term").select("doc_id", (F.col("tf") * F.col("unit")).alias("x"), "gains")
        mass = known.groupBy("doc_id").agg(F.sum("x").alias("mass"))
        parts = known.select("doc_id", "x", F.inline("gains")).groupBy("doc_id", "label").agg(F.sum(F.col("x") * F.col("gain")).alias("gain"))
        parts = parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "gain"))).alias("gain"))
        joined = docs.join(mass, "doc_id", "left").join(parts, "doc_id", "left")
        base = F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(math.log(self.smoothing) - t).alias("none"))
                         for p, t in zip(self.log_prior, self.log_total)])
        score = F.transform(base, lambda x, i: x.prior + F.coalesce("mass", F.lit(0.0)) * x.none + F.coalesce(
            F.try_element_at("gain", i), F.lit(0.0)))
        joined = joined.withColumn("scores", score).drop("mass", "gain")
        labels = F.array(*[F.lit(label) for label in self.labels])
        return joined.withColumn("prediction", F.element_at(labels, argmax(F.col("scores")) + 1))


def fit_term_bayes(docs: DataFrame, terms: DataFrame, smoothing: float = 1.0, use_idf: bool = False,
                   min_count: int = 1) -> TermBayes:
    """Fit on ``docs (doc_id, label)`` and ``terms (doc_id, label, term, tf)``.

    ``theta = ln((w_ct + s) / (w_c + s * V))``, ``prior = ln((N_c + s) / (N + s * K))``. Counts are grouped by term and
    label and then by term, so there is no column per label. Labels and totals are model parameters and reach the
    driver; the term table stays distributed.
    """
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    labels = [row["label"] for row in sizes]
    n, k = sum(row["n"] for row in sizes), len(labels)
    cells = terms.groupBy("term", "label").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    stats = cells.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"), F.collect_list(F.struct("label", "tf")).alias("cells"))
    unit = idf(n, "df") if use_idf else F.lit(1.0)
    checkpoint_root(docs.sparkSession)
    stats = stats.filter(F.col("total") >= min_count).select("term", unit.alias("unit"), "cells")
    place = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, i)])
    gains = F.transform("cells", lambda c: F.struct(
        F.element_at(place, c.label).alias("label"), (c.tf * F.col("unit")).alias("w"),
        (F.log(c.tf * F.col("unit") + smoothing) - math.log(smoothing)).alias("gain")))
    weights = stats.select("term", "unit", gains.alias("gains")).checkpoint()
    size = weights.count()
    sums = {r["label"]: r["w"] for r in weights.select(F.inline("gains")).groupBy("label").agg(F.sum("w").alias("w")).collect()}
    log_prior = [math.log((row["n"] + smoothing) / (n + smoothing * k)) for row in sizes]
    log_total = [math.log(sums.get(i, 0.0) + smoothing * size) for i in range(k)]
    return TermBayes(labels, log_prior, log_total, weights, smoothing)


# --- numeric features --------------------------------------------------------------------------

def assemble(df: DataFrame, numbers: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=numbers, outputCol=output).transform(df)


def standardize(df: DataFrame, column: str = "features", output: str = "scaled") -> DataFrame:
    """Zero mean and unit sample variance in every position."""
    scaler = StandardScaler(inputCol=column, outputCol=output, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)


def one_hot(df: DataFrame, category: str, output: str = "encoded") -> DataFrame:
    """Add the index of a category in alphabetical order and its 1-of-k vector."""
    indexer = StringIndexer(inputCol=category, outputCol="category_index", stringOrderType="alphabetAsc")
    indexed = indexer.fit(df).transform(df)
    return OneHotEncoder(inputCol="category_index", outputCol=output, dropLast=False).fit(indexed).transform(indexed)


def hash_split(df: DataFrame, key: str, share: float = 0.6, seed: int = 123) -> DataFrame:
    """Add ``split`` (train or test) from the key alone, so that a rerun splits the same way.

    Fixed values: multiplier and modulus of the mixing step.
    """
    mixed = F.pmod((F.pmod(F.col(key), F.lit(1_000_003)) + seed) * 2_654_435_761, F.lit(4_294_967_296))
    return df.withColumn("split", F.when(mixed < int(share * 4_294_967_296), "train").otherwise("test"))


# --- gradient descent --------------------------------------------------------------------------

def _margin(weights: list[float], features: str) -> Column:
    products = F.zip_with(features, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def descend_logistic(rows: DataFrame, iterations: int = ITERATIONS, step: float = 1.0,
                     l2: float = 0.0, tolerance: float = 0.001) -> list[float]:
    """Weights of a logistic model without intercept, by full-batch gradient descent.

    ``rows`` is ``(features array<double>, label)``; step ``i`` has length ``step / sqrt(i)``.
    Each iteration is one aggregation over the rows and returns one number per feature.
    """
    size = rows.select(F.size("features")).first()[0]
    weights = [0.0] * size
    for i in range(1, iterations + 1):
        residual = 1 / (1 + F.exp(-_margin(weights, "features"))) - F.col("label")
        part = F.transform("features", lambda x: x * F.col("r"))
        gradient = (
            rows.withColumn("r", residual).select(array_to_vector(part).alias("g"))
            .select(Summarizer.mean(F.col("g")).alias("g")).first()["g"]
        )
        length = step / math.sqrt(i)
        new = [w * (1 - length * l2) - length * float(g) for w, g in zip(weights, gradient)]
        moved = math.dist(new, weights)
        weights = new
        if moved < tolerance * max(math.hypot(*new), 1.0):
            break
    return weights


def predict_logistic(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Add the score and the 0/1 prediction at threshold 0.5."""
    scored = rows.withColumn("score", 1 / (1 + F.exp(-_margin(weights, "features"))))
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


# --- models and sweeps -------------------------------------------------------------------------

def standard_models() -> dict:
    """The models compared on one data set."""
    return {
        "logistic_regression": LogisticRegression(maxIter=ITERATIONS),
        "linear_svm": LinearSVC(maxIter=ITERATIONS),
        "naive_bayes": NaiveBayes(featuresCol="nonnegative"),
        "decision_tree": DecisionTreeClassifier(impurity="entropy", maxDepth=MAX_DEPTH),
    }


def predictions(models: dict, train: DataFrame, test: DataFrame) -> DataFrame:
    """``(model, label, prediction)`` of every model on ``test``."""
    parts = [
        model.fit(train).transform(test).select(
            F.lit(name).alias("model"), F.col("label").cast("int"), F.col("prediction").cast("int"))
        for name, model in models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# A fit gives a function that adds predictions to a table.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def estimator_fit(estimator) -> Fit:
    return lambda train: estimator.fit(train).transform


def descent_fit(**params) -> Fit:
    def as_array(df):
        return df.select(vector_to_array("features").alias("features"), "label")

    def fit(train: DataFrame):
        model = descend_logistic(as_array(train), **params)
        return lambda rows: predict_logistic(as_array(rows), model)

    return fit


def sweep_grid() -> dict[str, Fit]:
    """The parameter studies: iterations, step size, L2, tree depth and smoothing."""
    grid: dict[str, Fit] = {}
    grid |= {f"iterations={n}": descent_fit(iterations=n) for n in ITERATION_GRID}
    grid |= {f"step={s}": descent_fit(step=s) for s in STEP_GRID}
    grid |= {f"l2={r}": descent_fit(l2=r) for r in L2_GRID}
    grid |= {f"depth={d}": estimator_fit(DecisionTreeClassifier(impurity="entropy", maxDepth=d)) for d in DEPTH_GRID}
    grid |= {f"smoothing={s}": estimator_fit(NaiveBayes(featuresCol="nonnegative", smoothing=s)) for s in SMOOTHING_GRID}
    return grid


def tune_parts(train: DataFrame, parts: dict[str, DataFrame], grid: dict[str, Fit]) -> DataFrame:
    """Areas of every parameter setting on every part: ``(part, model, pr, roc)``. Each setting is fitted once; the
    inputs are cached while the few result rows are computed."""
    spark = train.sparkSession
    train = train.persist()
    kept = {name: rows.persist() for name, rows in parts.items()}
    try:
        guesses = []
        for model, fit in grid.items():
            predict = fit(train)
            guesses += [predict(rows).select(F.concat_ws("|", F.lit(name), F.lit(model)).alias("model"), F.col("label").cast("int"),
                                             F.col("prediction").cast("int")) for name, rows in kept.items()]
        out = guesses[0]
        for more in guesses[1:]:
            out = out.unionByName(more)
        rows = [(*r["model"].split("|", 1), r["pr"], r["roc"]) for r in hard_label_areas(out).collect()]
    finally:
        for cached in (train, *kept.values()):
            cached.unpersist()
    return spark.createDataFrame(rows, "part string, model string, pr double, roc double")


def tune(train: DataFrame, test: DataFrame, grid: dict[str, Fit]) -> DataFrame:
    """Areas of every parameter setting: ``(model, pr, roc)``."""
    return tune_parts(train, {"test": test}, grid).drop("part")
