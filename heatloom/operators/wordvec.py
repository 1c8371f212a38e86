"""Skip-gram word vectors with negative samples, without a vocabulary on the driver or in one task.

Word pairs are counted once. An update is a full step over all counted pairs: terms are dealt over shards, pairs over the cells
(shard of the word, shard of the other word), and each cell is sent the vectors it uses and no others. Gradients are added
up by term. Only counts reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.operators.order import running_total
from heatloom.session import checkpoint_root

SIZE, WINDOW, NEGATIVES, MIN_COUNT, UPDATES, RATE = 100, 5, 5, 5, 40, 3.0
# Pairs and terms meant for one cell and one shard, and entries of a shard's vectors.
CELL_PAIRS, SHARD_TERMS, SHARD_VALUES = 500_000, 50_000, 2_000_000
# Entries of one array while slots are laid out, and pairs whose vectors are laid out at once.
_CHUNK, _STEP = 65_536, 16_384
_INNER, _OUTER = 0, 1


@dataclass
class WordVectors:
    """``terms`` (term, id, n, w) and ``vectors`` (side, id, v): side 0 holds a word's own vector, side 1 the one it has as a
    neighbour of others."""

    terms: DataFrame
    vectors: DataFrame
    pairs: int
    shards: int

    def table(self) -> DataFrame:
        """``(term, v)``."""
        return self.vectors.filter(F.col("side") == _INNER).join(self.terms, "id").select("term", "v")


def _digest(name: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(name), 1, digits), 16, 10).cast("long")


def term_slots(words: DataFrame, min_count: int) -> DataFrame:
    """``(term, n, w, id)``: terms standing ``min_count`` times or more own the ``w = round(n^0.75)`` slots from ``id`` on."""
    counted = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.filter((F.col("n") >= min_count) & F.col("term").isNotNull())
    kept = kept.withColumn("w", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(0.75)))).cast("long"))
    return running_total(kept, [F.col("term")], "w", "id")


def count_pairs(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """``(a, b, n)``: how often term ``b`` stands at most ``window`` words from term ``a``, in either direction, by term ids."""
    size = F.size("words")
    near = docs.select("words", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).filter(size > F.col("d"))
    both = F.zip_with(F.slice("words", F.lit(1), size - F.col("d")), F.slice("words", F.col("d") + 1, size - F.col("d")),
                      lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    seen = near.select(F.inline(both)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    for name, key in (("x", "a"), ("y", "b")):
        seen = seen.join(terms.select(F.col("term").alias(name), F.col("id").alias(key)), name).drop(name)
    turned = seen.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return seen.select("a", "b", "n").unionByName(turned).groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_negatives(pairs: DataFrame, terms: DataFrame, slots: int, negatives: int) -> DataFrame:
    """``(a, b, label, n)``: the pairs, and for each ``negatives`` other terms drawn by a hash of the pair over the slots.

    A drawn term equal to ``b`` is left out. A term with very many slots is laid out in pieces.
    """
    laid = terms.select("id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(w - 1) div {_CHUNK}"))).alias("c"))
    first = F.col("id") + F.col("c") * _CHUNK
    laid = laid.select(F.col("id").alias("other"), F.explode(F.sequence(
        first, F.least(F.col("id") + F.col("w"), first + _CHUNK) - 1)).alias("slot"))
    out = pairs.select("a", "b", F.lit(1).alias("label"), "n")
    if negatives:
        drawn = pairs.select("a", "b", "n", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("j"))
        drawn = drawn.withColumn("slot", F.pmod(_digest(F.concat_ws(":", "a", "b", "j"), 15), F.lit(slots)))
        found = drawn.join(laid, "slot").filter(F.col("other") != F.col("b"))
        out = out.unionByName(found.select("a", F.col("other").alias("b"), F.lit(0).alias("label"), "n"))
    return out.groupBy("a", "b", "label").agg(F.sum("n").alias("n"))


def _cell_gradients(_key, pairs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    if not len(pairs):
        return pd.DataFrame({"side": [], "id": [], "gradient": [], "n": []}).astype({"side": "int32", "id": "int64"})
    ids, vectors = {}, {}
    for side in (_INNER, _OUTER):
        part = sent[sent["side"] == side].sort_values("id")
        ids[side], vectors[side] = part["id"].to_numpy(), np.stack(part["v"].to_numpy())
    where = {_INNER: np.searchsorted(ids[_INNER], pairs["a"].to_numpy()), _OUTER: np.searchsorted(ids[_OUTER], pairs["b"].to_numpy())}
    n, label = pairs["n"].to_numpy().astype(float), pairs["label"].to_numpy()
    gradient = {s: np.zeros(v.shape) for s, v in vectors.items()}
    for at in range(0, len(pairs), _STEP):
        cut = slice(at, at + _STEP)
        u, v = vectors[_INNER][where[_INNER][cut]], vectors[_OUTER][where[_OUTER][cut]]
        with np.errstate(over="ignore"):
            chance = 1 / (1 + np.exp(-(u * v).sum(axis=1)))
        pull = (n[cut] * (label[cut] - chance))[:, None]
        np.add.at(gradient[_INNER], where[_INNER][cut], pull * v)
        np.add.at(gradient[_OUTER], where[_OUTER][cut], pull * u)
    parts = [pd.DataFrame({"side": np.full(len(ids[s]), s, np.int32), "id": ids[s], "gradient": list(gradient[s]),
                           "n": np.bincount(where[s], n, len(ids[s]))}) for s in (_INNER, _OUTER)]
    return pd.concat(parts)


def fit_word_vectors(docs: DataFrame, size: int = SIZE, window: int = WINDOW, negatives: int = NEGATIVES, min_count: int = MIN_COUNT,
                     updates: int = UPDATES, rate: float = RATE, shards: int = 1) -> WordVectors:
    """Fit on ``words`` of ``docs``.

    A word's own vector starts at hashes of the term, its neighbour vector at zero, so a fit is the same on any cluster. An
    update moves every vector by its mean gradient over its pairs, ``rate`` times that at first and less by equal steps. Null words are removed before windows are
    taken; rows without words and repeated rows need no care (a repeated row counts again). Without any term that stands
    ``min_count`` times the tables are empty. ``shards`` is the least number of shards; more are taken as pairs and terms need
    them, so that a cell stays of bounded size.
    """
    checkpoint_root(docs.sparkSession)
    words = docs.select(F.filter("words", lambda w: w.isNotNull()).alias("words"))
    terms = term_slots(words, min_count).checkpoint()
    total = terms.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    examples = with_negatives(count_pairs(words, terms, window), terms, total["w"] or 1, negatives).checkpoint()
    count = examples.count()
    shard_terms = max(1, min(SHARD_TERMS, SHARD_VALUES // size))
    shards = max(shards, math.ceil(math.sqrt(count / CELL_PAIRS)), math.ceil(total["n"] / shard_terms))

    def shard(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(shards))

    examples = examples.withColumn("cell", shard("a") * shards + shard("b")).repartition("cell").checkpoint()
    needs = examples.select(F.col("cell").alias("place"), F.lit(_INNER).alias("side"), F.col("a").alias("id")).unionByName(
        examples.select(F.col("cell").alias("place"), F.lit(_OUTER).alias("side"), F.col("b").alias("id"))).distinct().checkpoint()
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (
        _digest(F.concat_ws(":", "term", i), 8) / float(1 << 32) - 0.5) / size)
    zero = F.array_repeat(F.lit(0.0), size)
    vectors = terms.select(F.lit(_INNER).alias("side"), "id", start.alias("v")).unionByName(
        terms.select(F.lit(_OUTER).alias("side"), "id", zero.alias("v"))).checkpoint()
    for i in range(updates):
        length = rate * (1 - i / updates)
        sent = needs.join(vectors, ["side", "id"])
        parts = examples.groupBy("cell").cogroup(sent.groupBy("place")).applyInPandas(
            _cell_gradients, "side int, id long, gradient array<double>, n double")
        moves = parts.groupBy("side", "id").agg(Summarizer.sum(array_to_vector("gradient")).alias("g"), F.sum("n").alias("n"))
        moves = moves.select("side", "id", vector_to_array("g").alias("g"), "n")
        moved = F.zip_with("v", "g", lambda v, g: v + g * length / F.col("n"))
        vectors = vectors.join(moves, ["side", "id"], "left").select("side", "id", F.coalesce(moved, "v").alias("v")).checkpoint()
    return WordVectors(terms, vectors, count, shards)
