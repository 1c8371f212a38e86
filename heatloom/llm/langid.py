"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed byte n-grams separates the languages that
have the bit from those that do not: the weight of an n-gram is the log ratio of its frequencies on the two sides, the
margin of a text the mean weight of its n-grams. A text gets the language whose codeword loses least, each bit's
logistic loss weighted by how far the bit's classifier holds its two sides apart.

All training rows count. Counting is a grouped sum; the model that reaches the driver is a table of ``BUCKETS`` numbers
for each language, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.arrays import FOLD, U64, chunks, mix

BUCKETS = 1 << 16
SCALE = 6.0
AMBIGUOUS = 0.2  # a text whose two best languages are closer than this is flagged
UNKNOWN = "und"
_NONE = BUCKETS - 1  # the bucket of places at which no n-gram starts; it has no weight


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bucket of the pair, triple and quadruple of bytes at each place; A-Z count as a-z."""
    folded = FOLD[data].astype(np.uint32)
    out, value = [], folded
    for n in (2, 3, 4):
        value = value[:-1] | (folded[n - 1:] << np.uint32(8 * (n - 1))) if len(value) > 1 else value[:0]
        bucket = np.full(len(data), _NONE, np.int32)
        hashed = (value * np.uint32(0x9E3779B1) + np.uint32(n * 0x5EBCA6B)) >> np.uint32(16)
        bucket[:len(value)] = np.minimum(hashed, _NONE - 1)
        for back in range(1, n):
            at = offsets[1:] - back
            bucket[at[at >= offsets[:-1]]] = _NONE
        out.append(bucket)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language over one task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, _, data, offsets in chunks(batch.column(1)):
            sizes = np.diff(offsets)
            here = langs[lo:lo + len(sizes)]
            owners = {lang: np.repeat(np.array([x == lang for x in here]), sizes) for lang in set(here)}
            for bucket in features(data, offsets):
                for lang, own in owners.items():
                    counts = np.bincount(bucket[own], minlength=BUCKETS)
                    totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        counts[_NONE] = 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))],
                                         names=["lang", "bucket", "n"])


def codewords(n: int) -> np.ndarray:
    """Distinct +1/-1 rows for ``n`` languages, every column with both signs. Up to five languages the code is
    exhaustive (each split of the languages is a bit); beyond, balanced pseudo-random bits, 12 log2(n) of them."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1 if k == 0 or (bit >> (k - 1)) & 1 else -1 for bit in range(2 ** (n - 1) - 1)] for k in range(n)])
    bits = int(np.ceil(12 * np.log2(n)))
    order = np.argsort(mix(np.arange(n * bits, dtype=np.uint64) + U64(7)).reshape(bits, n), axis=1)
    code = np.full((n, bits), -1)
    for bit in range(bits):
        code[order[bit, :n // 2], bit] = 1
    return code


class Model:
    """Languages, codewords, n-gram weights of each bit and the weight of each bit's loss."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(langs) else counts
        bits = self.code.shape[1]
        self.weights = np.zeros((bits, BUCKETS), np.float32)
        self.force = np.ones(bits)
        for bit in range(bits):
            yes, no = rates[self.code[:, bit] > 0].mean(axis=0), rates[self.code[:, bit] < 0].mean(axis=0)
            weight = np.log(yes) - np.log(no)
            self.force[bit] = ((yes - no) * weight).sum()
            self.weights[bit] = weight
        self.weights[:, _NONE] = 0
        self.force /= max(self.force.sum(), 1e-12)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score (a softmax over losses) and whether the second is close; margins: texts x bits."""
        loss = np.zeros((len(margins), len(self.langs)))
        for k in range(len(self.langs)):
            loss[:, k] = (np.logaddexp(0, -SCALE * self.code[k] * margins) * self.force).sum(axis=1)
        odds = np.exp(-SCALE * (loss - loss.min(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        ranked = np.sort(odds, axis=1)
        close = ranked[:, -1] - ranked[:, -2] < AMBIGUOUS if len(self.langs) > 1 else np.zeros(len(odds), bool)
        return odds.argmax(axis=1), odds.max(axis=1), close


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a text and a language. The number of languages is the caller's bound: their
    n-gram tables (``BUCKETS`` numbers each) are what the driver gets."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    if len(langs):
        row = np.searchsorted(np.array(langs), np.array(table["lang"].to_pylist()))
        counts[row, table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sizes = np.diff(offsets)
                margins = np.zeros((len(sizes), len(model.weights)))
                some = np.flatnonzero(sizes > 0)
                for bucket in features(data, offsets) if len(some) else []:
                    for bit, weight in enumerate(model.weights):
                        margins[some, bit] += np.add.reduceat(weight[bucket], offsets[:-1][some])
                margins /= np.maximum(3 * sizes - 6, 1)[:, None]
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                known = np.array([t is not None and next((True for c in t if c.isalpha()), False) for t in texts], bool)
                if model.langs:
                    best, score, close = model.decode(margins)
                else:
                    best, score, close, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool), known & False
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                     pa.array(np.where(known, score, 0.0)), pa.array(close & known)], names=["id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, from the text alone.

    A null text and one without a letter are ``und`` with score 0; so is every text if nothing was learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(_predictor(shared), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` for all rows of a model from the rows that are not held out, with ``held_out``."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col))
