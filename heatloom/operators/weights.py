"""Term frequencies, TF-IDF weights and what is read from them.

Weights are kept in long form, one row per document and term, so no vocabulary has to fit on one
machine and every index leads back to its word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatloom.functions.unnest import unnest, unnest_structs
from heatloom.operators.counts import count_by, counted, counts_in_row, top_by_group
from heatloom.operators.order import zip_index
from heatloom.session import scratch_path

SCORE_DIGITS = 9
# Words whose different terms are looked up together.
BLOCK_WORDS = 2_000_000
# Pairs of documents compared at once.
PAIRS_AT_ONCE = 256
PART = T.StructType([T.StructField(c, T.BinaryType()) for c in ("names", "sizes", "w")])


def idf(n_docs, df) -> Column:
    """``ln((m + 1) / (df + 1))``."""
    return F.log((F.lit(n_docs) + 1) / (F.col(df) + F.lit(1.0)))


def term_frequency(docs: DataFrame, keep: list[str] = ("doc_id",), words: str = "words") -> DataFrame:
    """Terms of each row of ``docs`` with their counts. A row is a whole document, so nothing is shuffled."""
    return unnest_structs(docs, counts_in_row(F.col(words)), *keep, required="term")


def document_frequency(docs: DataFrame, words: str = "words", by: list[str] = ()) -> DataFrame:
    """Documents per term. Repeats are dropped inside each row, so only terms are shuffled."""
    once = unnest(docs, F.array_distinct(words), *by)
    return count_by(once, *by, "term", name="df")


def vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, cnt, term_id)``, most frequent first, ties in term order."""
    return zip_index(count_by(terms, "term"), [F.col("cnt").desc(), F.col("term")], "term_id")


def term_blocks(docs: DataFrame, keep: list[str] = ("doc_id",), words: str = "words") -> DataFrame:
    """Rows of ``docs`` in blocks of about ``BLOCK_WORDS`` words, written once as two steps read them.

    A row has its ``_block``, the ``keep`` columns, numbers of its terms and their counts, as bytes; one more row of each block has the
    block's different terms, at the place of their number, and in how many rows of the block they are.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(words).alias("_words"))
    schema = T.StructType([T.StructField("_block", T.LongType()), *[T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]],
                           *[T.StructField(c, T.BinaryType()) for c in ("_codes", "_tfs")],
                           T.StructField("_rows", T.ArrayType(T.IntegerType())), T.StructField("_terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(len(keep))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo, done = np.cumsum(sizes), 0, 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_WORDS, side="right")))
                part = batch.slice(lo, hi - lo)
                row, code, tf, terms = counted(np.repeat(np.arange(len(part)), sizes[lo:hi]), part.column(len(keep)).flatten())
                at = np.searchsorted(row, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block)), *part.columns[:-1], _as_bytes(at, code, np.int32), _as_bytes(at, tf, np.int32),
                     pa.nulls(len(part), pa.list_(pa.int32())), pa.nulls(len(part), pa.list_(pa.string()))], names=schema.names)
                if len(terms):
                    whole, number = pa.array([0, len(terms)], pa.int32()), np.bincount(code, minlength=len(terms))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), *[pa.nulls(1, c.type) for c in [*part.columns[:-1], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]],
                         pa.ListArray.from_arrays(whole, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(whole, terms)], names=schema.names)
                block, lo, done = block + 1, hi, int(ends[hi - 1])

    path = scratch_path(spark, "term-blocks")
    rows.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def _as_bytes(at: np.ndarray, values: np.ndarray, kind: type) -> pa.Array:
    """The values from ``at[i]`` up to ``at[i + 1]`` as the bytes of row ``i``."""
    values = np.ascontiguousarray(values, kind)
    ends = (np.asarray(at) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _from_bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Number of values of each row, and the values of all rows."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    item, n = np.dtype(kind).itemsize, int(ends[-1] - ends[0])
    values = np.frombuffer(data, kind, n // item, int(ends[0])) if n else np.zeros(0, kind)
    return np.diff(ends) // item, values


def attach_idf(blocks: DataFrame, n_docs: int | None = None) -> DataFrame:
    """``term``, the columns of the rows of ``term_blocks``, ``tf`` and ``tfidf``.

    Only the different terms of each block are shuffled: to their term, which sums the document counts of all blocks, and
    with the IDF back to the block.
    """
    rows = blocks.filter("_terms IS NULL").drop("_rows", "_terms")
    n_docs = rows.count() if n_docs is None else n_docs
    terms = blocks.filter("_terms IS NOT NULL").select("_block", F.posexplode(F.arrays_zip("_terms", "_rows")).alias("_code", "x"))
    terms = terms.select("_block", "_code", F.col("x._terms").alias("term"), F.sum("x._rows").over(Window.partitionBy("x._terms")).alias("df"))
    terms = terms.select("_block", "_code", "term", idf(n_docs, "df").alias("idf"))
    keep = rows.drop("_block", "_codes", "_tfs").schema.fields
    schema = T.StructType([T.StructField("term", T.StringType()), *keep, T.StructField("tf", T.LongType()), T.StructField("tfidf", T.DoubleType())])

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.argsort(right.column("_code").to_numpy())
        names, scale = right.column("term").combine_chunks().take(pa.array(place)), right.column("idf").to_numpy()[place]
        (sizes, code), (_, tf) = (_from_bytes(left.column(c).combine_chunks(), np.int32) for c in ("_codes", "_tfs"))
        row = pa.array(np.repeat(np.arange(len(left)), sizes))
        return pa.Table.from_arrays([names.take(pa.array(code)), *[left.column(f.name).combine_chunks().take(row) for f in keep],
                                     pa.array(tf.astype(np.int64)), pa.array(tf * scale[code])], names=schema.names)

    return rows.groupBy("_block").cogroup(terms.groupBy("_block")).applyInArrow(weigh, schema)


def tfidf(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    return attach_idf(term_blocks(docs, keep))


def group_tfidf(docs: DataFrame, by: str, doc: str = "doc_id") -> DataFrame:
    """TF-IDF with the IDF fitted inside each group, all groups in one pass."""
    sizes = count_by(docs, by, name="m")
    df = document_frequency(docs, by=[by]).join(sizes, by)
    weight = F.col("tf") * F.log((F.col("m") + 1) / (F.col("df") + F.lit(1.0)))
    tf = term_frequency(docs, [by, doc])
    return tf.join(df, [by, "term"]).select(by, doc, "term", "tf", weight.alias("tfidf"))


def best_first(score: str) -> list[Column]:
    """Highest score first; scores equal to nine places are ordered by term."""
    return [F.round(score, SCORE_DIGITS).desc(), F.col("term")]


def top_terms(weights: DataFrame, n: int, score: str = "tfidf", by: list[str] = ("doc_id",)) -> DataFrame:
    """The ``n`` heaviest terms of each document; fewer when it has fewer distinct terms."""
    return top_by_group(_leading(weights, n, score, list(by)), list(by), best_first(score), n)


def _leading(weights: DataFrame, n: int, score: str, by: list[str]) -> DataFrame:
    """``weights`` without rows that ``n`` neighbours of the same document clearly surpass, so that few rows are sorted."""
    schema = weights.schema
    near = 2 * 10.0 ** -SCORE_DIGITS  # scores as close as this may be equal once rounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(schema.names.index(score)).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            run_of = np.cumsum(_changes([batch.column(schema.names.index(c)) for c in by], len(batch))) - 1
            known = np.flatnonzero(~np.isnan(value))
            order = known[np.lexsort((-value[known], run_of[known]))]
            place = np.arange(len(order)) - np.searchsorted(run_of[order], run_of[order])
            least = np.full(len(batch), -np.inf)
            at = order[place == n - 1]
            least[run_of[at]] = value[at] - near - 1e-12 * np.abs(value[at])
            yield batch.filter(pa.array(~(value < least[run_of])))

    return weights.mapInArrow(run, schema)


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """True for each row that differs from the one before it; null differs from all."""
    new = np.ones(n, bool)
    if n > 1:
        pairs = (pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True) for c in columns)
        new[1:] = np.any([p.to_numpy(zero_copy_only=False) for p in pairs], axis=0)
    return new


def joined_terms(ranked: DataFrame, by: list[str]) -> DataFrame:
    """The ranked terms of each document as one blank-separated string."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x.term), " ").alias("hotwords"))


def cosine_pairs(weights: DataFrame, pairs: DataFrame, score: str = "tfidf") -> DataFrame:
    """Cosine of the two documents of each ``(left_id, right_id)`` row, where one of them has terms.

    The terms of a document travel as one row: once to the document and once, as the left side, to the right one.
    """
    vectors = _packed(weights, score).groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    left, right = (vectors.select(F.col("doc_id").alias(f"{side}_id"), F.col("parts").alias(side)) for side in ("left", "right"))
    met = pairs.select("left_id", "right_id").distinct().join(left, "left_id", "left").join(right, "right_id", "left")
    met = met.filter("left IS NOT NULL OR right IS NOT NULL").select("left_id", "right_id", "left", "right")
    schema = T.StructType([*met.schema.fields[:2], T.StructField("cosine", T.DoubleType())])
    return met.mapInArrow(_cosines, schema)


def _packed(weights: DataFrame, score: str) -> DataFrame:
    """``doc_id`` and ``part``, the terms of neighbouring rows of a document: their bytes, and their sizes and weights as bytes. A document has one row or more."""
    schema = T.StructType([weights.schema["doc_id"], T.StructField("part", PART)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, n = batch.column(0), batch.column(1).cast(pa.large_binary()), len(batch)
            starts = np.flatnonzero(_changes([ids], n))
            at = np.append(starts, n)
            ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + n + 1]
            data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            part = pa.StructArray.from_arrays([_as_bytes(ends[at] - ends[0], data, np.uint8), _as_bytes(at, np.diff(ends), np.int32),
                                               _as_bytes(at, batch.column(2).to_numpy(zero_copy_only=False), np.float64)], names=PART.names)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), part], names=["doc_id", "part"])

    return weights.select("doc_id", "term", F.col(score).cast("double").alias("w")).mapInArrow(run, schema)


def _unpacked(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, size and weight of each term of ``parts``, and the bytes of all terms."""
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    (_, raw), (n, sizes), (_, w) = (_from_bytes(flat.field(c), kind) for c, kind in (("names", np.uint8), ("sizes", np.int32), ("w", np.float64)))
    return np.repeat(np.repeat(np.arange(len(parts)), counts), n), sizes, w, raw


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of the parts of two documents in each row; null where a side has no length."""
    for batch in batches:
        for lo in range(0, len(batch), PAIRS_AT_ONCE):
            part = batch.slice(lo, PAIRS_AT_ONCE)
            n = len(part)
            (lrow, lsize, lw, lraw), (rrow, rsize, rw, rraw) = _unpacked(part.column(2)), _unpacked(part.column(3))
            ends = np.concatenate([[0], np.cumsum(np.concatenate([lsize, rsize]), dtype=np.int64)])
            raw = np.concatenate([lraw, rraw])
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            code = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cell, back = np.unique(np.concatenate([lrow, rrow]) * (len(code) + 1) + code, return_inverse=True)
            left = np.bincount(back[:len(lrow)], lw, len(cell))
            right = np.bincount(back[len(lrow):], rw, len(cell))
            row = cell // (len(code) + 1)
            dot, norm_l, norm_r = (np.bincount(row, v, n) for v in (left * right, left * left, right * right))
            length = np.sqrt(norm_l) * np.sqrt(norm_r)
            cosine = np.divide(dot, length, out=np.zeros(n), where=length != 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cosine, mask=length == 0)],
                                             names=["left_id", "right_id", "cosine"])


def listed_idf(docs: DataFrame, terms: list[str], words: str = "words") -> DataFrame:
    """``(term, df, idf)`` of given terms; only these leave the scan, absent ones have df 0."""
    n_docs = docs.count()
    listed = F.array(*[F.lit(term) for term in terms])
    found = document_frequency(docs.select(F.array_intersect(words, listed).alias(words)), words)
    asked = docs.sparkSession.createDataFrame([(term,) for term in terms], "term string")
    counted = asked.join(found, "term", "left").na.fill(0, ["df"])
    return counted.withColumn("idf", idf(n_docs, "df"))
