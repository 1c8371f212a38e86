"""Terms of raw text: news tokeniser, dictionary segmentation and synonym expansion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatloom.functions.text import NEWS_STOPWORDS
from heatloom.functions.unnest import unnest
from heatloom.operators.counts import counted
from heatloom.operators.small import checked_broadcast
from heatloom.session import scratch_path

# Longest dictionary word and the characters that are matched against it.
MAX_WORD = 7
CJK = "一-鿿"
# Largest dictionary kept whole in each task.
MAX_LEXICON = 500_000
# Longest list of stop words that is sent to the tasks.
MAX_STOPWORDS = 10_000
# Bytes of text cut at once.
CHUNK_BYTES = 2_000_000
# Lower case of the bytes of words, 0 for all others.
_LOWER = np.zeros(256, np.uint8)
_LOWER[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = list(b"abcdefghijklmnopqrstuvwxyz0123456789_")
_LOWER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")


def clean_terms(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text",
                stopwords: list[str] = NEWS_STOPWORDS, min_len: int = 2, min_count: int = 2) -> DataFrame:
    """``(keep.., term, tf)``: words without digits, stop words, short and rare ones.

    A term that reaches ``min_count`` in the texts that are counted together is not rare; only rows of other terms meet the totals of all
    texts. The counts are written first, as another run may count other texts together.
    """
    path = scratch_path(docs.sparkSession, "news-terms")
    _news_counts(docs, keep, text, stopwords, min_len).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    totals = rows.filter("_total IS NOT NULL").groupBy("term").agg(F.sum("_total").alias("total"))
    frequent = totals.filter(F.col("total") >= min_count).select("term")
    sure, columns = F.col("_near") >= min_count, [*keep, "term", "tf"]
    return rows.filter(sure).select(columns).unionByName(rows.filter(~sure).join(frequent, "term", "left_semi").select(columns))


def news_terms(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text",
               stopwords: list[str] = NEWS_STOPWORDS, min_len: int = 2) -> DataFrame:
    """The same terms before rare ones are dropped."""
    return _news_counts(docs, keep, text, stopwords, min_len).select(*keep, "term", "tf")


def _news_counts(docs: DataFrame, keep: list[str], text: str, stopwords: list[str], min_len: int) -> DataFrame:
    """``(keep.., term, tf, _near, _total)``; ``_near`` is the term's count in the texts counted together, ``_total`` the same in one
    row of each term, else null.

    Words are runs of ASCII letters, digits and ``_``, so they are cut, lower-cased and counted as bytes; stop words and the like are told
    from the distinct words.
    """
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("term", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("tf", "_near", "_total")]])
    stop = pa.array(list(stopwords), pa.string())

    def use(names: pa.Array) -> np.ndarray:
        fits = pc.and_(pc.invert(pc.match_substring_regex(names, "[0-9]")), pc.greater_equal(pc.binary_length(names), min_len))
        return pc.and_(fits, pc.invert(pc.is_in(names, value_set=stop))).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
            lo = done = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                row, code, tf, names = counted(*ascii_words(part.column("_text")), use)
                near = np.bincount(code, tf, len(names)).astype(np.int64)[code]
                once = np.ones(len(code), bool)
                once[np.unique(code, return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(row)) for c in keep], names.take(pa.array(code)), pa.array(tf), pa.array(near),
                     pa.array(near, mask=once)], names=schema.names)
                lo, done = hi, int(sizes[hi - 1])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and word, lower-cased, of each run of ``[A-Za-z0-9_]`` of each text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # a byte that is in no word ends each text
    joined = "\n".join(texts.fill_null("").to_pylist()).encode() + b"\n"
    lowered = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = np.concatenate([[False], lowered > 0])
    bounds = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int64)  # where words begin and end, in turn
    row = np.searchsorted(np.cumsum(sizes + 1), bounds[::2], side="right")
    cut = pa.LargeStringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(bounds), pa.py_buffer(lowered))
    return row, cut.take(pa.array(np.arange(0, len(cut), 2))).cast(pa.string())


def _walk(run: str, known, max_len: int) -> list[str]:
    """Longest known word at each step; a character that starts none is passed over."""
    out, i = [], 0
    while i < len(run):
        n = next((n for n in range(min(max_len, len(run) - i), 0, -1) if run[i:i + n] in known), 0)
        if n:
            out.append(run[i:i + n])
        i += n or 1
    return out


def segment_corpus(docs: DataFrame, lexicon: DataFrame, stopwords: DataFrame | None = None,
                   doc: str = "doc_id", text: str = "text", max_len: int = MAX_WORD,
                   dictionary_chars: str = CJK, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """Add ``words``: the lower-cased text cut into words, stop words cleared.

    Runs of ``dictionary_chars`` are matched against ``lexicon (word)``, longest word first.
    Runs of other letters and digits are words as they are. A dictionary of up to
    ``max_lexicon`` words is sent to the tasks; with a larger one each document first gets,
    by a join, the dictionary words that occur in it.
    """
    pattern = rf"[{dictionary_chars}]+|[\p{{L}}\p{{N}}&&[^{dictionary_chars}]]+"
    runs = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    docs = docs.withColumn("_runs", runs)
    fits = (F.length("word") <= max_len) & F.col("word").rlike(f"^[{dictionary_chars}]+$")
    lexicon = lexicon.select(F.lower("word").alias("word")).filter(fits).distinct()
    in_dictionary = f"^[{dictionary_chars}]+$"

    rows = lexicon.limit(max_lexicon + 1).collect()
    if len(rows) <= max_lexicon:
        listed = [] if stopwords is None else _listed(stopwords, MAX_STOPWORDS)
        small = len(listed) <= MAX_STOPWORDS
        shared = docs.sparkSession.sparkContext.broadcast(({row["word"] for row in rows}, set(listed) if small else set()))
        docs = docs.withColumn("words", _cutter(shared, dictionary_chars, max_len)("_runs")).drop("_runs")
        return docs if small else clear_stopwords(docs, stopwords, doc)

    docs = docs.join(_known_words(docs, lexicon, doc, in_dictionary, max_len), doc, "left")

    @F.pandas_udf("array<string>")
    def cut(all_runs: pd.Series, flags: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([_cut(r, f, set(() if k is None else k), max_len)
                          for r, f, k in zip(all_runs, flags, known)])

    docs = docs.withColumn("_flags", F.transform("_runs", lambda r: r.rlike(in_dictionary)))
    docs = docs.withColumn("words", cut("_runs", "_flags", "_known")).drop("_runs", "_flags", "_known")
    return docs if stopwords is None else clear_stopwords(docs, stopwords, doc)


def _cutter(shared, dictionary_chars: str, max_len: int):
    """Runs to words, stop words cleared. Each distinct run of a batch is cut once."""
    @F.arrow_udf("array<string>")
    def cut(runs: pa.Array) -> pa.Array:
        known, stop = shared.value
        dictionary = re.compile(f"[{dictionary_chars}]+")
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        coded = runs.flatten().dictionary_encode()
        pieces = [[w for w in (_walk(run, known, max_len) if dictionary.fullmatch(run) else [run]) if w not in stop]
                  for run in coded.dictionary.to_pylist()]
        words = pa.array(pieces, pa.list_(pa.string())).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
        ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
        missing = runs.is_null() if runs.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.flatten(), mask=missing)

    return cut


def _cut(runs, flags, known, max_len: int) -> list[str]:
    out = []
    for run, dictionary in zip(runs, flags):
        if dictionary:
            out += _walk(run, known, max_len)
        else:
            out.append(run)
    return out


def _known_words(docs: DataFrame, lexicon: DataFrame, doc: str, in_dictionary: str, max_len: int) -> DataFrame:
    """The dictionary words that occur in each document."""
    runs = unnest(docs, F.array_distinct("_runs"), doc, name="run").filter(F.col("run").rlike(in_dictionary))
    starts = runs.select(doc, "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    parts = starts.select(doc, "run", "i", F.explode(F.sequence(F.lit(1), F.lit(max_len))).alias("n"))
    parts = parts.filter(F.col("i") + F.col("n") - 1 <= F.length("run"))
    words = parts.select(doc, F.col("run").substr(F.col("i"), F.col("n")).alias("word")).distinct()
    return words.join(lexicon, "word", "left_semi").groupBy(doc).agg(F.collect_set("word").alias("_known"))


def _listed(stopwords: DataFrame, max_list: int) -> list[str]:
    """The stop words, or one more than ``max_list`` of them."""
    return [row["word"] for row in stopwords.select("word").distinct().limit(max_list + 1).collect()]


def clear_stopwords(docs: DataFrame, stopwords: DataFrame, doc: str = "doc_id", max_list: int = MAX_STOPWORDS) -> DataFrame:
    """Remove the words of ``stopwords (word)`` from ``words``. A list above ``max_list`` is joined: each document
    gets the stop words that occur in it."""
    listed = _listed(stopwords, max_list)
    if len(listed) > max_list:
        own = unnest(docs, F.array_distinct("words"), doc, name="word").join(stopwords.select("word").distinct(), "word", "left_semi")
        own = own.groupBy(doc).agg(F.collect_set("word").alias("_stop"))
        left = F.filter("words", lambda w: ~F.array_contains("_stop", w))
        return docs.join(own, doc, "left").withColumn("words", F.when(F.col("_stop").isNull(), F.col("words")).otherwise(left)).drop("_stop")
    return docs.withColumn("words", F.filter("words", lambda w: ~w.isin(*listed))) if listed else docs


def expand_synonyms(tokens: DataFrame, lexicon: DataFrame, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """Each token followed by the synonyms the lexicon gives for it.

    ``tokens`` has a ``term`` column, ``lexicon`` is ``(word, synonyms array)``; the added rows
    keep the position of the token and carry it in ``origin``.
    """
    entries = checked_broadcast(
        lexicon.filter(F.col("synonyms").isNotNull()).select(F.col("word").alias("term"), "synonyms"), max_lexicon)
    spread = F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))
    joined = tokens.join(entries, "term", "left")
    others = [c for c in tokens.columns if c != "term"]
    return joined.select(*others, F.col("term").alias("origin"), F.explode(spread).alias("term"))
