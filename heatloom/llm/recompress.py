"""Duplicate word passages by recompression.

A text is a sequence of words. Rounds rename it: a run of one symbol becomes one symbol, then pairs whose first symbol
falls in the left and whose second in the right half of the names become one symbol. Names are fingerprints of what
they stand for, so all tasks give equal runs and pairs the same name and equal passages get the same symbols inside;
only symbols near the ends of a passage depend on what stands around it. Each symbol carries the range of words that it
depends on; symbols whose range lies in a window are the same in every copy of the window.

A window of ``length`` words is named by the smallest of the symbols that depend on it alone (the name covers the
whole range of words the symbol depends on). Only windows whose symbol is found in two texts can be copies. These are
then verified: hashes of all their words are grouped, and the smallest document that has the window decides. A window
that holds no such symbol (inside long runs) stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.arrays import U64, chunks, mix, powers, signed, slice_hashes, window_hashes, words
from heatloom.llm.store import Scratch, checkpointed

LENGTH = 50
ROUNDS = 3
_BASE = 0xD1342543DE82EF95
_FAR = 1 << 40
_NO_NAME = np.uint64(np.iinfo(np.uint64).max)


class Symbols:
    """The symbols of one text: names, first word, and the range of words that each depends on."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        self.names = names
        self.lo, self.hi = np.arange(n), np.arange(1, n + 1)

    def _merge(self, heads: np.ndarray, names: np.ndarray) -> None:
        """Groups that start at ``heads`` become symbols; each depends on its neighbours on both sides too."""
        before = np.concatenate([[-_FAR], self.lo])[heads]  # the range of the symbol before the group
        ends = np.append(heads[1:], len(self.names))
        after = np.append(self.hi, _FAR)[ends]
        self.lo, self.hi, self.names = before, after, names

    def runs(self) -> None:
        """Runs of one symbol become one symbol."""
        heads = np.flatnonzero(np.concatenate([[True], self.names[1:] != self.names[:-1]]))
        length = np.diff(np.append(heads, len(self.names))).astype(np.uint64)
        first = self.names[heads]
        self._merge(heads, np.where(length > 1, mix(first * U64(0x9FB21C651E98DF25) + length), first))

    def pairs(self, turn: int) -> None:
        """A left symbol followed by a right symbol become one symbol."""
        left = (mix(self.names + U64(turn + 1)) & U64(1)) == 0
        join = left[:-1] & ~left[1:]
        heads = np.flatnonzero(np.concatenate([[True], ~join]))
        double = np.append(heads[1:], len(self.names)) - heads == 2
        first = self.names[heads]
        second = self.names[np.minimum(heads + 1, len(self.names) - 1)]
        self._merge(heads, np.where(double, mix(first * U64(0xC2B2AE3D27D4EB4F) ^ mix(second)), first))


def window_names(h: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS) -> np.ndarray:
    """The name of each window of one text's word hashes (at least ``length`` words)."""
    symbols = Symbols(h)
    for turn in range(rounds):
        symbols.runs()
        symbols.pairs(turn)
    size = symbols.hi - symbols.lo
    use = (symbols.lo >= 0) & (symbols.hi <= len(h)) & (size <= length)
    lo, hi, names = symbols.lo[use], symbols.hi[use], symbols.names[use]
    count = len(h) - length + 1
    best = np.full(count, _NO_NAME, np.uint64)
    if len(lo):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
        ranges = mix(((sums[hi] - sums[lo]) * powers(pow(_BASE, -1, 1 << 64), len(h))[lo]) ^ names ^ (hi - lo).astype(np.uint64))
        # lo and hi both rise, so the symbols of a window are neighbours; minima of 1, 2, 4, ... neighbours give theirs
        place = np.arange(count)
        a, b = np.searchsorted(lo, place), np.searchsorted(hi, place + length, side="right")
        level = np.zeros(count, np.int64)
        some = b > a
        level[some] = np.log2(b[some] - a[some]).astype(np.int64)
        for k in range(int(level.max(initial=0)) + 1):
            now = some & (level == k)
            best[now] = np.minimum(ranges[a[now]], ranges[b[now] - (1 << k)])
            if len(ranges) > 1 << k:
                ranges = np.minimum(ranges[:-(1 << k)], ranges[1 << k:])
    alone = best == _NO_NAME
    if alone.any():
        best[alone] = window_hashes(h, length)[alone]
    return best


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes, word starts, word ends, word hashes) of each text."""
    for row, _, data, offsets in chunks(batch.column(column)):
        starts, ends, at = words(data, offsets)
        h = slice_hashes(data, starts, ends)
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            yield row + k, data, starts[lo:hi], ends[lo:hi], h[lo:hi]


def _name_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, rows = [np.zeros(0, np.uint64)], [], []
            for row, _, _, _, h in _texts(batch, 2):
                if len(h) >= length:
                    own = np.unique(window_names(h, length))
                    names.append(own)
                    sizes.append(len(own))
                    rows.append(row)
            of = pa.array(np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(names))), batch.column(0).take(of), batch.column(1).take(of)],
                                             names=["key", "t1", "t2"])

    return run


_OTHER = 0xA24BAED4963EE407


def _window_rows(length: int):
    """Hashes of the windows whose name is shared: key, second hash, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            parts: list[list] = [[], [], [], []]
            for row, _, _, _, h in _texts(batch, 2):
                keys = wanted[row].values.to_numpy()
                at = np.flatnonzero(np.isin(signed(window_names(h, length)), keys))
                parts[0].append(signed(window_hashes(h, length))[at])
                parts[1].append(signed(window_hashes(h, length, _OTHER))[at].astype(np.int32))
                parts[2].append(np.full(len(at), row))
                parts[3].append(at.astype(np.int32))
            k1, k2, row, at = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            step = 500_000
            for lo in range(0, max(len(at), 1), step):
                of = pa.array(row[lo:lo + step].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo:lo + step], pa.int64()), pa.array(k2[lo:lo + step].astype(np.int32)), batch.column(0).take(of),
                     batch.column(1).take(of), pa.array(at[lo:lo + step].astype(np.int32))], names=["k1", "k2", "d", "t", "at"])

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            places = batch.column(3)
            for row, data, starts, ends, h in _texts(batch, 2):
                gone = np.zeros(len(h) + 1, np.int32)
                at = places[row].values.to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                n.append(len(h))
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                raw = memoryview(np.ascontiguousarray(data))
                kept.append(b" ".join(raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["t1", "t2", "n_words", "n_removed", "spans", "kept"])

    return run


def _word_column(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two tables. The first has a row for each text that loses words to other texts: ``t1, t2`` (hashes naming the
    text), ``n_words``, ``n_removed``, ``spans`` (ranges of words) and ``kept`` (the other words joined by a blank).
    The second has each text's smallest id: ``t1, t2, d``.

    A word is removed when a window of ``length`` words that covers it also starts in a document with a smaller id.
    Equal texts are worked on once, for their smallest id; those with a larger one lose everything (if they have a
    window). Rows without an id or without a text take no part. Other columns are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.filter(F.col(id_col).isNotNull() & text.isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    id_type = dict(rows.dtypes)["id"]
    heads = checkpointed(rows.groupBy("t1", "t2").agg(F.min("id").alias("d")))
    names = scratch.table(rows.select("t1", "t2", "text").mapInArrow(_name_rows(length), "key long, t1 long, t2 long"), "names")
    shared = names.groupBy("key").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo < hi").select("key")
    own = names.join(shared, "key").groupBy("t1", "t2").agg(F.collect_set("key").alias("keys"))
    texts = rows.select("t1", "t2", "text").join(own, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).join(heads, ["t1", "t2"])
    texts = texts.withColumn("t", F.col("t1").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    texts = scratch.table(texts.select("d", "t", "text", "keys", "t1", "t2"), "texts")
    scratch.drop(names)

    windows = texts.select("d", "t", "text", "keys").mapInArrow(_window_rows(length), f"k1 long, k2 int, d {id_type}, t int, at int")
    windows = scratch.table(windows, "windows")
    least = windows.groupBy("k1", "k2").agg(F.min("d").alias("m"), F.max("d").alias("x")).filter("m < x").select("k1", "k2", "m")
    hits = windows.join(least, ["k1", "k2"]).filter("m < d").groupBy("d", "t").agg(F.collect_list("at").alias("at"))
    marked = texts.select("d", "t", "t1", "t2", "text").join(hits, ["d", "t"]).select("t1", "t2", "text", "at")
    out = scratch.table(marked.mapInArrow(
        _kept(length), "t1 long, t2 long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"), "passages")
    scratch.drop(texts, windows)
    return out, heads


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed and the SHA-256 of the kept words joined by a blank."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
                       _word_column(F.coalesce(text, F.lit(""))).alias("w"))
    rows = rows.select("id", "t1", "t2", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("sha"))
    found, heads = passages(docs, id_col, text_col, length)
    found = found.select("t1", "t2", "n_removed", F.sha2("kept", 256).alias("left"))
    rows = rows.join(heads, ["t1", "t2"], "left").join(found, ["t1", "t2"], "left")
    copy = (F.col("d") < F.col("id")) & (F.col("n_words") >= length)
    return rows.select(
        F.col("id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("id").isNull(), F.col("sha")).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))
