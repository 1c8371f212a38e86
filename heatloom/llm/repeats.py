"""Suffix-array deduplication: bytes covered by a long string that occurs more than once in the corpus.

1. Windows are sampled (``windows``): only anchors found at two places or more can belong to equal windows. Anchor
   hashes are counted by partial aggregation; most text ends here.
2. A shared anchor's context is the stretch of text that its windows cover. Contexts of one anchor meet in one block of
   bounded size, and a block is indexed by a run-compressed Burrows-Wheeler transform with sampled run ends, from which
   the matching statistics of each place are streamed (``runindex``). A place whose match is long enough starts a
   repeated window. Equal contexts of a block are indexed once.
3. An anchor found at more than ``HOT`` places (a passage in a part of all documents) would make a block without bound.
   Its windows are counted by 128-bit hashes instead, combined on the map side, which splits it to any number of tasks:
   strips of ``STRIP`` windows first, then the single windows of strips that stand alone (and of one copy of the others).

Equal texts are worked on once. No place is left out: every window has an anchor, and each anchor is either unique
(the window is unique), indexed, or counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.arrays import BYTE_VALUES, U64, buffers, mix, powers, seeded, signed, window_hashes
from heatloom.llm.runindex import RunIndex
from heatloom.llm.store import Scratch
from heatloom.llm.windows import anchors, cuts

LENGTH = 400
HOT = 1000
BLOCK_BYTES = 300_000
STRIP = 32
_SECOND = seeded(256, 77)
_NOTHING = np.zeros(0, np.int64)
_BASE = 0xA24BAED4963EE407


def _each(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    data, offsets = buffers(batch.column(column))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, rows = [], [], []
            for data in _each(batch, 2):
                found = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(data) >= length:
                    place, value, _ = anchors(data, length)
                    _, one = np.unique(place, return_index=True)
                    found = np.unique(value[one], return_counts=True)
                keys.append(found[0])
                counts.append(found[1])
                rows.append(len(found[0]))
            of = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), batch.column(0).take(of), batch.column(1).take(of),
                 pa.array(np.concatenate(counts).astype(np.int32))], names=["key", "t1", "t2", "c"])

    return run


def _contexts(length: int):
    """Contexts of anchors that are indexed, and hashes of the windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted, hot = batch.column(3), batch.column(4)
            out: dict[str, list] = {name: [] for name in ("key", "k2", "row", "at", "n", "context", "w1", "w2")}
            size = 0
            for i, data in enumerate(_each(batch, 2)):
                place, value, first = anchors(data, length)
                windows = len(data) - length + 1
                number = cuts(first, windows)
                value = signed(value)
                cold = np.isin(value, wanted[i].values.to_numpy())
                warm = np.isin(value, hot[i].values.to_numpy())
                if cold.any():
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
                    f, c = first[cold], number[cold]
                    stop = f + c + length - 1
                    whole = mix((sums[stop] - sums[f]) * powers(pow(_BASE, -1, 1 << 64), len(data))[f] + c.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                    ids = np.stack([value[cold], signed(whole)], axis=1)
                    _, one, back = np.unique(ids, axis=0, return_index=True, return_inverse=True)
                    order = np.argsort(back.reshape(-1), kind="stable")
                    groups = np.split(f[order], np.cumsum(np.bincount(back.reshape(-1)))[:-1])
                    raw = data.tobytes()
                    for k, places in zip(one.tolist(), groups):
                        context = raw[f[k]:stop[k]]
                        out["key"].append(ids[k, 0])
                        out["k2"].append(ids[k, 1])
                        out["row"].append(i)
                        out["at"].append(places.astype(np.int32))
                        out["n"].append(int(c[k]))
                        out["context"].append(context)
                        out["w1"].append(_NOTHING)
                        out["w2"].append(_NOTHING)
                        size += len(context)
                if warm.any():
                    h1, h2 = window_hashes(BYTE_VALUES[data], length), window_hashes(_SECOND[data], length)
                    for p, f, c in zip(place[warm].tolist(), first[warm].tolist(), number[warm].tolist()):
                        # strips lie at fixed distances from the anchor, so that copies are cut alike
                        edges = [f, *range(f + (p - f) % STRIP + 1, f + c, STRIP), f + c]
                        for a, b in zip(edges[:-1], edges[1:]):
                            if a == b:
                                continue
                            for name, h, seed in (("key", h1, 17), ("k2", h2, 29)):
                                sums = mix(h[a:b] + seeded(b - a, seed)).sum(dtype=np.uint64)
                                out[name].append(int(mix(sums.reshape(1) + U64(p - a)).view(np.int64)[0]))
                            out["row"].append(i)
                            out["at"].append(np.array([a], np.int32))
                            out["n"].append(b - a)
                            out["context"].append(None)
                            out["w1"].append(signed(h1[a:b]))
                            out["w2"].append(signed(h2[a:b]))
                            size += 16 * (b - a) + 60
                if size > 4_000_000:
                    yield _context_batch(out, t1, t2)
                    out, size = {k: [] for k in out}, 0
            yield _context_batch(out, t1, t2)

    return run


def _context_batch(out: dict[str, list], t1: np.ndarray, t2: np.ndarray) -> pa.RecordBatch:
    row = np.array(out["row"], np.int64)
    lists = [_lists(out["at"], np.int32), _lists(out["w1"], np.int64), _lists(out["w2"], np.int64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(out["key"], np.int64)), pa.array(np.array(out["k2"], np.int64)), pa.array(t1[row]), pa.array(t2[row]),
         lists[0], pa.array(out["n"], pa.int32()), pa.array(out["context"], pa.binary()), *lists[1:]],
        names=["key", "k2", "t1", "t2", "at", "n", "context", "w1", "w2"])


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, kind)))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Block:
    """Groups of contexts that wait for their index; a group is the contexts of one anchor."""

    def __init__(self, length: int):
        self.length = length
        self.contexts: dict[bytes, list] = {}  # context -> [number of windows, occurrences]
        self.groups: list[tuple[dict, int]] = []
        self.size = 0

    def add(self, group: dict[bytes, list]) -> None:
        for context, entry in group.items():
            known = self.contexts.get(context)
            if known is None:
                self.contexts[context] = entry
                self.size += len(context) + 1
            else:  # the same stretch under another anchor of equal hash cannot be; the same anchor came in two parts
                known[1] += entry[1]

    def flush(self) -> Iterator[tuple]:
        """(t1, t2, first place, place after the last) of runs of repeated windows."""
        if len(self.contexts) > 0:
            texts = list(self.contexts)
            size = np.array([len(t) for t in texts], np.int64)
            begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
            stats = None
            if len(texts) > 1:
                text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
                stats = RunIndex(text).matching_statistics()
            for t, lo, n in zip(texts, begin.tolist(), size.tolist()):
                count, places = self.contexts[t]
                if sum(len(p[2]) for p in places) > 1:
                    runs = [(0, count)]
                else:
                    long = stats[lo:lo + count] >= self.length if stats is not None else np.zeros(count, bool)
                    runs = list(zip(*(x.tolist() for x in _runs(long))))
                for a, b in runs:
                    for t1, t2, at in places:
                        for p in at:
                            yield t1, t2, p + a, p + b
        self.__init__(self.length)


def _found(length: int, block_bytes: int):
    """Repeated windows of contexts that come sorted by anchor."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["t1", "t2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, key = _Block(length), {}, None

        def close() -> None:
            if len(group) > 1 or any(sum(len(p[2]) for p in e[1]) > 1 for e in group.values()):
                block.add(group)

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    close()
                    if block.size > block_bytes:
                        yield out(list(block.flush()))
                    group, key = {}, row["key"]
                group.setdefault(row["context"], [row["n"], []])[1].append((row["t1"], row["t2"], row["at"]))
        close()
        yield out(list(block.flush()))

    return run


def _removed(length: int):
    """Spans of a text from its runs of repeated windows; what is left of it as bytes and, in whole characters, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, texts = [], [], []
            for data, runs in zip(_each(batch, 2), batch.column(3).to_pylist()):
                gone = np.zeros(len(data) + 1, np.int32)
                for r in runs:
                    gone[r["a"]] += 1
                    gone[r["b"] + length - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                a, b = _runs(gone)
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                kept.append(data[~gone].tobytes())
                inner = (data & 0xC0) == 0x80  # a character goes only as a whole
                char = np.cumsum(~inner) - 1
                stays = np.ones(char[-1] + 1, bool)
                stays[:] = np.bincount(char, weights=~gone, minlength=len(stays)) > 0
                texts.append(data[stays[char]].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(kept, pa.binary()), pa.array(texts, pa.string())], names=["t1", "t2", "spans", "kept", "kept_text"])

    return run


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def repeated(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = HOT,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The different texts of ``docs`` that lose bytes: ``t1, t2`` (hashes naming the text), ``spans`` (byte ranges
    removed), ``kept`` (bytes left) and ``kept_text`` (the same in whole characters, for use as text).

    A byte is removed when a string of ``length`` bytes that covers it also starts at another place of any text; rows
    are places, so a text that two rows share goes as a whole. Null, empty and shorter texts lose nothing. Matches do
    not cross texts. Columns other than the text are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    long_ = _named(docs, text_col).filter(F.octet_length("text") >= length)
    rows = scratch.table(long_.mapInArrow(_anchor_rows(length), "key long, t1 long, t2 long, c int"), "anchors")
    keys = rows.groupBy("key").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.max("c").alias("c"),
                                   F.sum("c").alias("n")).filter("lo < hi OR c > 1")
    keys = keys.select("key", (F.col("n") > hot).alias("hot"))
    own = rows.select("key", "t1", "t2").join(keys, "key").groupBy("t1", "t2").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    texts = scratch.table(long_.join(own, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("t1", "t2", "text", "cold", "hot"), "texts")
    scratch.drop(rows)

    places = scratch.table(texts.mapInArrow(
        _contexts(length), "key long, k2 long, t1 long, t2 long, at array<int>, n int, context binary, w1 array<long>, w2 array<long>"), "contexts")
    cold = places.filter("context IS NOT NULL").repartition("key").sortWithinPartitions("key")
    found = cold.select("key", "t1", "t2", "at", "n", "context").mapInArrow(
        _found(length, block_bytes), "t1 long, t2 long, a int, b int")
    counted = _counted(places.filter("context IS NULL").select("key", "k2", "t1", "t2", F.col("at")[0].alias("a"), "n", "w1", "w2"))
    runs = found.unionByName(counted).groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))

    shared = _named(docs, text_col).filter(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    shared = shared.filter("copies > 1").select("t1", "t2")
    part = texts.select("t1", "t2", "text").join(runs, ["t1", "t2"]).join(shared, ["t1", "t2"], "left_anti").mapInArrow(
        _removed(length), "t1 long, t2 long, spans array<struct<start:int,end:int>>, kept binary, kept_text string")
    whole = _whole(docs, text_col, shared)
    out = scratch.table(part.unionByName(whole), "repeated")
    scratch.drop(texts, places)
    return out


def _counted(strips: DataFrame) -> DataFrame:
    """Runs of repeated windows of hot anchors: strips found twice, and windows of the others found twice."""
    number = F.count(F.lit(1)).alias("c")
    again = strips.groupBy("key", "k2").agg(number).filter("c > 1").select("key", "k2")
    whole = strips.select("key", "k2", "t1", "t2", "a", "n").join(again, ["key", "k2"])
    whole = whole.select("t1", "t2", "a", (F.col("a") + F.col("n")).alias("b"))
    # one strip of each kind, with its windows, comes out of the grouping itself
    first = strips.groupBy("key", "k2").agg(number, F.min(F.struct("t1", "t2", "a", "w1", "w2")).alias("one"))
    single = first.select("one.t1", "one.t2", "one.a", (F.col("c") == 1).alias("alone"),
                          F.posexplode(F.arrays_zip("one.w1", "one.w2")).alias("i", "w"))
    single = single.select("t1", "t2", (F.col("a") + F.col("i")).alias("a"), "alone", F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    hits = single.filter("alone").join(twice, ["w1", "w2"]).select("t1", "t2", "a", (F.col("a") + 1).alias("b"))
    return whole.unionByName(hits)


def _whole(docs: DataFrame, text_col: str, shared: DataFrame) -> DataFrame:
    """Texts that occur more than once lose everything."""
    sizes = _named(docs, text_col).select("t1", "t2", F.octet_length("text").alias("size")).join(shared, ["t1", "t2"])
    sizes = sizes.groupBy("t1", "t2").agg(F.max("size").alias("size"))
    return sizes.select("t1", "t2", F.expr("array(named_struct('start', 0, 'end', size))").alias("spans"),
                        F.lit("").cast("binary").alias("kept"), F.lit("").alias("kept_text"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    gone = repeated(docs, text_col).select(
        "t1", "t2", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n"),
        F.size("spans").cast("long").alias("s"), F.sha2("kept", 256).alias("left"))
    out = rows.join(gone, ["t1", "t2"], "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("s", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("left", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """All rows of ``docs`` with all their columns, repeated strings of ``length`` bytes cut out of the text (in whole characters) and
    ``length_col``, where there is one, set to the new length. Texts without repeats stay as they are."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64(text_col).alias("t1"),
                       F.xxhash64(F.lit(1), text_col).alias("t2"))
    rows = rows.join(repeated(docs, text_col, length).select("t1", "t2", "kept_text"), ["t1", "t2"], "left")
    old, changed = F.col("_row").getField, F.col("kept_text").isNotNull()
    new = {text_col: F.coalesce("kept_text", old(text_col))}
    if length_col in names:
        new[length_col] = F.when(changed, F.char_length("kept_text").cast(docs.schema[length_col].dataType)).otherwise(old(length_col))
    return rows.select(*[new.get(c, old(c)).alias(c) for c in names])
