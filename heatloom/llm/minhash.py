"""Near-duplicate documents by tensored MinHash banding.

Instead of one collection of band keys per table, two small collections of half keys are computed, and table (i, j) is
keyed by the pair of half key i of the first and half key j of the second collection: ``HALVES ** 2`` tables of
``2 * ROWS`` hashes come from ``2 * HALVES * ROWS`` minimum hashes. Every candidate is checked on the full sets.

Scale: equal sets are grouped first, so copies never meet as pairs. Half keys that occur once are dropped. In the tables
(i, i) candidates are met through a pivot, the member with most company; that joins most copies. Of the other tables only the
half keys that still hold several components are looked at, and a pair meets under its first common half key of the first
collection if it has one in the second too: a table is a condition there, not rows. Members of the largest component of a half
key are not compared with each other. A bitmap of each set bounds the similarity of a pair from above, which clears
most false candidates before any text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatloom.llm.arrays import FOLD, U64, chunks, mix, seeded, signed, slice_hashes, window_hashes, words
from heatloom.llm.components import components
from heatloom.llm.store import Scratch, checkpointed

WIDTH = 5
PERCENT = 75
ROWS = 3  # hashes in a half key
HALVES = 16  # half keys in each of the two collections
BITMAP_WORDS = 16  # 64-bit words of the bitmap that bounds similarities

_MULT = seeded(2 * HALVES * ROWS, 101)
_FLIP = seeded(2 * HALVES * ROWS, 202)
_JOIN = seeded(ROWS, 303)
_SLOT = seeded(2 * HALVES, 404)
_BLOCK = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text shorter than a shingle is one shingle."""
    data = FOLD[data]
    starts, ends, at = words(data, offsets)
    h = slice_hashes(data, starts, ends)
    grams = window_hashes(h, width)
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= width:
            yield np.unique(grams[lo:hi - width + 1])
        elif hi > lo:
            yield window_hashes(h[lo:hi], int(hi - lo)) + U64(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def half_keys(items: np.ndarray) -> np.ndarray:
    """The two collections of half keys of one set."""
    low = np.full(len(_MULT), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), _BLOCK):
        block = (items[None, k:k + _BLOCK] ^ _FLIP[:, None]) * _MULT[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    groups = (mix(low).reshape(2 * HALVES, ROWS) * _JOIN[None, :]).sum(axis=1, dtype=np.uint64)
    return mix(groups + _SLOT)


def bitmap(items: np.ndarray) -> np.ndarray:
    """One bit for each item, at a place given by its hash."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[(mix(items ^ U64(0x2545F4914F6CDD1D)) % U64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


_SKETCH = "id {}, n long, f1 long, f2 long, halves array<long>, bits array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in chunks(batch.column(1)):
            n, f1, f2, halves, bits = [], [], [], [], []
            for items in shingle_sets(data, offsets):
                n.append(len(items))
                f1.append(int(mix(items ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(items ^ U64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                halves.append(half_keys(items) if len(items) else np.zeros(0, np.uint64))
                bits.append(bitmap(items))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 _lists(halves), _lists(bits)], names=["id", "n", "f1", "f2", "halves", "bits"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.concatenate(arrays))))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        pairs = zip(chunks(batch.column(2), 1), chunks(batch.column(3), 1))
        last, a = None, None
        for (_, _, left, left_at), (_, _, right, right_at) in pairs:
            if last is None or len(last) != len(left) or not np.array_equal(last, left):
                last, a = left, next(shingle_sets(left, left_at))
            b = next(shingle_sets(right, right_at))
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(common) and 100 * common >= PERCENT * (len(a) + len(b) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _near_sizes(a: str, b: str) -> F.Column:
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def _can_link(n_a: str, bits_a: str, n_b: str, bits_b: str) -> F.Column:
    """Whether the bitmaps allow the similarity: an item whose bit the other set lacks is not in the other set."""
    alone = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x & ~y)), 0, (s, c) -> s + c)"
    most = f"least({n_a} - {alone.format(bits_a, bits_b)}, {n_b} - {alone.format(bits_b, bits_a)})"
    return F.expr(f"(100 + {PERCENT}) * {most} >= {PERCENT} * ({n_a} + {n_b})")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, id_type: T.DataType) -> DataFrame:
    """Checked links among candidate pairs ``(a, b)``."""
    for end in "ab":
        side = reps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = pairs.join(side, end)
    pairs = pairs.filter(_can_link("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    schema = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)])
    return rows.mapInArrow(_verify, schema)


def _halves(reps: DataFrame) -> DataFrame:
    """``(id, n, slot, half)`` of the half keys that two sets or more have; ids without one in both collections are left out."""
    halves = reps.select("id", "n", F.posexplode("halves").alias("slot", "half"))
    live = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    own = halves.join(live, "half").groupBy("id", "n").agg(F.collect_list(F.struct("slot", "half")).alias("hs"))
    both = F.exists("hs", lambda x: x.slot < HALVES) & F.exists("hs", lambda x: x.slot >= HALVES)
    return own.filter(both).select("id", "n", F.inline("hs"))


def _diagonal(halves: DataFrame) -> DataFrame:
    """Buckets ``(key, id, n, c)`` of the tables (i, i) with the number ``c`` of their members, two at least."""
    pairs = halves.groupBy("id", "n", (F.col("slot") % HALVES).alias("i")).agg(
        F.min(F.struct("slot", "half")).alias("p"), F.max(F.struct("slot", "half")).alias("q"))
    rows = pairs.filter("p.slot < q.slot").select(F.xxhash64("p.half", "q.half").alias("key"), "id", "n")
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "key")


def _by_pivot(buckets: DataFrame, order: F.Column) -> DataFrame:
    """Candidate pairs of each bucket's pivot with the members outside its component."""
    pivots = buckets.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id"), F.col("n"), F.col("comp"))).alias("p"))
    rows = buckets.join(pivots, "key").filter("comp <> p.comp").filter(_near_sizes("n", "p.n"))
    return rows.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _open_halves(halves: DataFrame, labels: DataFrame) -> DataFrame:
    """``halves`` of half keys that still hold several components, with the component of each member and that with most
    members of the half key, ``most``. Components only grow, so a half key that is left out stays out."""
    named = halves.select("half", "slot", "id", "n").join(labels, halves["id"] == labels["node"], "left").select(
        "half", "slot", "id", "n", F.coalesce("root", "id").alias("comp"))
    each = named.groupBy("half", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = each.groupBy("half").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return named.join(several.select("half", F.col("m.comp").alias("most")), "half")


def _meeting(open_: DataFrame) -> DataFrame:
    """Open half keys of the first collection, of members that have one in the second too.

    A pair meets in a table (i, j) only if it meets under both half keys, so the tables are never laid out: their members are
    found from 16 rows a set instead of 256.
    """
    other = open_.filter(f"slot >= {HALVES}").select("id").distinct()
    return open_.filter(f"slot < {HALVES}").join(other, "id", "left_semi")


def _strays(open_: DataFrame) -> DataFrame:
    return open_.filter("comp <> most")


def _open_pivots(open_: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs of a pivot of the largest component of each half key with the members of the others."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), F.col("id"), F.col("n"))
    pivots = open_.filter("comp = most").groupBy("half").agg(F.min(order).alias("p"))
    rows = _strays(open_).join(pivots, "half").filter(_near_sizes("n", "p.n"))
    return rows.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _cross_pairs(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of members in different components that share a table, each once: under their first common half key. One end is
    outside the largest component of that half key, so its members are not compared with each other. The bitmaps are
    compared inside the join, so only pairs that can be links leave it."""
    rows = open_.join(reps.select("id", "bits", "halves"), "id")
    a = _strays(rows).select("half", "slot", *[F.col(c).alias(f"{d}a") for c, d in (("id", ""), ("n", "n"), ("comp", "c"), ("halves", "h"), ("bits", "b"))])
    b = rows.select(F.col("half").alias("half_b"), "most", *[F.col(c).alias(f"{d}b") for c, d in (("id", ""), ("n", "n"), ("comp", "c"), ("halves", "h"), ("bits", "b"))])
    same = "array_position(zip_with(slice(ha, {0}, {1}), slice(hb, {0}, {1}), (x, y) -> x = y), true)"
    table = F.expr(f"{same.format(1, HALVES)} = slot + 1 AND {same.format(HALVES + 1, HALVES)} > 0")
    near = F.expr(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    once = F.expr("ca <> cb AND (cb = most OR a < b)")
    met = a.join(b, (F.col("half") == F.col("half_b")) & once & near & table & _can_link("na", "ba", "nb", "bb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _cross_count(open_: DataFrame) -> int:
    """Comparisons that ``_cross_pairs`` would make."""
    each = open_.groupBy("half").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("comp") != F.col("most")).alias("s"))
    return int(each.agg(F.sum(F.col("c") * F.col("s"))).first()[0] or 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pivot_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest id reachable over links of
    at least 75 percent Jaccard similarity of word 5-grams) and ``kept`` (the row has that smallest id).

    Null and empty texts and texts without a word have an empty set and are linked with nothing. A text of fewer than
    five words is one shingle. Rows that share an id count as one document with several texts. A row without an id is
    kept and has no component. Other columns of ``docs`` are not looked at. A pair at exactly 0.75 is missed with
    probability about 3e-4, at 0.8 about 2e-5; no candidate, bucket or group is capped.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    sketch = scratch.table(rows.mapInArrow(_sketch, _SKETCH.format(id_type.simpleString())), "sketch")
    sets = sketch.filter("n > 0 AND id IS NOT NULL")
    reps = sets.groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.first("halves").alias("halves"), F.first("bits").alias("bits"))

    groups = reps.select("n", "f1", "f2", "id")
    halves = scratch.table(_halves(reps), "halves")
    met = halves.select("id").distinct()
    texts = scratch.table(rows.join(met, "id", "left_semi").distinct(), "texts")
    reps = scratch.table(reps.join(met, "id", "left_semi").select("id", "n", "bits", "halves"), "sets")

    buckets = scratch.table(_diagonal(halves), "buckets")
    rank = scratch.table(buckets.groupBy("id").agg((-F.sum("c")).alias("rank")), "rank")
    pairs = _by_pivot(buckets.join(rank, "id").withColumn("comp", F.col("id")), F.col("rank"))
    links = checkpointed(_links(pairs, reps, texts, id_type))
    scratch.drop(buckets, rank)
    for turn in range(1, pivot_rounds + 2):
        labels = checkpointed(components(links, turns=1))  # enough to leave out most pairs
        open_ = scratch.table(_open_halves(halves, labels), "open")
        scratch.drop(halves)
        halves = open_
        rows_met = scratch.table(_meeting(open_), "meeting")
        size = rows_met.count()
        last = turn > pivot_rounds or (size > 0 and _cross_count(rows_met) <= 8 * size)
        if size:
            pairs = _cross_pairs(rows_met, reps) if last else _open_pivots(rows_met, turn)
            links = checkpointed(links.union(_links(pairs, reps, texts, id_type)))
        scratch.drop(rows_met)
        if last or not size:
            break
    labels = checkpointed(components(links))

    # equal sets share the smallest id of the group; a repeated id ties its texts together
    named = sets.select("id", "n", "f1", "f2").join(
        groups.select("n", "f1", "f2", F.col("id").alias("rep")), ["n", "f1", "f2"]).select("id", "rep")
    named = named.join(labels, named["rep"] == labels["node"], "left").select(
        "id", F.coalesce("root", "rep").alias("root")).distinct()
    ties = named.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    ties = checkpointed(ties)
    split = ties.filter("lo <> hi OR lo > id")
    if not split.isEmpty():
        more = named.select(F.col("id").alias("u"), F.col("root").alias("v"))
        labels = checkpointed(components(more))
        ties = labels.select(F.col("node").alias("id"), F.col("root").alias("lo"))
    sizes = checkpointed(sketch.select("id", "n"))
    scratch.drop()
    out = sizes.join(ties.select("id", "lo"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("lo", "id").alias("component_id"),
                      F.col("id").eqNullSafe(F.coalesce("lo", "id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller id; of repeated ids one row stays.
    Rows without an id stay."""
    flags = near_duplicates(docs, id_col, text_col)
    kept = flags.filter(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull())).select(*docs.columns)
