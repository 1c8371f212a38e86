"""Spelling variants: groups of words one edit apart, by dynamic programming over sorted lists.

Two words one edit apart, the shorter of m letters, agree before and after the place of the edit. The places 0..m are
cut into a few intervals; for an interval [lo, hi) both words have the first ``lo`` and the last ``m - hi`` letters in
common. These make the key of a block, and each pair meets in exactly one interval: that of the length of its common
prefix. A block's middles are a sorted list. Each shorter or equal word is matched against the list by a banded edit
matrix: a row of the matrix is computed once for a prefix that neighbours in the list share (the ranges between the
places where the longest common prefix of neighbours falls short), and a range whose prefix already exceeds one edit is skipped
whole. All words of a task take a step at the same time as NumPy arrays.

A block of more than ``max_block`` words is not scanned: its interval is halved and its words go to the smaller blocks
in the next round. An interval of one place leaves one free letter (two in the longer words), so its blocks are
bounded by the alphabet. The vocabulary is never in one place; a block is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.store import Scratch

MIN_LETTERS, MIN_COUNT = 6, 5
TIMES = 5  # a form is so many times as frequent
INTERVALS = 4
MAX_BLOCK = 4096
_CHUNK_CELLS = 4_000_000  # letters of the blocks that are taken together
_FRONT = 1_000_000  # (word, member) pairs that are taken together
_KEYS = ("m", "lo", "hi", "pre", "suf")
_FAR = 2  # two edits and more


def _neighbour_prefixes(letters: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before, -1 for the first of a block."""
    out = np.full(len(letters), -1, np.int32)
    if len(letters) > 1:
        same = letters[1:] == letters[:-1]
        prefix = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))
        out[1:] = np.where(block[1:] == block[:-1], prefix, -1)
    return out


def near_in_blocks(letters: np.ndarray, lengths: np.ndarray, block: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) of rows of one block at edit distance one, members as long as the query or one longer.

    ``letters`` holds the code points of the middles, 0 behind the end; rows are sorted by block, then middle.
    """
    n, width = letters.shape
    padded = np.concatenate([letters, np.zeros((n, 3), letters.dtype)], axis=1)
    shared = _neighbour_prefixes(letters, block)
    heads = np.flatnonzero(shared < 0)
    ends = np.append(heads[1:], n)
    own = np.searchsorted(heads, np.arange(n), side="right") - 1
    size = (ends - heads)[own[queries]]
    levels = []
    for d in range(width + 1):  # starts of the ranges with a common prefix of d + 1 letters, and how many lie before a row
        starts = np.flatnonzero(shared <= d)
        levels.append((np.append(starts, n), np.searchsorted(starts, np.arange(n + 1))))
    part = np.cumsum(size) // _FRONT
    for first, last in zip(np.searchsorted(part, np.unique(part)), np.searchsorted(part, np.unique(part), side="right")):
        q = queries[first:last]
        lo, hi = heads[own[q]], ends[own[q]]
        # entries (columns d - 1, d, d + 1) of the matrix row for the prefix of d letters
        a, b, c = np.full(len(q), _FAR, np.int8), np.zeros(len(q), np.int8), np.where(lengths[q] >= 1, 1, _FAR).astype(np.int8)
        for d in range(width + 1):
            if not len(q):
                break
            starts, before = levels[d]
            at, many = before[lo], before[hi] - before[lo]
            take = np.repeat(np.arange(len(q)), many)
            child = at[take] + np.arange(len(take)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi, q = starts[child], starts[child + 1], q[take]
            a, b, c = a[take], b[take], c[take]
            letter = padded[lo, d]
            size_q = lengths[q]
            over = letter == 0
            if over.any():
                gap = size_q[over] - d  # the column of the query's end, from the diagonal
                value = np.where(gap == 0, b[over], np.where(gap == -1, a[over], _FAR))
                hit = value == 1
                yield q[over][hit], lo[over][hit]
            go = ~over
            lo, hi, q, a, b, c, letter, size_q = lo[go], hi[go], q[go], a[go], b[go], c[go], letter[go], size_q[go]
            left = np.minimum(a + (padded[q, max(d - 1, 0)] != letter), b + 1) if d else np.minimum(b + 1, _FAR)
            left = np.where(d <= size_q, left, _FAR)
            middle = np.minimum(np.minimum(b + (padded[q, d] != letter), c + 1), left + 1)
            middle = np.where(d + 1 <= size_q, middle, _FAR)
            right = np.minimum(c + (padded[q, d + 1] != letter), middle + 1)
            right = np.where(d + 2 <= size_q, right, _FAR)
            live = np.minimum(np.minimum(left, middle), right) < _FAR
            lo, hi, q = lo[live], hi[live], q[live]
            a, b, c = (np.minimum(x[live], _FAR).astype(np.int8) for x in (left, middle, right))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(lengths.max(initial=0)))
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width), lengths


def _scan(rows: pa.Table) -> pa.RecordBatch:
    """Both directions of each pair of the blocks in ``rows``, sorted by key and middle."""
    m, lo, hi = (rows.column(k).to_numpy() for k in ("m", "lo", "hi"))
    pre, suf, mid = (rows.column(k).to_pylist() for k in ("pre", "suf", "mid"))
    change = np.zeros(len(m), np.int64)
    if len(m) > 1:
        change[1:] = [x != y for x, y in zip(zip(m[1:], lo[1:], hi[1:], pre[1:], suf[1:]), zip(m[:-1], lo[:-1], hi[:-1], pre[:-1], suf[:-1]))]
    block = np.cumsum(change)
    letters, lengths = _code_points(mid)
    short = lengths == np.minimum(hi, m) - lo  # the middle of a word of m letters
    found = [np.zeros((2, 0), np.int64)]
    for q, w in near_in_blocks(letters, lengths, block, np.flatnonzero(short)):
        longer = lengths[w] > lengths[q]
        if longer.any():
            # a query that is the beginning of the longer middle belongs to the next interval, if there is one
            same = letters[q] == letters[w]
            prefix = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))
            ours = ~longer | (lo[q] + prefix < hi[q])
            q, w, longer = q[ours], w[ours], longer[ours]
        found += [np.stack([q, w]), np.stack([w[longer], q[longer]])]
    one, other = np.concatenate(found, axis=1)
    words = [a + b + c for a, b, c in zip(pre, mid, suf)]
    n = rows.column("n").to_numpy()
    none = pa.nulls(len(one), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in one], pa.string()), pa.array(n[one], pa.int64()), pa.array([words[k] for k in other], pa.string()),
         pa.array(n[other], pa.int64()), none, none, none], names=["word", "n", "near", "near_n", "m", "lo", "hi"])


_PAIRS = "word string, n long, near string, near_n long, m int, lo int, hi int"


def _blocks(max_block: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the blocks; the words of large blocks come out again with ``near`` null and the interval."""
        held: list[pa.Table] = []
        for batch in batches:
            hot = pa.array((batch.column("c").to_numpy() > max_block) & (batch.column("hi").to_numpy() - batch.column("lo").to_numpy() > 1))
            big = batch.filter(hot)
            if len(big):
                none = pa.nulls(len(big), pa.string())
                words = [a + b + c for a, b, c in zip(*(big.column(k).to_pylist() for k in ("pre", "mid", "suf")))]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), big.column("n"), none, pa.nulls(len(big), pa.int64()),
                                                  *(big.column(k) for k in ("m", "lo", "hi"))], names=["word", "n", "near", "near_n", "m", "lo", "hi"])
            held.append(pa.Table.from_batches([batch.filter(pa.compute.invert(hot))]))
            table = pa.concat_tables(held)
            width = max(pa.compute.max(pa.compute.utf8_length(table.column("mid"))).as_py() or 0, 1)
            if len(table) * width >= _CHUNK_CELLS and (cut := _last_block(table)):
                yield _scan(table.slice(0, cut))
                table = table.slice(cut)
            held = [table]
        if held and len(held[0]):
            yield _scan(held[0])

    return scan


def _last_block(table: pa.Table) -> int:
    """The first row of the last block."""
    last = [table.column(k)[len(table) - 1].as_py() for k in _KEYS]
    at = len(table) - 1
    step = 1
    while at > 0:  # the block is at the end: go back over its rows by growing steps, then by halving
        back = max(0, at - step)
        if [table.column(k)[back].as_py() for k in _KEYS] == last:
            at, step = back, step * 2
            continue
        if step == 1:
            return at
        step = max(1, step // 2)
    return 0


def _intervals(words: DataFrame, places: str) -> DataFrame:
    """``words`` (word, n) laid out in the blocks of the intervals that the array of structs ``places`` names."""
    rows = words.select("word", "n", F.inline(F.expr(places)))
    return rows.select(
        "m", "lo", "hi", F.expr("left(word, lo)").alias("pre"), F.expr("right(word, greatest(m - hi, 0))").alias("suf"),
        F.expr("substring(word, lo + 1, length(word) - lo - greatest(m - hi, 0))").alias("mid"), "n")


def near_words(words: DataFrame, intervals: int = INTERVALS, max_block: int = MAX_BLOCK) -> DataFrame:
    """``(word, n, near, near_n)`` for both directions of every pair of words one inserted, deleted or replaced code point apart.

    ``words`` holds distinct words and their counts ``n``. Null and empty words have no neighbours here.
    """
    scratch = Scratch(words.sparkSession)
    first = f"""flatten(transform(array(0, 1), e -> transform(sequence(0, {intervals - 1}), j -> named_struct(
        'm', length(word) - e, 'lo', cast((length(word) - e + 1) * j div {intervals} AS int),
        'hi', cast((length(word) - e + 1) * (j + 1) div {intervals} AS int)))))"""
    rows = _intervals(words.filter("length(word) > 0"), first).filter("m > 0 AND lo < hi")
    found = None
    while True:
        whole = "PARTITION BY m, lo, hi, pre, suf ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        rows = rows.withColumn("c", F.expr(f"count(1) OVER ({whole})")).filter("c > 1")
        rows = rows.sortWithinPartitions(*_KEYS, "mid")
        out = scratch.table(rows.mapInArrow(_blocks(max_block), _PAIRS), "near")
        pairs = out.filter("near IS NOT NULL").select("word", "n", "near", "near_n")
        found = pairs if found is None else found.union(pairs)
        large = out.filter("near IS NULL")
        if large.isEmpty():
            return found
        halves = """array(named_struct('m', m, 'lo', lo, 'hi', (lo + hi) div 2), named_struct('m', m, 'lo', (lo + hi) div 2, 'hi', hi))"""
        halves = halves.replace("(lo + hi) div 2", "cast((lo + hi) div 2 AS int)")
        again = large.select("word", "n", F.expr(halves).alias("places"))
        rows = _intervals(again, "places")


def followed(forms: DataFrame) -> DataFrame:
    """``(word, root)``: from each word of ``forms`` (word, form) along the forms to the last. Each turn doubles the steps."""
    scratch = Scratch(forms.sparkSession)
    steps = scratch.table(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("then"))
        longer = scratch.table(steps.join(then, "root", "left").select("word", F.coalesce("then", "root").alias("root"),
                                                                      F.col("then").isNotNull().alias("moved")), "steps")
        scratch.drop(steps)
        steps = longer
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES, intervals: int = INTERVALS, max_block: int = MAX_BLOCK) -> DataFrame:
    """One row per word of ``words`` (distinct ``word``, count ``n``): ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one code point apart. The form is the most frequent of them, of equally frequent ones the
    smallest in code-point order, where it is ``times`` times as frequent as the word; else null. The root is the end
    of the chain of forms, the word itself where it has none. A null word is its own group; no rows give no rows.
    """
    near = near_words(words, intervals, max_block)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))
    out = words.join(best, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    out = Scratch(words.sparkSession).table(out.select(
        "word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    roots = followed(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def run_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None,
               min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of all texts, A-Z lower-cased, of at least ``min_letters`` code
    points and ``min_count`` occurrences.

    With ``slip``, a run loses a letter where the CRC-32 of ``<id>:<run>`` is a multiple of it (a null id is empty): the
    letter at that number modulo the run's length. Null texts have no runs. Counts combine on the map side.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(rf"([a-zÀ-ÿ]{{{min_letters},}})"), F.lit(1))).alias("word"))
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        less = F.expr("concat(left(word, cast(h % length(word) AS int)), substring(word, cast(h % length(word) AS int) + 2))")
        runs = runs.withColumn("word", F.when(F.col("h") % slip == 0, less).otherwise(F.col("word"))).filter(F.length("word") >= min_letters)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
