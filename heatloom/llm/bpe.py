"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern of the rank files is never run as a regular expression. Code points are mapped to classes by a table; what
the pattern looks ahead for (white space before a non-space, an apostrophe before s, t, re, ...) is folded into the
class. An automaton of eight states then says before which characters a piece starts. A stretch of text acts on the
states as a function, and such functions compose associatively: blocks are reduced to their functions side by side,
one scan over the blocks gives each block's first state, and a second pass marks the boundaries.

Pieces are slices of the text buffer. Equal pieces of a chunk are merged once, and merged pieces are cached per worker.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.arrays import chunks

CACHE_PIECES = 300_000
BLOCK = 256

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, BLANK, LAST_SPACE, LAST_BLANK, SHORT, LONG = range(8)  # classes; + 8 at the start of a text
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, JOINING, ONE_MORE, TWO_MORE = range(8)  # states


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a piece starts here', indexed by state * 16 + class."""
    after, starts = np.zeros(128, np.uint8), np.zeros(128, bool)
    for state in range(8):
        for cls in range(16):
            at_start, kind = cls >= 8, cls % 8
            s = FRESH if at_start else state
            if kind == LETTER:
                goes_on = s in (IN_LETTERS, JOINING, ONE_MORE, TWO_MORE)
                new = {ONE_MORE: FRESH, TWO_MORE: ONE_MORE}.get(s, IN_LETTERS)
            elif kind == NUMBER:
                goes_on, new = s in (IN_NUMBERS, JOINING), IN_NUMBERS
            elif kind in (OTHER, SHORT, LONG):
                goes_on = s in (IN_OTHER, JOINING)
                new = IN_OTHER if goes_on or kind == OTHER else ONE_MORE if kind == SHORT else TWO_MORE
            elif kind == BLANK:
                goes_on, new = s == IN_BLANKS, IN_BLANKS
            else:
                goes_on, new = False, JOINING if kind == LAST_SPACE else FRESH
            after[state * 16 + cls], starts[state * 16 + cls] = new, not goes_on
    return after, starts


_AFTER, _STARTS = _automaton()


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = BLANK
    return table


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = padded[at].astype(np.uint32)
    code = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        of = np.flatnonzero(lead >= low)
        if not len(of):
            break
        value = lead[of] & mask
        for k in range(1, size):
            value = (value << 6) | (padded[at[of] + k] & 0x3F)
        code[of] = value
    return np.minimum(code, 0x10FFFF), at


def _symbols(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each character with its look-ahead; ``first`` marks the first characters of texts."""
    cls = _classes()[code]
    ends = np.append(first[1:], True)
    blank = cls == BLANK
    before_solid = np.append(~blank[1:], False) & ~ends
    out = cls.copy()
    out[blank & before_solid] = LAST_BLANK
    out[blank & before_solid & (code == 0x20)] = LAST_SPACE
    quote = np.flatnonzero(code == 0x27)
    quote = quote[~ends[quote]]
    c1 = code[quote + 1]
    out[quote[np.isin(c1, [ord(c) for c in "stmd"])]] = SHORT
    two = quote[np.minimum(quote + 2, len(code) - 1) == quote + 2]
    two = two[~ends[two + 1]]
    a, b = code[two + 1], code[two + 2]
    hit = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    out[two[hit]] = LONG
    out[first] += 8
    return out


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Which characters start a piece, by scanning the transition functions of blocks."""
    n = len(symbols)
    count = -(-n // BLOCK)
    cells = np.zeros(count * BLOCK, np.uint8)
    cells[:n] = symbols
    cells = np.ascontiguousarray(cells.reshape(count, BLOCK).T)
    act = np.tile(np.arange(8, dtype=np.uint8), (count, 1))
    for row in cells:
        act = _AFTER[(act << 4) + row[:, None]]
    reach = 1
    while reach < count:  # act[i] becomes the function of blocks 0..i
        longer = act.copy()
        longer[reach:] = np.take_along_axis(act[reach:], act[:-reach].astype(np.intp), axis=1)
        act, reach = longer, 2 * reach
    state = np.zeros(count, np.uint8)
    state[1:] = act[:-1, FRESH]
    marks = np.zeros((BLOCK, count), bool)
    for k, row in enumerate(cells):
        index = (state << 4) + row
        marks[k] = _STARTS[index]
        state = _AFTER[index]
    return marks.T.reshape(-1)[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each piece starts, and for each text the number of its first piece."""
    code, at = _code_points(data)
    first = np.zeros(len(code), bool)
    heads = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])
    first[heads] = True
    begin = at[piece_starts(_symbols(code, first))]
    return begin, np.searchsorted(begin, offsets)


class Merger:
    """Rank table of one file with the cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for name, rank in self.ranks.items():
            names[rank] = name
        self.names = pa.array(names, pa.large_binary())
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        rank = ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges, n log n, through a heap of pairs over a linked list."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end of the part that starts at i; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0:
                r = ranks.get(piece[k:stop])
                if r is not None:
                    heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def ids(self, names: pa.Array) -> pa.ListArray:
        """Token ids of each piece."""
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        flat, at = [], [0]
        for name in names.to_pylist():
            got = cache.get(name)
            if got is None:
                got = self.merge(name)
                if len(name) <= 64:
                    cache[name] = got
            flat += got
            at.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def _encoder(path: str, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merger(path)
        sizes = pc.binary_length(table.names).to_numpy()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                begin, per_text = pieces(data, offsets)
                edges = np.append(begin, len(data)).astype(np.int32)
                slices = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
                coded = slices.dictionary_encode()
                found = table.ids(coded.dictionary).take(coded.indices)
                upto = found.offsets.to_numpy()[per_text].astype(np.int32)
                ids = found.flatten()
                columns = [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(upto), ids)]
                if with_offsets:
                    length = sizes[ids.to_numpy()]
                    place = np.cumsum(length) - length - np.repeat(offsets[:-1], np.diff(upto))
                    columns.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(place.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "offsets"][:len(columns)])

    return run


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (array of token ids) and on request ``offsets`` (byte of the text at which each token
    starts), a row for each row of ``docs``. ``ranks`` is the path of a rank file that every worker can read.

    A null or empty text has no ids. Special tokens are ordinary text. Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return rows.mapInArrow(_encoder(ranks, offsets), schema).withColumnRenamed("id", id_col)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = merger(path).names
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            ids = ids.fill_null([]) if ids.null_count else ids
            rows = max(1, int(100 * 10_000 // max(1, len(ids.flatten()) // max(1, len(ids)) + 1)))
            for lo in range(0, len(ids), rows):
                part = ids.slice(lo, rows)
                upto = part.offsets.to_numpy()
                joined = names.take(part.flatten())
                _, at, data = joined.buffers()
                at = np.frombuffer(at, np.int64)[joined.offset:joined.offset + len(joined) + 1]
                edges = at[upto - upto[0]]
                whole = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(edges)), data])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, rows) for c in batch.columns), whole.cast(pa.binary())],
                    names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded``, the bytes that the ids stand for; null ids decode to no bytes."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_decoder(ranks), f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens, and SHA-256 of the ids (decimal, joined by a blank) and of the decoded bytes."""
    rows = decode(encode(docs, ranks, id_col, text_col), ranks, id_col)
    return rows.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
