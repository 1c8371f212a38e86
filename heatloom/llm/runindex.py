"""A run-length index of a block of text: run-compressed Burrows-Wheeler transform with sampled run ends.

Only the suffixes at the two ends of each run of the transform are sampled, with the length of the match to the
neighbouring suffix. Inside a run the match of the next place in the text is one shorter (the reducible case), so the
matching statistics of every place are streamed from the samples in text order. In a repetitive block there are far
fewer runs than places.
"""

from __future__ import annotations

import numpy as np

MOST = 1 << 21  # places in a block: three ranks or places are packed into 63 bits


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix; one that is the beginning of another comes first."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    if n > MOST:
        raise ValueError(f"a block of {n} bytes is too large for one index")
    used = np.unique(text)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    width = int(len(used) + 1).bit_length()
    depth = (63 - bits) // width
    letters = np.zeros(n + depth, np.uint64)
    letters[:n] = code[text]
    key = letters[:n].copy()
    for k in range(1, depth):
        key = (key << np.uint64(width)) | letters[k:k + n]
    key = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    low = np.uint64((1 << bits) - 1)
    place = (key & low).astype(np.int64)
    rank = np.zeros(n, np.int64)
    _number(rank, place, key >> np.uint64(bits), np.zeros(n, np.int64), np.zeros(n, np.int64))
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return rank
        after = np.where(open_ + depth < n, rank[np.minimum(open_ + depth, n - 1)] + 1, 0)  # 0: the text ends there
        key = np.sort((((rank[open_].astype(np.uint64) << np.uint64(bits)) | after.astype(np.uint64)) << np.uint64(bits))
                      | open_.astype(np.uint64))
        place = (key & low).astype(np.int64)
        group = (key >> np.uint64(2 * bits)).astype(np.int64)
        heads = np.ones(len(key), bool)
        heads[1:] = group[1:] != group[:-1]
        begin = np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))
        _number(rank, place, key >> np.uint64(bits), group, begin)
        depth *= 2


def _number(rank: np.ndarray, place: np.ndarray, key: np.ndarray, base: np.ndarray, begin: np.ndarray) -> None:
    """Rank of sorted places: the base of their group and the place in it of the first entry with an equal key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    rank[place] = base + at - begin


def _match_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = text
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight[:n] = (eight[:n] << np.uint64(8)) | wide[k:k + n]
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = eight[np.minimum(a[live] + length[live], n)] ^ eight[np.minimum(b[live] + length[live], n)]
        same = (x == 0) & (np.maximum(a[live], b[live]) + length[live] < n)
        odd, y = live[~same], x[~same]
        for step, mask in ((4, 32), (2, 48), (1, 56)):
            head = (y >> np.uint64(mask)) == 0
            if step < 4:
                head = (y >> np.uint64(64 - 8 * step)) == 0
            length[odd[head]] += step
            y = np.where(head, y << np.uint64(8 * step), y)
        live = live[same]
        length[live] += 8
    return np.minimum(length, n - np.maximum(a, b))


class RunIndex:
    """Runs of the transform of ``text`` and their sampled ends."""

    def __init__(self, text: np.ndarray):
        rank = suffix_ranks(text)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        last = text[order - 1]
        head = np.ones(len(text) + 1, bool)
        head[1:-1] = last[1:] != last[:-1]
        head[[rank[0], rank[0] + 1]] = True  # nothing stands before the whole text: a run of its own
        head = head[:-1]
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(text)) - 1
        self.size = len(text)
        self.letters = last[starts]
        self.lengths = stops - starts + 1
        self.first, self.last = order[starts], order[stops]  # the sampled ends
        self.up = np.zeros(len(starts), np.int64)
        self.down = np.zeros(len(starts), np.int64)
        between = _match_lengths(text, order[stops[:-1]], order[starts[1:]])
        self.up[1:], self.down[:-1] = between, between

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of the longest string that starts there and somewhere else too."""
        return np.maximum(self._stream(self.first, self.up), self._stream(self.last, self.down))

    def _stream(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.zeros(self.size, np.int64)
        value = np.zeros(self.size, np.int64)
        at[places], value[places] = places, values
        at = np.maximum.accumulate(at)
        return np.maximum(value[at] - (np.arange(self.size) - at), 0)
