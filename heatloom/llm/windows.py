"""Content-defined sampling of byte windows.

Every window of ``length`` bytes holds ``length - GRAM + 1`` grams of GRAM bytes; the leftmost gram with the smallest
hash is the window's anchor. Equal windows have equal anchors at equal places, so windows can only be equal if their
anchors are, and there are far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np

from heatloom.llm.arrays import BYTE_VALUES, window_hashes

GRAM = 128
_MAX = np.iinfo(np.uint64).max


def sliding(v: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of each run of ``w`` values, from running values of blocks of ``w``."""
    n = len(v)
    count = -(-n // w)
    pad = np.full(count * w, fill, np.uint64)
    pad[:n] = v
    ahead = best.accumulate(pad.reshape(count, w), axis=1).reshape(-1)
    back = best.accumulate(pad.reshape(count, w)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one text of at least ``length`` bytes: places and hashes of its anchors, and the first window of each.

    The windows from ``first[i]`` up to ``first[i + 1]`` (the last: up to the last window) have anchor i.
    """
    grams = window_hashes(BYTE_VALUES[data], GRAM)
    w = length - GRAM + 1
    low = sliding(grams, w, np.minimum, _MAX)
    n = len(low)
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (grams[:n - 1] == low[:-1])  # a smaller one came in, or the anchor went out
    first = np.flatnonzero(change)
    padded = np.zeros(n + 2 * (w - 1), np.uint64)
    padded[w - 1:w - 1 + n] = low
    places = np.flatnonzero(sliding(padded, w, np.maximum, 0) == grams)
    want = low[first]
    at = np.searchsorted(places, first)
    left = np.flatnonzero(grams[places[at]] != want)
    while len(left):
        at[left] += 1
        left = left[grams[places[at[left]]] != want[left]]
    place = places[at]
    return place, want, first


def cuts(first: np.ndarray, windows: int) -> np.ndarray:
    """Number of windows of each anchor."""
    return np.diff(np.append(first, windows))
