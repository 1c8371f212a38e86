"""Repeated strings against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from heatloom.llm import repeats
from heatloom.llm.arrays import BYTE_VALUES, window_hashes
from heatloom.llm.runindex import RunIndex
from heatloom.llm.windows import GRAM, anchors, cuts


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def matches(text):
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    best = [0] * n
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        best[a], best[b] = max(best[a], k), max(best[b], k)
    return best


def test_matching_statistics():
    rng = random.Random(1)
    for trial in range(200):
        letters = b"a" if trial % 5 == 0 else b"ab" if trial % 2 else b"abcdefg\xff"
        text = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 150))) * rng.randrange(1, 4)
        index = RunIndex(np.frombuffer(text, np.uint8))
        assert list(index.matching_statistics()) == matches(text)
        assert index.lengths.sum() == len(text)


def test_anchor_of_every_window():
    rng = random.Random(2)
    for trial in range(12):
        text = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(400, 1200))) if trial % 4 else b"x" * 900
        data = np.frombuffer((text[:130] * 9)[:len(text)] if trial % 5 == 0 else text, np.uint8)
        grams = window_hashes(BYTE_VALUES[data], GRAM)
        place, _, first = anchors(data, 400)
        each = np.repeat(place, cuts(first, len(data) - 399))
        width = 400 - GRAM + 1
        assert list(each) == [s + int(np.argmin(grams[s:s + width])) for s in range(len(data) - 399)]


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinéß") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(120), prose(300)
    texts = [None, "", "short", "x" * 399, "x" * 400, "y" * 1500, prose(200), passage, prose(30) + passage + prose(40)]
    texts += [prose(20) + passage[100:560] + prose(5) for _ in range(6)]
    texts += [other, other, other[:900] + "!" + other[901:], other[:500] + prose(3) + other[480:]]
    texts += [passage * 3, "z" * 380 + "q" + "z" * 380, passage[:399], passage[:400], passage[1:401]]
    near = list(prose(400))
    for _ in range(25):
        copy = list(near)
        for _ in range(6):
            copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


def got(spark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("doc_id", "text", "1 AS t1", "'a' AS key", "text AS kept")
    before = repeats.repeated
    repeats.repeated = lambda d, c="text": before(d, c, **limits)
    try:
        return [tuple(r)[1:] for r in sorted(repeats.digests(docs).collect())]
    finally:
        repeats.repeated = before


def test_all_windows(spark):
    texts = sample()
    assert got(spark, texts) == brute(texts)


def test_hot_anchors_and_small_blocks(spark):
    texts = sample()
    assert got(spark, texts, hot=4, block_bytes=2000) == brute(texts)
    assert got(spark, texts, hot=0) == brute(texts)


def test_empty_table_and_text_form(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert repeats.digests(docs).collect() == []
    assert repeats.without_repeats(docs).collect() == []
    body = "é" * 300
    rows = [(1, "a" + body, 301), (2, "bb" + body, 302), (3, None, 0), (4, "keep", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in repeats.without_repeats(docs).collect()}
    assert out == {1: ("a", 1), 2: ("bb", 2), 3: (None, 0), 4: ("keep", 99)}
