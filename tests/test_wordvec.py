"""Word vectors against plain NumPy and on a corpus with planted kinships."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.operators import wordvec


def digest(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def plain(docs, size, window, negatives, min_count, updates, rate):
    count = Counter(w for d in docs for w in d)
    terms = sorted((w for w in count if count[w] >= min_count), key=lambda w: w.encode())
    ids, owner = {}, []
    for w in terms:
        ids[w] = len(owner)
        owner += [ids[w]] * max(1, math.floor(count[w] ** 0.75 + 0.5))
    pairs = Counter()
    for d in docs:
        for i in range(len(d)):
            for j in range(i + 1, min(i + window, len(d) - 1) + 1):
                if d[i] in ids and d[j] in ids:
                    pairs[ids[d[i]], ids[d[j]]] += 1
                    pairs[ids[d[j]], ids[d[i]]] += 1
    examples = Counter({(a, b, 1): n for (a, b), n in pairs.items()})
    for (a, b), n in pairs.items():
        for j in range(1, negatives + 1):
            other = owner[digest(f"{a}:{b}:{j}", 15) % len(owner)]
            if other != b:
                examples[a, other, 0] += n
    u = {ids[w]: np.array([(digest(f"{w}:{i}", 8) / 2 ** 32 - 0.5) / size for i in range(1, size + 1)]) for w in terms}
    v = {i: np.zeros(size) for i in u}
    for step in range(updates):
        length = rate * (1 - step / updates)
        gu, gv, nu, nv = ({i: np.zeros(size) for i in u}, {i: np.zeros(size) for i in u}, Counter(), Counter())
        for (a, b, label), n in examples.items():
            g = n * (label - 1 / (1 + math.exp(-u[a] @ v[b])))
            gu[a], gv[b] = gu[a] + g * v[b], gv[b] + g * u[a]
            nu[a] += n
            nv[b] += n
        u = {i: x + length * gu[i] / nu[i] if nu[i] else x for i, x in u.items()}
        v = {i: x + length * gv[i] / nv[i] if nv[i] else x for i, x in v.items()}
    return {w: u[ids[w]] for w in terms}


def frame(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, words array<string>").repartition(3)


@pytest.mark.parametrize("shards", [1, 3])
def test_updates_equal_a_plain_loop(spark, shards):
    rng = random.Random(4)
    docs = [[rng.choice("abcdefghé") for _ in range(rng.randrange(0, 12))] for _ in range(30)] + [["rare"], ["a", "a", "a"]]
    fitted = wordvec.fit_word_vectors(frame(spark, docs), 6, 2, 3, 2, 3, 4.0, shards)
    got = {r["term"]: r["v"] for r in fitted.table().collect()}
    want = plain(docs, 6, 2, 3, 2, 3, 4.0)
    assert set(got) == set(want)
    for term, vector in want.items():
        assert got[term] == pytest.approx(vector.tolist(), abs=1e-9)


def test_given_shards_do_not_make_cells_without_bound(spark, monkeypatch):
    """a given number of shards is the least; pairs and terms may need more."""
    rng = random.Random(4)
    docs = [[rng.choice("abcdefghé") for _ in range(rng.randrange(0, 12))] for _ in range(30)]
    monkeypatch.setattr(wordvec, "CELL_PAIRS", 10)
    fitted = wordvec.fit_word_vectors(frame(spark, docs), 6, 2, 3, 2, 3, 4.0, shards=1)
    assert fitted.shards ** 2 * 10 >= fitted.pairs > 10
    got, want = {r["term"]: r["v"] for r in fitted.table().collect()}, plain(docs, 6, 2, 3, 2, 3, 4.0)
    assert all(got[t] == pytest.approx(v.tolist(), abs=1e-9) for t, v in want.items()) and set(got) == set(want)
    monkeypatch.setattr(wordvec, "SHARD_VALUES", 12)
    assert wordvec.fit_word_vectors(frame(spark, docs), 6, 2, 3, 2, 1, 4.0, shards=1).shards == 5


def test_words_of_one_theme_come_near(spark):
    rng = random.Random(9)
    themes = [[f"{t}{i}" for i in range(8)] for t in "xyz"]
    docs = [[rng.choice(themes[n % 3]) for _ in range(12)] for n in range(240)]
    fitted = wordvec.fit_word_vectors(frame(spark, docs), 16, 3, 3, 1)
    v = {r["term"]: np.array(r["v"]) / np.linalg.norm(r["v"]) for r in fitted.table().collect()}
    for term in v:
        near = sorted((w for w in v if w != term), key=lambda w: -(v[w] @ v[term]))[:5]
        assert all(w[0] == term[0] for w in near), (term, near)


def test_awkward_documents(spark):
    docs = [None, [], [None, "a", None, "b"], ["a"], ["a", "b"], ["lonely"]]
    rows = frame(spark, docs).withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("id", F.lit(3))
    got = {r["term"]: r["v"] for r in wordvec.fit_word_vectors(rows, 4, 2, 2, 1, 2).table().collect()}
    want = plain([[w for w in d or [] if w] for d in docs], 4, 2, 2, 1, 2, wordvec.RATE)
    assert set(got) == {"a", "b", "lonely"}
    assert all(got[w] == pytest.approx(want[w].tolist(), abs=1e-9) for w in want)
    for empty in (rows.limit(0), rows.filter("doc_id < 2")):
        assert wordvec.fit_word_vectors(empty, 4, updates=1).table().count() == 0
