"""Spelling variants against brute force, SQL and awkward rows."""

import random

import pytest

from heatloom.llm import variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def vocabulary(rng, n):
    out = {"".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 9))) for _ in range(n)}
    out |= {"a" * k for k in range(1, 30)} | {"a" * k + "b" + "a" * (12 - k) for k in range(13)}
    out |= {"long" * 5_000, "long" * 5_000 + "x", "lonk" + "long" * 4_999, "prefixprefix" + "q", "prefixprefix"}
    return sorted(out)


@pytest.mark.parametrize("intervals, max_block", [(1, 4096), (2, 5), (4, 3), (4, 4096), (9, 2)])
def test_near_words(spark, intervals, max_block):
    words = vocabulary(random.Random(intervals), 500)
    rows = [(w, k + 1) for k, w in enumerate(words)]
    want = sorted((a, n, b, m) for a, n in rows for b, m in rows if abs(len(a) - len(b)) < 2 and one_apart(a, b))
    frame = spark.createDataFrame([*rows, ("", 3), (None, 4)], "word string, n long").repartition(5)
    got = sorted(tuple(r) for r in variants.near_words(frame, intervals, max_block).collect())
    assert got == want and len(got) > 1000


def test_blocks_are_cut_between_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(variants, "_CHUNK_CELLS", 40)
    words = sorted({"".join(random.Random(k).choice("ab") for _ in range(3)) for k in range(60)})
    rows = [(6, 3, 6, p, "", w, 1, len(words)) for p in ("aaa", "aab", "aba") for w in words]
    names = ["m", "lo", "hi", "pre", "suf", "mid", "n", "c"]
    types = [pa.int32()] * 3 + [pa.string()] * 3 + [pa.int64()] * 2
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    pairs = lambda batches: sorted((a, b) for out in variants._blocks(4096)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(2).to_pylist()))
    want = sorted((p + a, p + b) for p in ("aaa", "aab", "aba") for a in words for b in words if one_apart(a, b))
    for size in (1, 3, 7, len(rows)):
        assert pairs([whole.slice(k, size) for k in range(0, len(rows), size)]) == want


def test_roots(spark):
    forms = [(f"w{k:02}", f"w{k + 1:02}") for k in range(37)] + [("x", "w36"), ("y", "z")]
    got = dict(tuple(r) for r in variants.followed(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {f"w{k:02}": "w37" for k in range(37)} | {"x": "w37", "y": "z"}
    assert variants.followed(spark.createDataFrame([], "word string, form string")).collect() == []


def awkward_documents():
    rng = random.Random(6)
    words = [["straße", "strasse", "Straßen"], ["colour", "colours", "color", "colorx"], ["naïveté", "naivete", "Naïveté"],
             ["abcdef", "abcdeg", "abcdefg", "bcdefg"], ["ÀÉÎÕÜÿ", "àÉÎÕÜÿ", "×÷×÷×÷"], ["a" * 3000, "a" * 3001, "a" * 2999 + "b"]]
    texts = [None, "", " \n", "short", "x" * 20_000, "no-words 1234567 \x00 ab\x01cd", "abcdef" * 300, "Ąbcdefg ąbcdef"]
    for group in words:
        for k, w in enumerate(group):
            texts += [" ".join([w] * (5 if k % 2 else 40)), f"{w}1{w.upper()}_{w}" * 2]
    syllables = ["ba", "ra", "to", "én", "li"]
    texts += [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))) for _ in range(400)) for _ in range(60)]
    for base in ("barrato", "énliraba", "torabali", "liénlien"):
        texts += [" ".join([base] * 700), " ".join([base + "q"] * 60), " ".join([base[1:]] * 30), " ".join([base[:3] + "z" + base[4:]] * 9),
                  " ".join([base + "qq"] * 8), " ".join([base + "w"] * 60)]
    rows = [(k * 7 if k % 9 else None, t, "en", "s", 1) for k, t in enumerate(texts)]
    return rows + rows[10:20] + rows[:3]


def test_awkward_documents(spark, both):
    frame = spark.createDataFrame(awkward_documents(), SCHEMA).repartition(5).selectExpr(
        "*", "text AS word", "1 AS n", "doc_id AS id", "'f' AS form", "2 AS h", "text AS near", "3 AS m", "'c' AS c", "text AS root")
    got, want = both("op13_spelling_variants", documents=frame)
    assert got == want and len(got[1]) > 300
    assert sum(r[got[0].index("form")] != "None" for r in got[1]) > 15


def test_no_documents(spark, both):
    got, want = both("op13_spelling_variants", documents=spark.createDataFrame([], SCHEMA))
    assert got == want
