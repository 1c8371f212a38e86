"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from heatloom.llm import bpe
from heatloom.llm.arrays import chunks

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "Zx", "é", "ß", "中文", "1", "٣", "²", " ", "  ", "\n", "\t", " ", "　", "'", "''", "'s", "'re", "'ll",
         "'v", "'d", "'T", "!", "...", "😀", "\x1c", "\x85", "\r\n", "don't", "hello", "_", "'lll", "x" * 70, "́"]
FIXED = ["", " ", "'s", "a's's", "a 's", "a\n's", "''s", "  a", " \n a", "a  ", "a \n", "'", "ab'r", "ab're", "'l", "'ll", "\n\n", "<|endoftext|>"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    rows = [r for out in bpe._encoder(RANKS, True)([batch]) for r in out.to_pylist()]
    return [r["ids"] for r in rows], [r["offsets"] for r in rows]


def random_texts(n=3000, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_ids_equal_the_library():
    enc = library()
    texts = FIXED + random_texts() + ["x" * 5000, " " * 700, "ab1 " * 2000]
    ids, offsets = run(texts)
    for text, got, at in zip(texts, ids, offsets):
        assert got == enc.encode_ordinary(text), repr(text)
        sizes = [len(enc.decode_single_token_bytes(i)) for i in got]
        assert at == [sum(sizes[:k]) for k in range(len(sizes))] or len(sizes) > 200


def test_every_character_class():
    enc = library()
    texts = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{t}b {t}1{t}" for t in texts]
    assert run(texts)[0] == [enc.encode_ordinary(t) for t in texts]


def test_long_merge_equals_short_merge():
    table = bpe.merger(RANKS)
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshrdl") for _ in range(rng.randrange(2, 40))).encode()
        if word not in table.ranks:
            assert table._merge_long(word) == table.merge(word)


def test_chunks_cut_between_texts():
    column = pa.array(["ab", None, "", "cde" * 50, "f"], pa.string())
    got = [(lo, hi, bytes(d), list(o)) for lo, hi, d, o in chunks(column, 10)]
    assert got == [(0, 3, b"ab", [0, 2, 2, 2]), (3, 4, b"cde" * 50, [0, 150]), (4, 5, b"f", [0, 1])]


@pytest.mark.parametrize("extra", [False, True])
def test_query_round_trip(spark, extra):
    texts = [None, "", *FIXED, *random_texts(50), FIXED[3]]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.selectExpr("doc_id", "text", "text AS ids", "doc_id AS id", "'x' AS decoded", "text AS offsets")
    enc = library()
    got = {r.doc_id: r for r in bpe.digests(docs, RANKS).collect()}
    assert len(got) == len(texts)
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS).collect() == []
