"""The pipeline against a plain version of its stages."""

import base64
import hashlib
from collections import Counter

import duckdb
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from heatloom.llm.near_queries import NEAR_SQL
from heatloom.llm.quality_queries import JUDGED_SQL

ROOT = "/root/testdata/sf0.001"


def plain(path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE raw AS SELECT * FROM read_parquet('{path}')")
    con.execute("CREATE VIEW documents AS SELECT * FROM raw")
    rows = con.execute(JUDGED_SQL + "SELECT doc_id, coalesce(clean, text) FROM v WHERE NOT base_failed AND 100 * n_left >= 20 * n_words").fetchall()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({NEAR_SQL}) WHERE kept").fetchall()}
    texts = {d: t for d, t in rows if d in kept}
    raw = {d: t.encode() for d, t in texts.items()}
    n = corpus_pipeline.PASSAGE_BYTES
    count = Counter(hashlib.md5(r[i:i + n]).digest() for r in raw.values() for i in range(len(r) - n + 1))
    out = {}
    for d, t in texts.items():
        r, gone = raw[d], bytearray(len(raw[d]))
        for i in range(len(r) - n + 1):
            if count[hashlib.md5(r[i:i + n]).digest()] > 1:
                gone[i:i + n] = b"\1" * n
        left, at = [], 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at:at + size]):
                left.append(c)
            at += size
        out[d] = "".join(left)
    return out


def test_result(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in plain(f"{ROOT}/documents.parquet").items():
        ids = enc.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert got == want and len(got) > 50


def test_stages_on_awkward_rows(spark):
    from test_oracles import SCHEMA, awkward_documents

    docs = spark.createDataFrame(awkward_documents() + [(None, "no id " * 30, None, None, None)], SCHEMA)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), ROOT).collect() == []
        docs = stage(spark, docs, ROOT)
        assert docs.columns == names or name == "token_ids"
        docs = docs.cache()
        assert docs.count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_result_is_in_the_order_of_the_mixture(spark):
    from heatloom.llm.mixing_queries import OP7_SQL

    got = [(r.doc_id, r.slot, r.place) for r in corpus_pipeline.run(spark, ROOT).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE kept (doc_id BIGINT)")
    con.executemany("INSERT INTO kept VALUES (?)", [(d,) for d in plain(f"{ROOT}/documents.parquet")])
    con.execute(f"CREATE TABLE documents AS SELECT doc_id, source FROM read_parquet('{ROOT}/documents.parquet') JOIN kept USING (doc_id)")
    want = con.execute(f"SELECT doc_id, slot, place FROM ({OP7_SQL}) ORDER BY slot, place, doc_id").fetchall()
    assert got == want and len({r[1] for r in got}) > 5
