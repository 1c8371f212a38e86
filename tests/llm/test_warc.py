"""WARC archives: framing, segments, revisits and whole round trips."""

import glob
import gzip
import random
from collections import Counter

import pytest

from heatloom.llm import warc


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunked_framing(size):
    for data in [b"", b"a", b"\r\n0\r\n\r\n", "é\r\n".encode() * 500, bytes(range(256)) * 40]:
        assert warc.unchunked(warc.chunked(data, size)) == data


def test_chunk_extensions_trailers_and_broken_framing():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in [b"", b"3\r\nab", b"3\r\nabcX\r\n0\r\n\r\n", b"g\r\n", b"3\r\nabc\r\n", b"\r\n\r\n", b"0\r\n", b"-1\r\nabc"]:
        assert warc.unchunked(bad) is None


def test_segments():
    whole = list(warc.records("7", "http://x.org/", b"payload " * 100, segment_bytes=100, chunk_bytes=64))
    assert len(whole) > 8
    parts = [next(warc.parse(r + warc.END)) for r in whole]
    rows = [{"number": int(f["warc-segment-number"]), "total": int(t) if (t := f.get("warc-segment-total-length")) else None, "block": b,
             "head": [{"key": k, "value": v} for k, v in f.items()] if f["warc-type"] == "response" else None} for f, b in parts]
    head, block, problem, copies = warc.reassembled(rows)
    assert problem is None and copies == 1 and warc.http_payload(block) == b"payload " * 100
    assert {f["warc-segment-origin-id"] for f, _ in parts[1:]} == {head["warc-record-id"]}
    twice = sorted(rows + rows, key=lambda r: r["number"])
    assert warc.reassembled(twice)[1:] == (block, None, 2)
    assert warc.reassembled(rows[:3] + rows[4:])[2] == "missing segment"
    assert warc.reassembled(rows[1:])[2] == "missing segment"
    assert warc.reassembled(rows[:-1])[2] == "missing segment"
    assert warc.reassembled(rows[:-1] + [rows[-1] | {"block": b"x" + rows[-1]["block"]}])[2] == "other length"
    assert warc.reassembled(twice[:-1] + [rows[-1] | {"block": b"other"}])[2] == "unlike copies of a segment"


PAGES = "page_id long, url string, html string"


def awkward_pages():
    rng = random.Random(5)
    long = "".join(rng.choice("<p>é \n\r\t€😀x") for _ in range(150_000))
    texts = [None, "", " ", "a", "a", "a", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n", "0\r\n\r\n", "\x00\x01", long, long + "!", long,
             "x" * 16_000, "é" * 8_192]
    rows = [(k, ["http://a.org/é b?q=1", None, "", "x\r\nWARC-Type: warcinfo\r\n\r\n", "no url"][k % 5], t) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[11], (None, "u", "a"), (None, "u", "only null ids"), (None, "v", "only null ids"), (5, "w", "another text")]


def test_awkward_pages(spark, both):
    rows = awkward_pages()
    frame = spark.createDataFrame(rows, PAGES).repartition(3).selectExpr(
        "*", "'k' AS key", "html AS record", "page_id AS id", "1 AS top", "'x' AS payload", "url AS revisit")
    got, want = both("op11_warc", pages=frame)
    assert got == want and len(got[1]) == len(rows)


def test_no_pages(spark, both):
    got, want = both("op11_warc", pages=spark.createDataFrame([], PAGES))
    assert got == want


def test_texts_come_back(spark, tmp_path):
    rows = [r for r in awkward_pages() if r[0] is not None]
    frame = spark.createDataFrame(rows, PAGES)
    warc.write_archives(frame, f"{tmp_path}/w", segment_bytes=1000, chunk_bytes=70, records_per_file=50, revisit_bytes=1)
    assert len(glob.glob(f"{tmp_path}/w/part-*")) > 10
    out = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert not [r for r in out if r.problem]
    assert Counter((r.page, r.payload_bytes) for r in out) == Counter((str(p), len((t or "").encode())) for p, _, t in rows)
    by_id = {r.record_id: bytes(r.payload) for r in out if r.record_type == "response"}
    texts = {(str(p), len((t or "").encode())): (t or "").encode() for p, _, t in rows}
    for r in out:
        payload = bytes(r.payload) if r.record_type == "response" else by_id[r.refers_id]
        assert payload == texts[r.page, r.payload_bytes]
    empty = [r for r in out if r.payload_bytes == 0]
    assert len(empty) == 2 and {r.record_type for r in empty} == {"response"}  # below revisit_bytes


def test_other_archives(spark, tmp_path):
    """Gzip members, unknown types, plain bodies, lost segments and files that end too soon."""
    whole = [r + warc.END for r in warc.records("1", "u", b"text " * 50, segment_bytes=60)]
    lone = next(warc.records("2", "u", b"lone")) + warc.END
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc" + warc.END
    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    other = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%s" % (len(plain), plain) + warc.END
    lost = next(warc.records("3", "u", b"gone", "9", revisit=True)) + warc.END
    members = b"".join(gzip.compress(r) for r in [info, lone, *reversed(whole)])
    (tmp_path / "a.warc.gz").write_bytes(members)
    (tmp_path / "b.warc").write_bytes(other + lost + lone[:-30])
    (tmp_path / "c.warc").write_bytes(b"".join([r + warc.END for r in warc.records("4", "u", b"z" * 500, segment_bytes=100)][:-1]))
    (tmp_path / "d.warc").write_bytes(b"")
    got = {(r.page, r.record_type): (r.problem, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("1", "response"): (None, b"text " * 50), ("2", "response"): (None, b"lone"), (None, "response"): (None, b"body"),
                   ("3", "revisit"): ("nothing to refer to", None), (None, "broken"): ("broken record", None),
                   ("4", "response"): ("missing segment", None)}
