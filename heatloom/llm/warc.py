"""WARC archives: records written by Spark's text writer, read back with segments reassembled.

Writing: a payload becomes an HTTP response in chunked framing. A response of more than ``segment_bytes`` is cut into a
first record and continuation records, so no record, and with ``records_per_file`` no file, grows with the pages. Each
row of the written table is one record, and the end of record (two line ends) is the writer's line separator. So the
files are made by Spark's own commit protocol: a lost executor leaves no half archive.

Reading: every file is parsed by its content lengths. Whole records are decoded where they are read. Only segments
are shuffled: they are grouped by the identifier of their first record, ordered by number, checked against the total length
and then decoded like the others. Of each group of equal payloads one record is the response; the others are revisit
records, which hold no payload and are resolved by the identifier that they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm.store import Scratch

SEGMENT_BYTES = 16 * 1024  # of a record's block
CHUNK_BYTES = 4 * 1024  # of the chunked transfer framing
RECORDS_PER_FILE = 4096
REVISIT_BYTES = 0  # smaller payloads are always written as responses
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

END = b"\r\n\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BATCH_BYTES = 4_000_000


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str | None, payload_digest: str, kind: str = "response") -> str:
    """The identifier of a page's record; it follows from the page's id and payload, so revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {payload_digest} {page!r}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; chunk extensions and trailers are passed over. None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            return None
        n = int(size, 16)
        at = end + 2
        if n == 0:
            rest = body[at:]
            return b"".join(out) if rest == b"\r\n" or rest.endswith(END) else None
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url: str | None) -> str | None:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None


def records(page: str | None, url: str | None, payload: bytes, refers: str | None = None, revisit: bool = False,
            segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page. Page ids travel in fields of their own, percent-encoded; no id, no field."""
    name = digest(payload)
    own = [("Page-Id", None if page is None else quote(page, safe="")), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url))]
    if revisit:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page, name, "revisit")), *own,
                       ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, name)),
                       ("Refers-To-Page-Id", None if refers is None else quote(refers, safe="")),
                       ("WARC-Payload-Digest", "sha1:" + name), ("Content-Type", "application/http;msgtype=response")], b"")
        return
    whole, origin = _HEAD + chunked(payload, chunk_bytes), record_id(page, name)
    parts = [whole[at:at + segment_bytes] for at in range(0, len(whole), segment_bytes)]
    for k, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"),
                  ("WARC-Record-ID", origin if k == 1 else record_id(page, name, f"segment {k}"))]
        if k == 1:
            fields += [*own, ("WARC-Payload-Digest", "sha1:" + name), ("Content-Type", "application/http;msgtype=response")]
        else:
            fields += [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin)]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(k)))
            if k == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(whole))))
        yield _record([*fields, ("WARC-Block-Digest", "sha1:" + digest(part))], part)


def _binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def _writer(segment_bytes: int, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page, url, payload, refers, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                for one in records(page, url, payload or b"", refers, revisit, segment_bytes, chunk_bytes):
                    out.append(one)
                    size += len(one)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([_binary(out)], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([_binary(out)], names=["record"])

    return write


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   records_per_file: int = RECORDS_PER_FILE, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes one response or revisit record per row of ``pages`` below ``path``.

    Of the rows with equal payloads (in UTF-8; null is empty) of at least ``revisit_bytes`` bytes those with the
    largest id are responses, also if that row stands several times; the others revisit it. A null id is the smallest;
    if all ids of equal payloads are null, all are responses. Only digests of repeated payloads are joined back, so
    payloads are moved at most once, and not at all where that table is small enough to send out. A url that is null or empty
    gives no target field; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    top = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("c"))
    scratch = Scratch(pages.sparkSession)
    top = scratch.table(top.filter("c > 1 AND top IS NOT NULL").select("key", "top"), "equal")
    rows = rows.join(top, "key", "left").select(
        F.col("id").cast("string"), "url", "payload", F.col("top").cast("string"),
        (F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))).alias("revisit"))
    out = rows.mapInArrow(_writer(segment_bytes, chunk_bytes), "record binary")
    out.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option(
        "maxRecordsPerFile", records_per_file).text(path)
    scratch.drop()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records of a file, gzip members or plain. What follows a broken
    record is not read; the broken record itself has the type ``broken``."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(data))
            except zlib.error:
                break
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(END, at)
        lines = data[at:end].split(b"\r\n") if end >= 0 else [b""]
        fields = {}
        for line in lines[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if not lines[0].startswith(b"WARC/") or not size.isdecimal() or end + 4 + int(size) > len(data):
            yield {"warc-type": "broken"}, b""
            return
        at = end + 4 + int(size)
        yield fields, data[end + 4:at]
        at += 4 if data[at:at + 4] == END else 0


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP response without its transfer framing; None if either is broken."""
    head, found, body = block.partition(END)
    if not found or not head.startswith(b"HTTP/"):
        return None
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"transfer-encoding" and value.strip().lower().endswith(b"chunked"):
            return unchunked(body)
    return body


def _plain(name: str | None) -> str | None:
    return None if name is None else name.rpartition(":")[2].upper()


_RESULT = ("record_id string, page string, uri string, record_type string, refers_id string, refers_page string, payload_bytes long, "
           "payload_digest string, problem string, payload binary")
_RESULT_TYPES = pa.schema([("record_id", pa.string()), ("page", pa.string()), ("uri", pa.string()), ("record_type", pa.string()),
                           ("refers_id", pa.string()), ("refers_page", pa.string()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary())])


def _id(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def _result(fields: dict[str, str], block: bytes, with_payload: bool, problem: str | None = None) -> dict:
    """The row of a response, revisit or broken record."""
    kind = fields["warc-type"]
    row = {"record_id": fields.get("warc-record-id"), "page": _id(fields.get("page-id")), "uri": fields.get("warc-target-uri"),
           "record_type": kind, "refers_id": fields.get("warc-refers-to"), "refers_page": _id(fields.get("refers-to-page-id")),
           "payload_digest": _plain(fields.get("warc-payload-digest")), "problem": problem}
    if kind == "broken":
        row["problem"] = "broken record"
    elif kind == "response" and problem is None:
        payload = http_payload(block)
        if payload is None:
            row["problem"] = "broken framing"
        else:
            found = digest(payload)
            if row["payload_digest"] not in (None, found):
                row["problem"] = "other digest"
            row |= {"payload_bytes": len(payload), "payload_digest": found, "payload": payload if with_payload else None}
    return row


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    for batch in batches:
        for content in batch.column(0):
            yield from parse(content.as_buffer().to_pybytes())


def _flushed(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row, n in rows:
        out.append(row)
        size += n + 200
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _segmented(fields: dict[str, str]) -> bool:
    return "warc-segment-number" in fields or fields.get("warc-type") == "continuation"


def _whole_records(with_payload: bool):
    def read(batches):
        rows = ((_result(f, b, with_payload), len(b)) for f, b in _records(batches)
                if f.get("warc-type") in ("response", "revisit", "broken") and not _segmented(f))
        yield from _flushed(rows, _RESULT_TYPES)

    return read


_SEGMENT = "origin string, number int, total long, head map<string,string>, block binary"
_SEGMENT_TYPES = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
                            ("head", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdecimal() else None


def _segment_records(batches):
    def rows():
        for f, b in _records(batches):
            if f.get("warc-type") in ("response", "continuation") and _segmented(f):
                first = f["warc-type"] == "response"
                yield {"origin": f.get("warc-record-id") if first else f.get("warc-segment-origin-id"), "block": b,
                       "number": _number(f.get("warc-segment-number")), "total": _number(f.get("warc-segment-total-length")),
                       "head": list(f.items()) if first else None}, len(b)

    yield from _flushed(rows(), _SEGMENT_TYPES)


def reassembled(segments: list[dict]) -> tuple[dict[str, str], bytes, str | None, int]:
    """(fields of the first record, block, problem, copies) of the segments of one origin, ordered by number.

    A record that stands in the archives several times has all its segments as often; they count once, and the result
    as often as the first segment. Segments of one number with different blocks, a missing number, and a length other than
    the stated total are problems.
    """
    head = next(({e["key"]: e["value"] for e in s["head"]} for s in segments if s["head"]), None)
    copies = max(1, sum(s["number"] == 1 for s in segments))
    by_number = {}
    for s in segments:
        if by_number.setdefault(s["number"], s["block"]) != s["block"]:
            return head or {"warc-type": "response"}, b"", "unlike copies of a segment", copies
    block = b"".join(by_number.values())
    totals = {s["total"] for s in segments if s["total"] is not None}
    problem = None
    if head is None or list(by_number) != list(range(1, len(by_number) + 1)) or not totals:
        problem = "missing segment"
    elif totals != {len(block)}:
        problem = "other length"
    return head or {"warc-type": "response"}, block, problem, copies


def _assembled_records(with_payload: bool):
    def assemble(batches):
        def rows():
            for batch in batches:
                for one in batch.column(1):
                    head, block, problem, copies = reassembled(one.as_py())
                    row = _result(head, block, with_payload, problem)
                    for _ in range(copies):
                        yield row, len(block)

        yield from _flushed(rows(), _RESULT_TYPES)

    return assemble


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response, revisit or broken record of the archives below ``path``: ``record_id, page, uri,
    record_type, refers_id, refers_page, payload_bytes, payload_digest, problem`` and ``payload`` (null without
    ``with_payload`` and for revisits).

    ``problem`` is null where all is right; else it says what is wrong, and the payload is null unless only its digest
    differs. A revisit has the length and digest of the payload of the response that it refers to; without such a
    response its length is null and its problem ``nothing to refer to``. Records of other types are passed over, an empty
    folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(_whole_records(with_payload), _RESULT)
    groups = files.mapInArrow(_segment_records, _SEGMENT).groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "total", "block", F.map_entries("head").alias("head")))).alias("segments"))
    rows = Scratch(spark).table(whole.union(groups.mapInArrow(_assembled_records(with_payload), _RESULT)), "records")
    sources = rows.filter("record_type = 'response' AND problem IS NULL").groupBy(F.col("record_id").alias("refers_id")).agg(
        F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("sha"))
    revisits = rows.filter("record_type = 'revisit'").join(sources, "refers_id", "left")
    lost = F.when(F.col("bytes").isNull(), "nothing to refer to").when(F.col("payload_digest") != F.col("sha"), "other digest")
    revisits = revisits.withColumn("payload_bytes", F.col("bytes")).withColumn("problem", F.coalesce("problem", lost))
    return rows.filter("record_type <> 'revisit'").union(revisits.select(*rows.columns))
