"""WARC archives: writing with revisits and segments, and reading back with segment reassembly.

A page becomes one logical record: ``response`` with the payload in chunked transfer framing, or ``revisit`` with
headers alone. A record's block longer than the segment size is cut: the first part keeps its type, the rest are
``continuation`` records that name the origin's id and their number; the last tells the total length.
The reader parses records by Content-Length, brings the parts of an origin together, orders them by number, checks
that no part is missing and that the total is right, and takes the chunk framing off.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 1_000
#: Equal payloads of at least so many bytes become revisits.
REVISIT_FROM = 1_000

_DATE = "2024-01-31T00:00:00Z"
PARTS = "origin string, page_id long, url string, kind string, refers_to long, payload_bytes long, digest string, number int, total long, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in HTTP/1.1 chunked transfer coding."""
    out = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _line(value) -> str:
    """A header value on one line."""
    return "" if value is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records_of(row_id: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of a page, in order."""
    origin = f"<urn:page:{'' if page_id is None else page_id}:{row_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {len(payload)}\r\n"
    common = [("WARC-Record-ID", origin), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to)]
        yield _record([("WARC-Type", "revisit"), *common, *more, ("Content-Type", "application/http; msgtype=response")], f"{http}\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    first = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:{n}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream, by Content-Length alone."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) as gzipped WARC files under path.

    Of rows with equal payloads of 1000 bytes or more, that with the largest page_id is the response (rows that
    repeat its page_id too), others are revisits. Null html is an empty payload; a null page_id loses to any other.
    Digests and ids alone are compared over the whole table; the payload is dealt out once, by page_id, which no
    group of copies makes uneven.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = src.where(F.length("payload") >= REVISIT_FROM).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = keys.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("target"))).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "target").distinct()
    rows = src.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "payload", "digest", "target", F.col("r_digest").isNotNull().alias("revisit"))

    def records(batches):
        for batch in batches:
            out, size = [], 0
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                for record in records_of(*r, segment_bytes=segment_bytes):
                    out.append(record[:-2])  # the writer ends each row with CR LF
                    size += len(record)
                if size > 1 << 23:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _page(headers: dict[str, str], name: str) -> int | None:
    value = headers.get(name)
    return int(value) if value else None


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: an origin's first part with what its headers tell, or a later part."""

    def parse(batches):
        names = [x.split()[0] for x in PARTS.split(", ")]
        schema = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = io.BytesIO(data)
                stream = gzip.GzipFile(fileobj=stream) if data[:2].to_pybytes() == b"\x1f\x8b" else stream
                out, size = [], 0
                for h, block in parse_records(stream):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    number = int(h.get("warc-segment-number", 1))
                    alone = kind != "continuation" and "warc-segment-number" not in h
                    total = len(block) if alone else _page(h, "warc-segment-total-length")
                    length = re.search(rb"(?i)\r\nX-Payload-Length: (\d+)\r\n", block[:1000]) if kind == "revisit" else None
                    out.append((origin, _page(h, "warc-page-id"), h.get("warc-target-uri"), kind, _page(h, "warc-refers-to-page-id"), int(length[1]) if length else None, h.get("warc-payload-digest", "").removeprefix("sha1:"), number, total, block))
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, PARTS)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r\n]*chunked", head) else body


def reassemble(parts: DataFrame) -> DataFrame:
    """A row for each origin: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, digest, whole.

    whole is false where a part is missing, repeated or the total length is wrong; the payload is null then.
    Only origins of several parts are dealt out, by their id; a part is never larger than a segment, and an origin's
    parts are joined one after the other, so memory holds one page at a time.
    """
    out = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, digest string, whole boolean"

    def decode(batches):
        for batch in batches:
            got = batch.to_pydict()
            payloads = [None if k == "revisit" else http_payload(b) for k, b in zip(got["kind"], got["block"], strict=True)]
            sizes = [n if p is None else len(p) for p, n in zip(payloads, got["payload_bytes"], strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(got["page_id"], pa.int64()), "url": pa.array(got["url"], pa.string()), "record_type": got["kind"], "refers_to": pa.array(got["refers_to"], pa.int64()), "payload": pa.array(payloads, pa.binary()), "payload_bytes": pa.array(sizes, pa.int64()), "digest": got["digest"], "whole": [True] * len(sizes)})

    def join(batches):
        open_: list = []

        def close():
            first = open_[0]
            numbers, total = [r["number"] for r in open_], open_[-1]["total"]
            block = b"".join(r["block"] for r in open_)
            whole = numbers == list(range(1, len(open_) + 1)) and total == len(block) and first["kind"] == "response"
            payload = http_payload(block) if whole else None
            return {"page_id": first["page_id"], "url": first["url"], "record_type": first["kind"], "refers_to": None, "payload": payload, "payload_bytes": None if payload is None else len(payload), "digest": first["digest"], "whole": whole}

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_())])
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if open_ and open_[0]["origin"] != row["origin"]:
                    done.append(close())
                    open_ = []
                open_.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if open_:
            yield pa.RecordBatch.from_pylist([close()], schema)

    single = F.col("total").isNotNull() & (F.col("number") == 1)
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = parts.where(~single).repartition(n, "origin").sortWithinPartitions("origin", "number")
    return parts.where(single).mapInArrow(decode, out).unionByName(several.mapInArrow(join, out))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back. Null html is an empty payload; of equal payloads that of the largest page_id is the response.

    Digests are those of the payloads read; one that isn't what was written, or a page with a part missing, is an error.
    """
    path = fresh_path(spark, "warc")
    bounded_batches(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = reassemble(read_parts(spark, path))
    broken = F.raise_error(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" didn't come back as it was written"))).cast("string")
    digest = F.when(F.col("record_type") == "revisit", F.col("digest")).when(F.col("whole") & (F.sha1("payload") == F.col("digest")), F.col("digest")).otherwise(broken)
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS target FROM p GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to
FROM p JOIN g USING (payload_digest)
"""
