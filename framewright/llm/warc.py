"""WARC archives of pages, with segmentation, chunked transfer framing and revisit records.

Archives are rows (archive, content): each content is a run of whole WARC/1.1 records of about ARCHIVE_BYTES, so that
they can be kept in any store that Spark reads. A response block is an HTTP header and a chunked body; a block longer
than SEGMENT_BYTES becomes a first segment and continuation records. Reading parses the archives, groups continuations
by origin id, orders them by segment number, verifies the total length, and decodes the chunked framing.

Defined cases: null html is an empty payload; equal payloads under 1000 bytes are all responses; rows that repeat the
largest page_id of their payload are responses; a null page_id never refers and is never referred to; a missing,
repeated or short segment raises ValueError; extra columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 4 << 20, 24 << 10, 8 << 10
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Decodes chunked framing: size lines in hex with optional extensions, a last chunk of size 0, trailers."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def records(page_id, url, payload: bytes, digest: str, refers_to, serial: str, segment: int = SEGMENT_BYTES):
    """The records of one page: a revisit, a response, or a response and its continuations."""
    rid = f"<urn:page:{page_id}:{serial}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")]
    yield record(first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{i}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(i))]
        yield record(own + [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(parts)), part)


def parse(content: bytes):
    """(header fields, block) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = end + 4
        if content[at + n : at + n + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, content[at : at + n]
        at += n + 4


def page_of(rid: str):
    part = rid.strip("<>").split(":")[2]
    return None if part == "None" else int(part)


def body_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT_BYTES) -> DataFrame:
    """Rows (archive, content) of the pages' records; equal payloads become revisits of the largest page id."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    small = rows.filter((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    heads = small.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("digest", "head")
    refers = small.join(heads, "digest").filter("page_id <> head").dropDuplicates(["page_id", "digest"])
    typed = rows.join(refers, ["page_id", "digest"], "left")

    def run(batches):
        from pyspark import TaskContext

        part, n, files, size, buf = TaskContext.get().partitionId(), 0, 0, 0, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{files:06d}.warc"]), pa.array([b"".join(buf)], pa.binary())], names=["archive", "content"])

        for b in batches:
            for r in b.to_pylist():
                for rec in records(r["page_id"], r["url"], r["payload"], r["digest"], r["head"], f"{part}-{n}", segment):
                    buf.append(rec)
                    size += len(rec)
                    if size >= ARCHIVE_BYTES:
                        yield out()
                        files, size, buf = files + 1, 0, []
                n += 1
        if buf:
            yield out()

    return typed.select("page_id", "url", "payload", "digest", "head").mapInArrow(run, "archive string, content binary")


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    from .common import stash

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "origin", "segment", "total"]

    def whole(page, block):
        body = body_of(block)
        return [page, len(body), hashlib.sha1(body).hexdigest(), "response", None, body if payloads else None]

    def scan(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for f, block in parse(content):
                    kind, number = f["WARC-Type"], f.get("WARC-Segment-Number")
                    if kind == "revisit":
                        head = dict(x.lower().split(b": ", 1) for x in block.split(b"\r\n")[1:] if x)
                        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append([page_of(f["WARC-Record-ID"]), int(head[b"content-length"]), digest, kind, page_of(f["WARC-Refers-To"]), None, None, None, None])
                    elif number is None and kind == "response":
                        rows.append([*whole(page_of(f["WARC-Record-ID"]), block), None, None, None])
                    elif kind in ("response", "continuation"):
                        origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                        total = f.get("WARC-Segment-Total-Length")
                        rows.append([page_of(origin), None, None, None, None, block, origin, int(number), int(total) if total else None])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=names)

    found = stash(archives.select("content").mapInArrow(scan, FOUND + ", payload binary, origin string, segment long, total long"), "warc-records")
    parts = found.filter("origin IS NOT NULL").groupBy("origin", "page_id").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", F.col("payload").alias("block")))).alias("parts"))

    def join(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = [p["segment"] for p in r["parts"]]
                block = b"".join(p["block"] for p in r["parts"])
                if got != list(range(1, len(got) + 1)) or r["total"] != len(block):
                    raise ValueError(f"segments of {r['origin']} are missing, repeated or short")
                rows.append(whole(r["page_id"], block))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=names[:6])

    out = found.filter("origin IS NULL").select(names[:6]).unionByName(parts.select("origin", "page_id", "total", "parts").mapInArrow(join, FOUND + ", payload binary"))
    return out if payloads else out.drop("payload")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    from .common import stash, table

    return read_archives(stash(write_archives(table(spark, sf_dir, "pages")), "warc"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN h.head IS NULL OR h.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 1000
"""
