"""WARC archives: written with one gzip member a record, read in sequence.

Writer. Payload digests are worked out first; of equal payloads (of at least
``least_bytes``) the one with the smallest page id is stored as a response and
the others as revisits of it. A task fills archives of ``archive_bytes`` (and
one record more at most) and Spark's text sink writes each into a file of its
own, so archives go wherever the session's file systems reach and a lost task
leaves no partial archive. That sink ends each row with a separator: it is NUL
here, and the last byte of an archive (the high byte of its last member's
length, NUL below 16 MB) is left to it. A longer member is followed by an empty
one, whose last byte is NUL too.

Reader. Archives are taken in turn, those of one task one at a time; members are
inflated in steps of ``STEP_BYTES``, records are framed by Content-Length, and
block and payload digests are verified. Rows leave in small batches, payloads
only if they are asked for. A damaged record raises an error.

Null html counts as an empty payload, a null url is left out. Rows with a null
page id are left out of an archive unless ``unnumbered`` is set, as the round
trip sets it; then they are written under a URN without a number and read with a
null page id. They are revisits of a numbered page of equal payload, if there is
one. Repeated rows give repeated records, of one type. Payloads of any size are one record each. Only page_id, url and
html are read, so other columns can't clash; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, remove, shared_dir
from spanforge.shipping import ship

STEP_BYTES = 1 << 16
#: Compressed bytes that an archive is filled to, and records of a batch that the reader gives.
ARCHIVE_BYTES, ROWS_AT_ONCE = 16 << 20, 256
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
#: Fixed value: a gzip member of no bytes, without name and time.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = deflate.compress(data) + deflate.flush()
    return out if out.endswith(b"\0") else out + _EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit's block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(archive: bytes, step: int = STEP_BYTES) -> Iterator[bytes]:
    """The members' bytes, in pieces; the end of a member is an empty piece."""
    rest, inflate = memoryview(archive), zlib.decompressobj(31)
    while len(rest) or inflate is not None:
        if inflate is None:
            inflate = zlib.decompressobj(31)
        part = rest[:step]
        if not len(part):
            raise ValueError("an archive ends inside a member")
        rest = rest[len(part) :]
        data = inflate.decompress(part, step)
        while True:
            if data:
                yield data
            if inflate.eof or not inflate.unconsumed_tail:
                break
            data = inflate.decompress(inflate.unconsumed_tail, step)
        if inflate.eof:
            back = len(inflate.unused_data)
            if back:
                at = len(archive) - len(rest) - back
                rest = memoryview(archive)[at:]
            inflate = None
            yield b""
            if not len(rest):
                return


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and verified blocks, in sequence."""
    held = bytearray()
    for piece in inflated(archive) if archive else ():
        held += piece
        if piece:
            continue
        if not held:
            continue  # an empty member
        end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("a member doesn't start with a WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in held[:end].decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        block = bytes(held[end + 4 : end + 4 + size])
        if len(block) != size or held[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        if fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError("a block differs from its digest")
        held.clear()
        yield fields, block


def read_archive(archive: bytes) -> Iterator[dict]:
    for fields, block in records(archive):
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError("a payload differs from its digest")
        number = lambda name: int(n) if (n := fields.get(name, "").strip("<>").removeprefix(_URN)) else None
        yield {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to")}


def write(pages: DataFrame, path: str, *, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, unnumbered: bool = False) -> None:
    """Write a record for each page into archives under ``path``; pages with a null id only if ``unnumbered``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = (rows if unnumbered else rows.where("page_id IS NOT NULL")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # Only digests that occur twice are joined back; the join deals a hot digest's rows out by size.
    shared = checkpoint(rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = rows.join(shared, "sha1", "left")

    def archives(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):  # one row's objects at a time
                page, url, payload, sha1, first = (batch.column(i)[row].as_py() for i in range(5))
                held.append(member(record(page, url, payload, base64.b32encode(sha1).decode(), None if first is None or first == page else first)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])

    ship(pages.sparkSession)
    ordered = marked.select("page_id", "url", "payload", "sha1", "first")
    files = ordered.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``, in page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}

    def run(batches: Iterable):
        import pyarrow as pa

        types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(n, types[kinds.get(n, "string")]) for n in names])
        for batch in batches:
            for archive in batch.column(0):
                found = ({n: r[n] for n in names} for r in read_archive(archive.as_py()))
                while rows := list(islice(found, ROWS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], schema=schema)

    ship(spark)
    archives = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return archives.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; the archives go once the records' rows are written."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, unnumbered=True, **kw)
    found = checkpoint(read(spark, path))
    remove(spark, path)
    return found
