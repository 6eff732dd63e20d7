"""WARC archives: writing, and normalising monolithic gzip streams to one member per record with an offset index.

An archive here is written as one gzip stream over all its records, as some crawlers do. The normaliser inflates such a stream
once, from front to back, cuts it into records by their Content-Length, compresses every record as a member of its own, and
notes each member's offset and length in a sidecar index. The index then opens any record alone.

A data set is a table of archives (shard, part, payload, index) that Spark stores and reads, so any store that Spark knows will
do. Records with equal payloads are stored once: the one with the largest page_id is a response, the others revisit it.

Defined cases: a null html is an empty payload, and empty payloads are equal; repeated rows of one page_id with equal payloads are
all responses; a row without a page_id revisits an equal one that has one, else it is a response; a null url becomes urn:page:<id>.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import materialise, slices

#: An archive is closed when its records have so many bytes.
ARCHIVE_BYTES = 8_000_000
MONOLITH_LEVEL, MEMBER_LEVEL = 1, 6
INFLATED_CHUNK = 1_000_000
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that only names what it refers to."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    return "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + _END + body + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one whole record."""
    head, _, rest = raw.partition(_END)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if len(rest) != size + len(_END) or rest[size:] != _END:
        raise ValueError("a record's length does not fit")
    return headers, rest[:size]


def inflated(stream: bytes) -> Iterator[bytes]:
    """The bytes behind a gzip stream of any number of members, in bounded chunks, in one pass."""
    engine, view = zlib.decompressobj(31), memoryview(stream)
    data: bytes | memoryview = view
    while True:
        chunk = engine.decompress(data, INFLATED_CHUNK)
        if chunk:
            yield chunk
        if engine.eof:
            if not engine.unused_data:
                return
            data, engine = engine.unused_data, zlib.decompressobj(31)
        elif engine.unconsumed_tail:
            data = engine.unconsumed_tail
        elif not chunk:
            raise ValueError("the gzip stream is cut off")
        else:
            data = b""


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of records at their lengths."""
    held = bytearray()
    need, searched = -1, 0
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                at = held.find(_END, max(0, searched - 3))
                if at < 0:
                    searched = len(held)
                    break
                lengths = [x for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = at + len(_END) + int(lengths[-1].split(b":")[1]) + len(_END)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, searched = -1, 0
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(stream: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with every record as its own gzip member, and each member's offset and length."""
    out, index = bytearray(), []
    for raw in records(inflated(stream)):
        member = gzip.compress(raw, MEMBER_LEVEL, mtime=0)
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def read_member(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse(gzip.decompress(memoryview(archive)[offset : offset + length]))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every page as a record of a monolithic archive (stored in the shared folder)."""
    page = F.coalesce(F.concat(F.lit("urn:page:"), F.col("page_id").cast("bigint")), F.lit("urn:page:"))
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), page).alias("url"), _payload("html").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    originals = rows.select("sha1", "page_id").groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    # Only repeated payloads are looked up, in a table of known size: a small one is broadcast and no page moves; of a large one
    # the adaptive skew join spreads the rows of a hot payload.
    originals = materialise(originals.select("sha1", "original"), "warc-originals")
    refers_to = F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))
    rows = rows.join(originals, "sha1", "left").select("page_id", "url", "payload", refers_to.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = zlib.compressobj(MONOLITH_LEVEL, wbits=31), 0
        out: list[bytes] = []
        for batch in slices(batches):
            for page, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = record(page, url.replace("\r", " ").replace("\n", " "), base32_sha1(payload), len(payload), refers_to, payload)
                out.append(held.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield _one(b"".join(out) + held.flush())
                    held, size, out = zlib.compressobj(MONOLITH_LEVEL, wbits=31), 0, []
        if size:
            yield _one(b"".join(out) + held.flush())

    return materialise(rows.mapInArrow(write, "archive binary"), "warc")


def _one(archive: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])


def normalise_archives(archives: DataFrame) -> DataFrame:
    """archive (one member per record) and its sidecar index, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                archive, index = normalise(raw.as_py())
                entries = pa.array([[{"offset": a, "length": n} for a, n in index]], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary()), entries], ["archive", "entries"])

    return materialise(archives.mapInArrow(run, "archive binary, entries array<struct<offset:bigint,length:bigint>>"), "warc-normal")


def read_archives(normal: DataFrame) -> DataFrame:
    """One row per record, each opened through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, block_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, entries in zip(batch.column(0), batch.column(1), strict=True):
                raw, rows = archive.as_py(), []
                for e in entries.as_py():
                    h, block = read_member(raw, e["offset"], e["length"])
                    number = lambda name: int(x) if (x := h[name].rsplit(":", 1)[1].rstrip(">")) else None  # noqa: B023, E731
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and base32_sha1(block) != digest:
                        raise ValueError("a payload does not fit its digest")
                    rows.append((number("WARC-Record-ID"), int(h["X-Payload-Length"]), digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, len(block)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_bytes"]
    return normal.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, block_bytes bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(normalise_archives(write_archives(pages))).drop("block_bytes")
