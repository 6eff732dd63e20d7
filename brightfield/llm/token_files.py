"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of whole documents in blocks of 128. Of every block the minimum is subtracted and the differences are packed
at the width that fits nine of ten; larger ones go, by position and value, to the block's exception list. A header lists the
documents and indexes where blocks start, so that any block can be read alone.

A data set is a table of such files (shard, part, payload, tokens) in ascending order of document: shards are ranges of ids,
parts follow each other inside a shard. Spark stores and reads the table, so any store that Spark knows will do.

Defined cases: a null or empty text holds the end id only; repeated rows are written as often as they come; no documents make no
files; documents without an id come first; documents of one id are ordered by a hash of their texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightfield.llm.common import materialise, slices, text_of
from brightfield.llm.token_ids import encoder, tokenizer_path

END_ID = 2
BLOCK = 128
#: The share of a block's differences that the packed width must hold.
PERCENTILE = 0.9
#: A file is closed when it has so many ids.
IDS_PER_FILE = 200_000

#: Rows of a few hundred KB: small row groups, no dictionaries.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}

_MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, blocks


def encode_blocks(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed blocks of unsigned 32-bit values (the last is filled up with its last value), and where each starts."""
    n = -(-len(values) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint64)
    full = np.full(n * BLOCK, values[-1], np.uint32)
    full[: len(values)] = values
    full = full.reshape(n, BLOCK)
    least = full.min(1)
    rest = full - least[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(1)
    words = (width.astype(np.int64) * BLOCK) // 64
    sizes = 6 + 8 * words + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5] = width, exceptions
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        low = (rest[mine] & np.uint32((1 << w) - 1)).T.astype(np.uint64)
        packed = np.zeros((2 * w, len(mine)), np.uint64)
        for j in range(BLOCK):
            word, bit = divmod(j * w, 64)
            packed[word] |= low[j] << np.uint64(bit)
            if bit + w > 64:
                packed[word + 1] |= low[j] >> np.uint64(64 - bit)
        raw = np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(len(mine), 16 * w)
        out[(starts[mine] + 6)[:, None] + np.arange(16 * w)] = raw
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)[:-1]])[block]
        tail = starts + 6 + 8 * words
        out[tail[block] + nth] = place.astype(np.uint8)
        value = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(tail[block] + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = value
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(raw: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` values of the blocks of ``raw`` (bytes) that begin at ``starts``."""
    n, starts = len(starts), starts.astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32)
    least = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4")
    width, exceptions = raw[starts + 4], raw[starts + 5].astype(np.int64)
    full = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        packed = np.ascontiguousarray(np.ascontiguousarray(raw[(starts[mine] + 6)[:, None] + np.arange(16 * w)]).view("<u8").T)
        low, mask = np.empty((BLOCK, len(mine)), np.uint32), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            word, bit = divmod(j * w, 64)
            v = packed[word] >> np.uint64(bit)
            if bit + w > 64:
                v = v | (packed[word + 1] << np.uint64(64 - bit))
            low[j] = v & mask
        full[mine] = low.T
    if exceptions.any():
        block = np.repeat(np.arange(n), exceptions)
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)[:-1]])[block]
        tail = starts + 6 + 16 * width.astype(np.int64)
        value = np.ascontiguousarray(raw[(tail[block] + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        full[block, raw[tail[block] + nth]] = value
    full += least
    return full.reshape(-1)[:count]


def write_file(documents: list[tuple[int | None, bytes]]) -> bytes:
    """A file of (doc_id, little-endian 32-bit ids)."""
    values = np.frombuffer(b"".join(ids for _, ids in documents), "<u4")
    body, starts = encode_blocks(values)
    #: The top bit of a number of ids marks a document without an id.
    table = b"".join(struct.pack("<qQ", d or 0, len(ids) // 4 | (d is None) << 63) for d, ids in documents)
    return _HEAD.pack(_MAGIC, len(documents), len(values), len(starts)) + table + starts.astype("<u8").tobytes() + body


def _parts(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    magic, documents, ids, blocks = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token-id file")
    table = np.frombuffer(payload, "<i8", 2 * documents, _HEAD.size).reshape(-1, 2)
    at = _HEAD.size + 16 * documents
    return table, np.frombuffer(payload, "<u8", blocks, at), np.frombuffer(payload, np.uint8, offset=at + 8 * blocks), ids


def read_file(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, number of ids) of each document, which have no doc_id, and all ids."""
    table, starts, raw, ids = _parts(payload)
    table, no_id = table.copy(), table[:, 1] < 0
    table[:, 1] &= 2**63 - 1
    return table, no_id, decode_blocks(raw, starts, ids)


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    _, starts, raw, ids = _parts(payload)
    return decode_blocks(raw, starts[block : block + 1], min(BLOCK, ids - block * BLOCK))


def write_token_files(docs: DataFrame, end_id: int = END_ID, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Encode documents and write them, in ascending doc_id order, as files: shard, part, tokens, payload.

    Spark's range partitioning deals texts out by id (and a hash of the text, which splits repeated ids); every range is sorted,
    encoded and written by one task. The table of files goes to ``path``, or to the shared folder until the session ends.
    """
    vocabulary = tokenizer or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            arrays = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([write_file(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "part", "tokens", "payload"])

        for batch in slices(batches):
            for d, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1).to_pylist()), strict=True):
                if held and size >= IDS_PER_FILE:
                    yield file()
                    held, size, part = [], 0, part + 1
                held.append((d, ids + end))
                size += len(ids) // 4 + 1
        if held:
            yield file()

    files = base.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "shard int, part int, tokens bigint, payload binary")
    return materialise(files, "token-files", path, **LARGE_ROWS)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    shards = files.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    # A row per shard, which is a partition of the writing job.
    shards = shards.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("shard_start"))
    order = Window.partitionBy("shard").orderBy("part")
    parts = files.select("shard", "part", (F.sum("tokens").over(order) - F.col("tokens")).alias("part_start")).join(shards, "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                table, no_id, values = read_file(payload.as_py())
                ends = np.cumsum(table[:, 1])
                raw = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), table[:, 1].tolist(), strict=True)]
                arrays = [pa.array(np.full(len(table), shard, np.int32)), pa.array(np.full(len(table), part, np.int32)), pa.array(table[:, 0], mask=no_id), pa.array(ends - table[:, 1]), pa.array(table[:, 1]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "part", "doc_id", "start", "n_tokens", "ids_crc32"])

    read_back = files.select("shard", "part", "payload").mapInArrow(read, "shard int, part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    joined = read_back.join(parts, ["shard", "part"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("part_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
