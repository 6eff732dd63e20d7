"""Harmonic packing of documents into sequences of a fixed token capacity.

Pieces belong to reciprocal-capacity classes: class k holds lengths over C / (k + 1) and up to C / k, and its sequences take k pieces,
no more and no fewer. A document's whole sequences come first. What remains stays in one piece where k of its length nearly fill a
sequence (SLACK), or it is TINY; else floor(C / (k + 1)) tokens are cut off it, of which k + 1 fill a sequence, and the rest is
treated the same way. The rest falls under C / (k * (k + 1)), so a document is cut very few times.

Every worker fills its classes alone, one open sequence for each length: no shuffle, and a bounded memory. What it can't fill, less
than a sequence of each length, waits with its ids, and FAN workers' remains are filled together, round after round; each round is
written to the shared folder. The last remains (a bounded number) are laid end to end and cut at the capacity; the last sequence is
cut into powers of two, which need no padding.

Defined cases: a null or empty text is one piece that holds the end id only; repeated rows and null ids are packed as often as they
come; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import materialise, slices, text_of
from brightfield.llm.token_ids import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Tokens of padding that a sequence of pieces of one length may have; lengths that are never cut.
SLACK, TINY = 8, 32
#: Workers whose remains are filled together.
FAN = 8
#: Rows of an output batch.
ROWS = 10_000


def cuts(rest: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of what remains of a document (0 to capacity - 1 tokens)."""
    out = []
    while rest:
        k = capacity // rest
        if rest <= TINY or capacity - k * rest <= SLACK:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Classes:
    """The open sequences of a worker, one for each length; pieces are lists (doc, start, length, crc, doc_tokens, ids)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[list]] = {}
        self.rows: list[tuple] = []

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: list) -> None:
        length = piece[2]
        waiting = self.open.setdefault(length, [])
        waiting.append(piece)
        if len(waiting) == self.capacity // length:
            sequence = self.number()
            self.rows += [(*p[:5], sequence, i * length, None) for i, p in enumerate(waiting)]
            self.open[length] = []

    def remains(self) -> list[tuple]:
        return [(*p[:5], None, None, p[5]) for length in sorted(self.open, reverse=True) for p in self.open[length]]

    def lay_end_to_end(self) -> None:
        """Every remaining piece, cut where a sequence is full; the last tokens go into sequences whose lengths are powers of two."""
        pieces = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        left = sum(p[2] for p in pieces)
        room = offset = sequence = 0
        for doc, start, length, _, tokens, ids in pieces:
            at = 0
            while at < length:
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1)) if left < self.capacity else self.capacity
                    sequence, offset, left = self.number(), 0, left - room
                some = min(room, length - at)
                part = ids[4 * at : 4 * (at + some)]
                self.rows.append((doc, start + at, some, zlib.crc32(part), tokens, sequence, offset, None))
                at, offset, room = at + some, offset + some, room - some
        self.open = {}


_COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part bigint"
_KINDS = [pa.int64()] * 6 + [pa.binary()]
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]


def _batch(rows: list[tuple], doc_type: pa.DataType, part: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    made = [pa.array(c, t) for c, t in zip(columns, [doc_type, *_KINDS], strict=True)]
    return pa.RecordBatch.from_arrays([*made, pa.array([part] * len(rows), pa.int64())], _NAMES)


def first_fill(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """One row per piece; remains have ids and no sequence. A sequence's number holds the round, the worker and a count."""
    end = int(end_id).to_bytes(4, "little")
    base = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        classes, doc_type = Classes(capacity, part << 32), None
        known = [cuts(r, capacity) for r in range(capacity)]
        for batch in slices(batches):
            doc_type = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                tokens, start = len(ids) // 4, 0
                for _ in range(tokens // capacity):
                    part_ids = ids[4 * start : 4 * (start + capacity)]
                    classes.rows.append((doc, start, capacity, zlib.crc32(part_ids), tokens, classes.number(), 0, None))
                    start += capacity
                for length in known[tokens - start]:
                    part_ids = ids[4 * start : 4 * (start + length)]
                    classes.add([doc, start, length, zlib.crc32(part_ids), tokens, part_ids])
                    start += length
                if len(classes.rows) > ROWS:
                    yield _batch(classes.rows, doc_type, part)
                    classes.rows = []
        if doc_type is not None:
            yield _batch(classes.rows + classes.remains(), doc_type, part)

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")


def fill_again(remains: DataFrame, turn: int, last: bool, capacity: int) -> DataFrame:
    """The remains of FAN workers filled together; ``last``: there are no others, and nothing remains."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("length", "descending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_pylist()
        group = rows[0]["part"] // FAN
        classes = Classes(capacity, (turn << 56) + (group << 32))
        for r in rows:
            classes.add([r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]])
        if last:
            classes.lay_end_to_end()
        return pa.Table.from_batches([_batch(classes.rows + classes.remains(), table.schema.field("doc_id").type, group)])

    return remains.groupBy(F.expr(f"part div {FAN}").alias("worker")).applyInArrow(run, remains.schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    filled = materialise(first_fill(docs, capacity, end_id, tokenizer or tokenizer_path(TOKENIZER)), "harmonic")
    done, turn = [filled], 0
    waiting = F.col("sequence_id").isNull()
    while (most := done[-1].where(waiting).agg(F.max("part")).first()[0]) is not None:
        turn += 1
        done.append(materialise(fill_again(done[-1].where(waiting), turn, most < FAN, capacity), "harmonic"))
    return reduce(DataFrame.unionAll, [d.where(~waiting).select(_NAMES[:7]) for d in done])
