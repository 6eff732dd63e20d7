"""Packing documents into sequences of a fixed token capacity.

Lengths are counted into a histogram, which is all that the driver sees. Over classes of neighbouring lengths a configuration
linear program (which fillings of a sequence, how often) is solved by multiplicative weights: every step prices the classes by
their weights, a knapsack dynamic program finds the dearest filling, and covered classes lose weight. Its solution is rounded down
to whole sequences. A class counts as its longest length there, so sequences keep gaps, which are known to the token; what rounding
leaves goes, longest first, into the smallest gap that holds it. A filling used m times takes m consecutive pieces in order of
length for each of its places, so a plan is a short list of rank ranges, whatever the number of documents.

Defined cases: a null or empty text is one piece that holds the end id only; only documents over the capacity are cut; repeated
rows are packed as often as they come; ties of length are ordered by document, piece and start; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightfield.llm.common import materialise, slices, text_of
from brightfield.llm.token_ids import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Classes of lengths in the linear program, and the cells of its knapsack; with FEW lengths each token is a cell.
CLASSES, CELLS, FEW = 200, 1024, 40
MWU_STEPS = 300
MWU_RATE = 0.2
#: Prices begin at this power of the length, so that the first fillings leave little room and take long pieces.
POWER = 1.3
#: Shares of the program's solution that are tried; with none of it all pieces fill gaps.
KEPT = (1.0, 0.8, 0.6, 0.4, 0.2, 0.1, 0.05, 0.0)
#: Rows of a bucket within which pieces of one length are numbered.
ROWS_PER_BUCKET = 50_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (another number for every piece), and ids, the little-endian
    32-bit ids, if wanted."""
    path = tokenizer or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * with_ids
    base = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            rows, at = [], []
            for k, ids in enumerate(encoder(path).encode(batch.column(1).to_pylist())):
                ids += end
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    at.append(k)
                    rows.append((piece, a // 4, len(part) // 4, zlib.crc32(part), row, part))
                    row += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made[: len(names)], names)

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint" + ", ids binary" * with_ids)


@dataclass
class Plan:
    """Rank ranges of the pieces, longest first: first rank, pieces, and the sequence that the first of them goes to."""

    n_pieces: int = 0
    n_sequences: int = 0
    ranges: list[tuple[int, int, int]] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        ranges = sorted(self.ranges)
        return np.array([r[0] for r in ranges], np.int64), np.array([r[2] for r in ranges], np.int64)


def dearest_filling(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: how often each of ``sizes`` (ascending) is in the filling of most value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fit[c]:
            worth = best[c - sizes[:n]] + value[:n]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], last[c] = worth[j], j
    uses, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            uses[last[c]] += 1
            c -= int(sizes[last[c]])
    return uses


def fractional_fillings(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = MWU_STEPS, rate: float = MWU_RATE) -> list[tuple[float, np.ndarray]]:
    """(times, filling) pairs that about cover ``demand``: multiplicative weights over the covering constraints."""
    cover, found, first = np.zeros(len(sizes)), {}, (sizes / capacity) ** POWER
    for _ in range(steps):
        done = cover / demand
        value = first * np.exp(-(done - done.min()) / rate)
        uses = dearest_filling(sizes, value, capacity)
        some = uses > 0
        times = rate * (demand[some] / uses[some]).min()
        key = uses.tobytes()
        found[key] = found.get(key, 0.0) + times
        cover += times * uses
    scale = float((demand * sizes).sum() / (cover * sizes).sum())
    return [(t * scale, np.frombuffer(k, np.int64)) for k, t in sorted(found.items(), key=lambda x: -x[1])]


class _Packer:
    """Pieces by length that wait, and sequences begun by the gap that they still have, both as ranges of numbers."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.lengths = sorted((n for n, c in histogram.items() if c > 0), reverse=True)
        self.left = {n: histogram[n] for n in self.lengths}
        self.rank, at = {}, 0  # the next free rank of each length
        for n in self.lengths:
            self.rank[n] = at
            at += histogram[n]
        self.plan = Plan(n_pieces=at)
        self.capacity = capacity
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)

    def open(self, times: int) -> list[tuple[int, int, int]]:
        """``times`` new sequences as one run (first, sequences, gap)."""
        self.plan.n_sequences += times
        return [(self.plan.n_sequences - times, times, self.capacity)]

    def put(self, n: int, first: int, times: int) -> None:
        """The next ``times`` pieces of length n into as many sequences from ``first`` on."""
        self.plan.ranges.append((self.rank[n], times, first))
        self.rank[n] += times
        self.left[n] -= times

    def place(self, runs: list[tuple[int, int, int]], group: list[int]) -> list[tuple[int, int, int]]:
        """One piece of a group of lengths (descending), the longest that wait, into every sequence of the runs; what gaps are left."""
        out = []
        for first, times, gap in runs:
            while times:
                n = next(n for n in group if self.left[n])
                some = min(times, self.left[n])
                self.put(n, first, some)
                out.append((first, some, gap - n))
                first, times = first + some, times - some
        return out

    def keep(self, runs: list[tuple[int, int, int]]) -> None:
        for first, times, gap in runs:
            if gap:
                self.gaps.setdefault(gap, []).append((first, times))

    def best_fit(self) -> None:
        """All that waits, longest first, each into the smallest gap that holds it, else into new sequences."""
        known = sorted(self.gaps)
        for n in self.lengths:
            while self.left[n]:
                k = bisect_left(known, n)
                if k == len(known):
                    per = self.capacity // n
                    whole, rest = divmod(self.left[n], per)
                    for times, pieces in ((whole, per), (1, rest)):
                        if times and pieces:
                            runs = self.open(times)
                            for _ in range(pieces):
                                runs = self.place(runs, [n])
                            self.keep(runs)
                            known = sorted(self.gaps)
                    continue
                gap = known[k]
                first, times = self.gaps[gap].pop()
                some = min(times, self.left[n])
                if not self.gaps[gap] and some == times:
                    del self.gaps[gap], known[k]
                if some < times:
                    self.gaps[gap].append((first + some, times - some))
                self.put(n, first, some)
                if gap > n:
                    if gap - n not in self.gaps:
                        insort(known, gap - n)
                    self.gaps.setdefault(gap - n, []).append((first, some))


def _classes(lengths: list[int], left: dict[int, int], most: int) -> list[list[int]]:
    """The lengths that wait (descending) in at most about ``most`` classes of neighbours with about as many pieces each."""
    share = sum(left[n] for n in lengths) / most
    classes: list[list[int]] = []
    held = share
    for n in lengths:
        if left[n]:
            if held >= share:
                classes.append([])
                held = 0
            classes[-1].append(n)
            held += left[n]
    return classes


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[float, list[list[int]]]]:
    """The program's solution: (times, the class of lengths of every place of a filling), most used first."""
    lengths = sorted((n for n, c in histogram.items() if c > 0), reverse=True)
    unit = 1 if len(lengths) <= FEW else max(1, capacity // CELLS)
    merged: dict[int, list[int]] = {}
    for c in _classes(lengths, histogram, CLASSES):  # classes of one size are one
        merged.setdefault(-(-c[0] // unit), []).extend(c)
    sizes = np.array(sorted(merged), np.int64)
    groups = [merged[k] for k in sizes.tolist()]
    demand = np.array([sum(histogram[n] for n in g) for g in groups], float)
    found = fractional_fillings(sizes, demand, capacity // unit) if len(sizes) else []
    return [(share, [groups[i] for i in np.flatnonzero(uses)[::-1].tolist() for _ in range(uses[i])]) for share, uses in found]


def rounded(histogram: dict[int, int], solution: list[tuple[float, list[list[int]]]], kept: float, capacity: int = CAPACITY) -> Plan:
    """``kept`` of the solution in whole sequences; all other pieces fill the gaps."""
    packer = _Packer(histogram, capacity)
    for share, places in solution:
        times = int(share * kept)
        for group in {id(g): g for g in places}.values():
            times = min(times, sum(packer.left[n] for n in group) // sum(g is group for g in places))
        if times:
            runs = packer.open(times)
            for group in places:
                runs = packer.place(runs, group)
            packer.keep(runs)
    packer.best_fit()
    return packer.plan


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the pieces go; the work depends on the number of different lengths, not of pieces.

    How much of the solution is best kept depends on how many short pieces there are to fill gaps: each of KEPT is tried, so that the
    plan is never worse than filling gaps alone.
    """
    solution = solve(histogram, capacity)
    return min((rounded(histogram, solution, k, capacity) for k in KEPT), key=lambda plan: plan.n_sequences)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, row) with sequence_id and offset. ``pieces`` is read several times."""
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # capacity rows at most
    plan = plan_packing(histogram, capacity)
    starts, sequences = plan.arrays()
    longer, rank = {}, 0
    for n in sorted(histogram, reverse=True):
        longer[n] = rank
        rank += histogram[n]
    table = pieces.sparkSession.sparkContext.broadcast((starts, sequences, np.array([longer.get(n, 0) for n in range(capacity + 1)], np.int64)))

    buckets = max(1, -(-plan.n_pieces // ROWS_PER_BUCKET))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    here = keyed.groupBy("bucket", "length").count()
    before = here.select("bucket", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "row"))
    ranked = keyed.withColumn("turn", turn).join(before, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequences, longer = table.value
        for batch in batches:
            rank = longer[batch.column(3).to_numpy()] + batch.column(5).to_numpy()
            k = np.searchsorted(starts, rank, "right") - 1
            sequence = sequences[k] + rank - starts[k] if len(k) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(rank, pa.int64())], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "rank"]
    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, rank bigint")
    in_sequence = Window.partitionBy("sequence_id").orderBy("rank")  # capacity rows at most
    return placed.select(*names[:6], (F.sum("length").over(in_sequence) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    return pack(materialise(token_pieces(docs, capacity, end_id, tokenizer), "pieces"), capacity)
