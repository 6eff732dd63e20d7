"""Periodic runs of words: stretches that repeat with a period, by the suffix tree of each document.

After Stoye and Gusfield: the node of depth q over words i and i + q, in different children, is a branching tandem repeat; listing the
leaves of all children but the largest of every node finds them all. Rotated to the left while the word before agrees, and merged, the
branching repeats are the maximal runs: such a repeat ends where its run ends, and of repeats that share a run the shortest period
counts.

A batch of documents is worked on at once in numpy. Every document has an alphabet of its own and an end mark, so the tree is a forest
with one tree for each document. Its nodes are intervals of the suffix array: suffixes are sorted by doubling (only those that are not
alone yet), common prefixes are counted where the word before differs (all others follow from their neighbour), and intervals are
found by pointer jumping.

Defined cases: a null, empty or blank text has no words, no runs, and collapses to the empty text; a document without an id keeps its words as
they are; repeated rows have equal results; ties for the longest run go to the smallest start, then period; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brightfield.llm.common import slices, text_of

#: The shortest run in words; in periods it is two.
LEAST = 12
#: Leaves listed at once.
LEAVES = 2_000_000


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks. Of any two suffixes, one meets a code that occurs nowhere else before the array ends."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at ``slots``, given where groups start; the slots of groups with several members."""
        first = np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))
        rank[order[slots]] = slots[first]
        alone = starts & np.append(starts[1:], True)
        return slots[~alone]

    sorted_codes = codes[order]
    slots = regroup(np.arange(n), np.append(True, sorted_codes[1:] != sorted_codes[:-1])[:n])
    step = 1
    while len(slots):
        some = order[slots]
        key = rank[some] * n + rank[some + step]
        turn = np.argsort(key, kind="stable")
        order[slots] = some[turn]
        key = key[turn]
        slots = regroup(slots, np.append(True, key[1:] != key[:-1]))
        step *= 2
    return order, rank


def matching(codes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from positions a and b on (step 1), or from there backwards (step -1). Ends of the array disagree."""
    n, out = len(codes), np.zeros(len(a), np.int64)
    live, width = np.arange(len(a)), 4
    while len(live):
        reach = step * np.arange(width)
        x, y = (a[live] + step * out[live])[:, None] + reach, (b[live] + step * out[live])[:, None] + reach
        same = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        same &= codes[np.clip(x, 0, n - 1)] == codes[np.clip(y, 0, n - 1)]
        agreed = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[live] += agreed
        live = live[agreed == width]
        width = min(4096, max(4, 200_000 // max(1, len(live))), width * 4)
    return out


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that the suffixes at k - 1 and k of the array share. Only where the words before differ are they counted one by one."""
    n = len(codes)
    before = np.empty(n, np.int64)  # the suffix before each one in the array
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    i = np.arange(n)
    known = (before > 0) & (i > 0)
    known[known] = codes[i[known] - 1] == codes[before[known] - 1]
    counted = np.flatnonzero(~known)
    length = np.zeros(n, np.int64)
    real = counted[before[counted] >= 0]
    length[real] = matching(codes, real, before[real], 1)
    origin = np.maximum.accumulate(np.where(known, 0, i))
    return (length[origin] - (i - origin))[order]


def nearest(shared: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or after (1) with no more."""
    at = np.arange(len(shared)) + step
    live = np.arange(1, len(shared) - 1)
    while len(live):
        live = live[shared[at[live]] > shared[live]]
        at[live] = at[at[live]]
    return at


def tandem_repeats(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All branching tandem repeats (start, period): the leaves of every child but the largest are looked up in their node."""
    n = len(codes)
    shared = np.append(common_prefixes(codes, order, rank), -1)  # shared[k]: between k - 1 and k
    shared[0] = -1
    before, after = nearest(shared, -1), nearest(shared, 1)
    inner = np.flatnonzero(shared > 0)
    first = np.arange(n + 1)  # the first boundary of the node that a boundary belongs to
    chained = inner[shared[before[inner]] == shared[inner]]
    first[chained] = before[chained]
    last = np.arange(n + 1)
    chained_on = inner[shared[after[inner]] == shared[inner]]
    last[chained_on] = after[chained_on]
    for link, live in ((first, chained), (last, chained_on)):
        while len(live):
            further = link[link[live]]
            moved = further != link[live]
            link[live] = further
            live = live[moved]
    # a child begins at every boundary of its node, and one before the first boundary
    heads = inner[first[inner] == inner]
    low = np.concatenate([inner, before[heads]])
    high = np.concatenate([after[inner], heads])  # exclusive
    node = np.concatenate([first[inner], heads])
    size = high - low
    by_size = np.lexsort((size, node))
    largest = by_size[np.append(node[by_size][1:] != node[by_size][:-1], True)] if len(node) else by_size
    small = np.ones(len(node), bool)
    small[largest] = False
    low, high, node = low[small], high[small], node[small]
    size = high - low
    node_low, node_high, depth = before[node], after[last[node]], shared[node]

    found = []
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, "right")))
        sizes = size[at:upto]
        child = np.repeat(np.arange(at, upto), sizes)
        leaf = order[low[child] + np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        q, a, b = depth[child], node_low[child], node_high[child]
        for start, other in ((leaf, leaf + q), (leaf - q, leaf - q)):  # the leaf that is looked up
            inside = (other >= 0) & (other < n)
            place = rank[np.where(inside, other, 0)]
            inside &= (place >= a) & (place < b)
            s, p = start[inside], q[inside]
            branching = codes[s + p] != codes[s + 2 * p]
            found.append(np.stack([s[branching], p[branching]]))
        at = upto
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def runs(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (start, length, period) of at least ``least`` words and two periods, ordered by start, then period.

    ``codes``: numbers of words, with a number that occurs nowhere else after every document.
    """
    nothing = np.zeros(0, np.int64)
    if not len(codes):
        return nothing, nothing, nothing
    order, rank = suffix_ranks(codes)
    start, period = tandem_repeats(codes, order, rank)
    end = start + 2 * period
    turn = np.lexsort((period, end))
    start, period, end = start[turn], period[turn], end[turn]
    out = []
    while len(end):  # the shortest period of every end; a longer one that its run covers is a multiple of it
        head = np.append(True, end[1:] != end[:-1])
        s, p, e = start[head], period[head], end[head]
        s = s - matching(codes, s - 1, s + p - 1, -1)
        out.append(np.stack([s, e - s, p]))
        mine = np.cumsum(head) - 1
        multiple = (period % p[mine] == 0) & (start >= s[mine])
        rest = ~head & ~multiple
        start, period, end = start[rest], period[rest], end[rest]
    if not out:
        return nothing, nothing, nothing
    s, length, p = np.concatenate(out, axis=1)
    long_enough = length >= np.maximum(least, 2 * p)
    s, length, p = s[long_enough], length[long_enough], p[long_enough]
    turn = np.lexsort((p, s))
    return s[turn], length[turn], p[turn]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words, the words by number, and where documents begin (one more than there are documents)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = pc.list_flatten(parts)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(real))[np.asarray(parts.offsets) - parts.offsets[0].as_py()].astype(np.int64)
    made = pc.dictionary_encode(flat.filter(pa.array(real)))
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary, starts


def stretched(doc_ids: list, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The words of documents that their id's hash chooses repeat from some word on."""
    codes = codes.copy()
    for k, doc in enumerate(doc_ids):
        n = int(starts[k + 1] - starts[k])
        h = zlib.crc32(str(doc).encode())
        if n and doc is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            mine = codes[starts[k] : starts[k + 1]]
            mine[a:] = mine[a + np.arange(n - a) % p]
    return codes


def digests(doc_ids: list, texts: pa.Array) -> list[tuple]:
    """For each document: n_runs, the longest run's four numbers, and the two digests."""
    codes, words, starts = _words(texts)
    codes = stretched(doc_ids, codes, starts)
    count = np.diff(starts)
    number = np.repeat(np.arange(len(count)), count)
    # a document's words are numbered apart from all others', and one more number ends it
    apart = np.insert(number * (len(words) + 1) + codes, starts[1:], np.arange(len(count)) * (len(words) + 1) + len(words))
    first = starts[:-1] + np.arange(len(count))
    start, length, period = runs(apart)
    of = np.searchsorted(first, start, "right") - 1
    start = start - first[of]

    # words after a run's first period are dropped
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, starts[of] + start + period, 1)
    np.add.at(edge, starts[of] + start + length, -1)
    kept = np.cumsum(edge)[:-1] == 0
    offsets = np.append(0, np.cumsum(kept))[starts]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(codes[kept])))
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()

    out = []
    bounds = np.searchsorted(of, np.arange(len(count) + 1)).tolist()
    numbers = np.stack([start, length, period], axis=1).tolist()
    for k, text in enumerate(joined):
        mine = numbers[bounds[k] : bounds[k + 1]]
        best = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else (None, None, None)
        exponent = 1000 * best[1] // best[2] if mine else None
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in mine)
        out.append((len(mine), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


_FIELDS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256. Narrow: no shuffle."""
    base = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = digests(batch.column(0).to_pylist(), batch.column(1))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
            made = [pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *_FIELDS])

    kinds = ", ".join(f"{name} {'bigint' if kind == pa.int64() else 'string'}" for name, kind in _FIELDS.items())
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {kinds}")
