"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. Patterns are the windows of the benchmark items: ten consecutive words, or the whole item where it is
shorter. Patterns of one length share a machine: a block is the last two words of a position, the shift table says how far the
search may jump for a block, and blocks with shift 0 lead to a bucket of patterns by suffix; a bucket is split by its patterns'
first word and every pattern left is compared word by word.

Defined cases: null or wordless texts have no words, no hits; items without words have no windows; repeated items and repeated
documents are each reported; items with equal text all count; items without an id count as one with an empty id; documents keep
any other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import map_texts, materialise, slices, struct_of, struct_type, text_of

WINDOW = 10
BLOCK = 2
#: Windows of one pass: what the executors' search tables hold at once. More windows make more passes.
WINDOWS_PER_PASS = 200_000
PASSES_PER_STAGE = 2

#: Bytes that belong to no word become spaces, A-Z become a-z; all bytes of non-ASCII characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Machine:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.patterns = length, patterns
        self.block = min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(p[-self.block :], {}).setdefault(p[0], []).append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence, from left to right."""
        shift, bucket, jump, length, n = self.shift.get, self.bucket, self.jump, self.length, len(words)
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in self.patterns:
                    yield i, self.patterns[(w,)]
            return
        end = length
        while end <= n:
            key = (words[end - 2], words[end - 1])
            step = shift(key, jump)
            if step:
                end += step
                continue
            for p in bucket[key].get(words[end - length], ()):
                if all(a == b for a, b in zip(p, words[end - length : end], strict=True)):
                    yield end - length, self.patterns[p]
            end += 1


def machines(windows: list[tuple[str, str]]) -> list[Machine]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for window, item in windows:
        p = tuple(window.encode("utf-8", "surrogatepass").split(b" "))
        by_length.setdefault(len(p), {}).setdefault(p, []).append(item)
    return [Machine(n, p) for n, p in sorted(by_length.items())]


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item_id) rows of the benchmark; item_id as a string."""

    def work(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            w = [x.decode("utf-8", "surrogatepass") for x in words_of(t)]
            out.append(([" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else [],))
        return out

    made = map_texts(benchmark, work, struct_type("windows array<string>"), text, [item_id])
    return made.select(F.explode("found.windows").alias("window"), F.coalesce(F.col(f"doc.{item_id}").cast("string"), F.lit("")).alias("item_id")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, windows_per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """``doc`` (the kept columns) and ``found``: n_words, hits (disjoint [a, b) word ranges inside occurrences), items (sorted ids).

    The benchmark is searched in passes over blocks of about ``windows_per_pass`` windows at most, each sent to the executors as
    one bounded table; a block's hits join those of the blocks before. Documents are never shuffled.
    """
    spark = docs.sparkSession
    windows = materialise(item_windows(benchmark), "windows")
    passes = max(1, -(-windows.count() // windows_per_pass))
    block = F.pmod(F.xxhash64("window", "item_id"), F.lit(passes))
    found = struct_type("n_words bigint, hits array<struct<a:int,b:int>>, items array<string>")
    kept = docs.columns if keep is None else keep
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_of().alias("text"), F.lit(None).cast(found).alias("found"))
    for k in range(passes):
        table = spark.sparkContext.broadcast([tuple(r) for r in windows.where(block == k).collect()])
        last = k == passes - 1
        state = state.mapInArrow(_searcher(table, last), struct_of(state, ["doc", "found"] if last else ["doc", "text", "found"]))
        if not last and k % PASSES_PER_STAGE == PASSES_PER_STAGE - 1:
            state = materialise(state, "decontamination")
    return state


def decisions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, the words hit, the items found, and whether it is contaminated."""
    made = find_contamination(docs, benchmark, ["doc_id"])
    hit = F.expr("aggregate(found.hits, 0L, (n, h) -> n + h.b - h.a)")
    return made.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    made = find_contamination(docs, benchmark)
    return made.where(F.size("found.hits") == 0).select("doc.*")


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The machines of the block that this worker searched last.
_BUILT: dict[int, list[Machine]] = {}


def _searcher(table, last: bool):
    key = table._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = machines(table.value)
        for batch in slices(batches):
            rows = []
            for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                hits = [(h["a"], h["b"]) for h in before["hits"]] if before else []
                items = set(before["items"]) if before else set()
                for m in _BUILT[key]:
                    for a, found in m.search(words):
                        hits.append((a, a + m.length))
                        items.update(found)
                rows.append({"n_words": len(words), "hits": [{"a": a, "b": b} for a, b in _merge(hits)], "items": sorted(items)})
            made = pa.array(rows, _FOUND)
            columns = [batch.column(0), made] if last else [batch.column(0), batch.column(1), made]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "found"] if last else ["doc", "text", "found"])

    return run


_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
