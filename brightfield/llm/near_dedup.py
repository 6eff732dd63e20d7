"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of hashed word shingles and a MinHash signature. Texts with equal sets form a class; only the class's
   least document goes on.
2. Signatures are cut in bands. Classes that share a band are candidates of each other; every class of a bucket is tied to the
   bucket's least class, and the ties' connected components are clusters: no candidate pair lies across two of them.
3. A cluster's sets meet in one task, or, past a weight, in chunks: first each chunk with itself and the cluster's least class,
   then members outside the cluster's largest component so far with the chunks of all others; where many stay outside, only with
   the members of their own buckets. Members that are linked already are not compared again, so a tight group of any size costs
   about one comparison for each member, and a loose heavy cluster moves a set once for each of its bands at most.
4. A comparison looks at the signature batch by batch and stops when the posterior probability that the similarity reaches the
   threshold falls under the miss probability. Survivors are verified on the full sets. A spanning forest of the verified links
   is kept, and its components are the result.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer words than a shingle is one
shingle; rows with one doc_id are one document in the graph; ties go to the least doc_id. A row without an id is nobody's partner: if its
set equals that of a document with an id it has that one's component and is not kept, else its component is null and it is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import materialise, slices, text_of
from brightfield.llm.graph import connected_components

WORDS = 5


@dataclass(frozen=True)
class Rule:
    """Links have 100 * intersection >= percent * union; signatures have bands of some rows."""

    percent: int
    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def batches(self) -> list[int]:
        """Hashes that a comparison has looked at by each decision."""
        return [self.hashes * k // 4 for k in range(1, 5)]


#: At 85 % a pair shares no band with probability (1 - .85**6)**24, about 1e-5; at 80 % with (1 - .8**5)**28, about 1.5e-5.
AT_85, AT_80 = Rule(85, 24, 6), Rule(80, 28, 5)
#: A candidate is dropped when the posterior probability of a link is below this.
MISS = 1e-6
#: Shingles that one task holds for a cluster; heavier clusters are split into chunks.
CHUNK_SHINGLES = 1_500_000
#: Chunks of members outside a heavy cluster's largest component up to which they meet all its other members.
LOOSE = 12

#: Bytes of white space become spaces and A-Z become a-z.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_HASHES = 144
_rng = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _rng.integers(1, 2**63, _HASHES, dtype=_U) * _U(2) + _U(1)
_OFFSETS = _rng.integers(0, 2**63, _HASHES, dtype=_U)
_PLACES = _rng.integers(1, 2**63, 16, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k, inverse = len(self.up), pow(_BASE, -1, 2**64)
            self.up = np.concatenate([self.up, self.up * _U(pow(_BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(inverse, k, 2**64))])
        return self.up, self.down


_POWERS = _Powers()


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes: one polynomial hash per word, mixed and combined by place."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, _U)
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * down[starts])
    if len(word) < words:
        whole = (word * _PLACES[: len(word)]).sum(dtype=_U) + _U(len(word))
        return _mix(np.array([whole], _U))
    n = len(word) - words + 1
    total = np.zeros(n, _U)
    for k in range(words):
        total += word[k : k + n] * _PLACES[k]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray, hashes: int = _HASHES) -> np.ndarray:
    """16 bits of each minimum over the set."""
    least = np.full(hashes, np.iinfo(_U).max, _U)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _FACTORS[:hashes]
        part += _OFFSETS[:hashes]
        np.minimum(least, part.min(0), out=least)
    return (least >> _U(40)).astype(np.uint16)


@lru_cache
def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """Matches among ``n`` hashes below which P(similarity >= percent), from a uniform prior, is under ``miss``."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


# ---- what a task does with the sets that meet in it ----


class Members:
    """Documents that meet in one task: ids, set sizes, signatures, and their sets over a shared code."""

    def __init__(self, rule: Rule, ids: list[int], signatures: list[bytes], sets: list[bytes]):
        self.rule, self.ids = rule, ids
        self.signatures = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(ids), rule.hashes)
        values, self.codes = np.unique(np.frombuffer(b"".join(sets), _U), return_inverse=True)
        self.sizes = np.array([len(s) // 8 for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.mark = np.zeros(len(values), bool)
        #: The component that a member is known to be in.
        self.label = np.arange(len(ids))

    def intersections(self, k: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.ends[k] - self.sizes[k] : self.ends[k]]
        self.mark[own] = True
        sizes = self.sizes[others]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(self.ends[others] - stops, sizes)
        shared = np.add.reduceat(self.mark[self.codes[at]].astype(np.int64), stops - sizes)
        self.mark[own] = False
        return shared

    def candidates(self, k: int, others: np.ndarray) -> np.ndarray:
        """Of ``others``: those that share a band with k and survive every batch of its signature."""
        if not len(others):
            return others
        a, b = self.sizes[k], self.sizes[others]
        others = others[100 * np.minimum(a, b) >= self.rule.percent * np.maximum(a, b)]
        if not len(others):
            return others
        same = self.signatures[others] == self.signatures[k]
        same = same[banded := same.reshape(-1, self.rule.bands, self.rule.rows).all(2).any(1)]
        others, matches, done = others[banded], 0, 0
        for n in self.rule.batches:
            matches = matches + same[:, done:n].sum(1)
            alive = matches >= least_matches(n, self.rule.percent)
            others, same, matches, done = others[alive], same[alive], matches[alive], n
        return others

    def link(self, k: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Unite k with those of ``others`` that the full sets confirm; yields one link for each union."""
        others = self.candidates(k, others[self.label[others] != self.label[k]])
        if not len(others):
            return
        shared = self.intersections(k, others)
        linked = others[100 * shared >= self.rule.percent * (self.sizes[k] + self.sizes[others] - shared)]
        for o in linked.tolist():
            if self.label[o] != self.label[k]:
                self.label[self.label == self.label[o]] = self.label[k]
                yield self.ids[k], self.ids[o]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal leading ``keys`` columns, which come sorted, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *changes.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _link_groups(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links within groups (root, x, y): columns root, x, y, side, part, id, signature, shingles.

    Groups with x = y compare all members with each other; in others those of side 0, whose links are still open, meet those
    of side 1. part is the component known so far.
    """
    for table in _groups(batches, 3):
        if table.num_rows < 2:
            continue
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        x, y = table.column(1)[0].as_py(), table.column(2)[0].as_py()
        m = Members(rule, table.column(5).to_pylist(), table.column(6).to_pylist(), table.column(7).to_pylist())
        seen: dict[int, int] = {}
        for k, part in enumerate(table.column(4).to_pylist()):
            first = seen.setdefault(part, k)
            m.label[k] = first
        side = np.array(table.column(3).to_pylist())
        every, links = np.arange(table.num_rows), []
        if x == y:
            for k in range(table.num_rows - 1):
                links.extend(m.link(k, every[k + 1 :]))
        else:
            right = every[side == 1]
            for k in every[side == 0].tolist():
                links.extend(m.link(k, right))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# ---- the jobs ----


def _sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets, null for empty ones), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, signatures = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s, rule.hashes).tobytes() if len(s) else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_id", "signature"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id binary, signature binary")


def _bands(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, rule.bands, rule.rows)
        key = np.zeros(signatures.shape[:2], _U)
        for r in range(rule.rows):
            key = _mix(key ^ signatures[:, :, r].astype(_U)) * _PLACES[r]
        key = _mix(key + np.arange(rule.bands, dtype=_U)).view(np.int64).reshape(-1)
        ids = np.repeat(batch.column(0).to_numpy(), rule.bands)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], ["band", "id"])


def _with_sets(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``members`` (id, …) with signature and shingles, the whole set of 64-bit hashes, recomputed from the texts."""
    kept = [c for c in members.columns if c != "id"]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_of().alias("text"))
    joined = texts.join(members, "id").select("id", "text", F.struct(*kept).alias("known"))
    schema = T.StructType([joined.schema["id"], joined.schema["known"], T.StructField("signature", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            signatures, sets = [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                signatures.append(signature(s, rule.hashes).tobytes())
                sets.append(s.tobytes())
            arrays = [batch.column(0), batch.column(2), pa.array(signatures, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "known", "signature", "shingles"])

    made = joined.mapInArrow(run, schema)
    return made.select("id", "known.*", "signature", "shingles")


def _links(groups: DataFrame, rule: Rule) -> DataFrame:
    """Links of the groups (root, x, y) that the rows form: side, part, id, signature, shingles."""
    spread = groups.select("root", "x", "y", "side", "part", "id", "signature", "shingles").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return spread.mapInArrow(lambda batches: _link_groups(batches, rule), "a bigint, b bigint")


def find_components(docs: DataFrame, chunk_shingles: int = CHUNK_SHINGLES, rule: Rule = AT_85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketch = materialise(_sketch(docs, rule), "sketch")
    classes = sketch.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")

    least = classes.select("id", "set_id").withColumnRenamed("set_id", "of")
    signed = sketch.join(least, (sketch["doc_id"] == least["id"]) & (sketch["set_id"] == least["of"])).select("id", "signature")
    bands = materialise(signed.mapInArrow(lambda batches: _bands(batches, rule), "band bigint, id bigint"), "bands")
    buckets = bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where(F.col("least") != F.col("most"))
    ties = bands.join(buckets, "band").select(F.col("id").alias("a"), F.col("least").alias("b"))
    clusters = materialise(connected_components(ties), "clusters")

    sizes = sketch.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n"))
    sized = clusters.join(sizes, "node")
    chunks = sized.groupBy("component").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("chunks"), F.count("*").alias("members"))
    known = clusters.join(chunks, "component").select(F.col("node").alias("id"), F.col("component").alias("root"), "chunks")
    known = known.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    members = materialise(_with_sets(docs, known, rule), "members")

    # Every chunk with itself; the cluster's least member visits all chunks, so that a tight group is linked through it.
    visits = F.when((F.col("chunks") > 1) & (F.col("id") == F.col("root")), F.expr("sequence(0, chunks - 1)")).otherwise(F.array("chunk"))
    within = members.withColumn("x", F.explode(visits)).select("root", "x", F.col("x").alias("y"), F.lit(0).alias("side"), F.col("id").alias("part"), "id", "signature", "shingles")
    links = materialise(_links(within, rule), "links")

    heavy = members.where(F.col("chunks") > 1)
    if heavy.limit(1).count():
        links = links.unionByName(materialise(_links(_across(heavy, connected_components(links), bands, chunk_shingles), rule), "links"))
    components = connected_components(links)

    named = classes.join(components.withColumnRenamed("node", "id"), "id", "left")
    named = named.where((F.col("copies") > 1) | F.col("component").isNotNull()).select("set_id", F.coalesce("component", "id").alias("component"))
    found = sketch.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), component.isNull())
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _across(heavy: DataFrame, components: DataFrame, bands: DataFrame, chunk_shingles: int) -> DataFrame:
    """Groups in which a member of a heavy cluster outside its largest component meets others: all, or those of its buckets.

    To meet all, a set moves once for each chunk of members outside; where those are more than LOOSE chunks, buckets move it less.
    """
    parts = heavy.select("id", "root", "chunk", "chunks", F.expr("length(shingles) div 8").alias("n")).join(components.withColumnRenamed("node", "id"), "id", "left")
    parts = parts.withColumn("part", F.coalesce("component", "id"))
    counted = parts.groupBy("root", "part").count()
    largest = counted.groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
    parts = parts.join(largest, "root").withColumn("open", F.col("part") != F.col("largest"))
    loose = parts.where("open").groupBy("root").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("loose"))
    parts = parts.join(loose, "root").withColumn("turn", F.when(F.col("open"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("loose")).cast("int")))
    every = heavy.select("id", "signature", "shingles").join(parts.select("id", "root", "part", "open", "chunk", "chunks", "turn", "loose", "n"), "id")
    placed = every.where(F.col("loose") <= LOOSE)
    left = placed.where("open").select("root", F.col("turn").alias("x"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("y"), F.lit(0).alias("side"), "part", "id", "signature", "shingles")
    right = placed.select("root", F.explode(F.expr("sequence(0, loose - 1)")).alias("x"), F.col("chunk").alias("y"), F.lit(1).alias("side"), "part", "id", "signature", "shingles")
    # x and y number different things here; y moves off so that no group looks like a chunk with itself.
    in_chunks = left.unionByName(right).withColumn("y", -1 - F.col("y"))

    spread = every.where(F.col("loose") > LOOSE).join(bands, "id")
    weights = spread.groupBy("band").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("parts"), F.ceil(F.sum(F.when(F.col("open"), F.col("n"))) / chunk_shingles).cast("int").alias("turns"), F.count("*").alias("size"))
    # A bucket without members outside has nothing to compare; a heavy one meets in parts.
    spread = spread.join(weights.where("turns > 0 AND size > 1"), "band")
    row = ["part", "id", "signature", "shingles"]
    left = spread.where("open").select(F.col("band").alias("root"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("turns")).cast("int").alias("x"), F.explode(F.expr("sequence(0, parts - 1)")).alias("y"), F.lit(0).alias("side"), *row)
    right = spread.select(F.col("band").alias("root"), F.explode(F.expr("sequence(0, turns - 1)")).alias("x"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("y"), F.lit(1).alias("side"), *row)
    in_buckets = left.unionByName(right).withColumn("y", -1 - F.col("y"))
    return in_chunks.unionByName(in_buckets)


def kept_documents(docs: DataFrame, rule: Rule = AT_80) -> DataFrame:
    """One document of each component, with the columns it came with; rows without an id stay."""
    removed = find_components(docs, rule=rule).where(~F.col("kept")).select(F.col("doc_id").alias("__removed")).distinct()
    return docs.join(removed, F.col("doc_id").cast("bigint") == F.col("__removed"), "left_anti")
