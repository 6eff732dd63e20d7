"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the string kernel of common, possibly gapped, subsequences of three characters, divided by the words' norms:
inserted characters and spelled-out words still resemble an insult. Landmarks are words that tell toxic from other labelled
documents, by the z-score of their log odds, and some words drawn by hash; the landmarks' own kernel matrix whitens the kernel
values (Nyström). A linear support vector machine is trained on labelled sentences, each by the word of it that most resembles
telling landmarks. Its margin is linear in a word's subsequences, so that the landmarks fold into one weight for each subsequence:
scoring a word costs the same for any number of landmarks. A document counts by its most toxic sentence and by how many of its different
words are toxic or doubtful; a logistic fit makes that a probability.

Defined cases: a null or empty text has no sentences and the lowest score; without labels of both classes every score is 0;
labels other than 0 and 1 and those of held-out documents are not used; of several labels of a document the largest counts; words
longer than LONG characters count as overlapping windows of that length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import held_out, materialise, slices, struct_of, text_of
from brightfield.llm.learning import labelled_sample
from brightfield.llm.near_dedup import shingle_set

#: Landmarks by z-score and by hash, and how many words are looked at for the former.
TELLING, DRAWN, CANDIDATES = 96, 32, 1_000
#: A telling word that resembles a chosen one so closely adds nothing.
ALIKE = 0.9
#: The most labelled documents that the model is fitted on.
MOST = 20_000
#: A toxic document is learnt by so many words that most resemble telling ones and come so close to its best; another by so many.
TOXIC_WORDS, CLOSE, OTHER_WORDS = 3, 0.8, 4
#: What an error on a toxic example costs more than on another.
TOXIC_WEIGHT = 3.0
RIDGE, NEWTON_STEPS = 1e-3, 20
#: The margin over which a word counts as doubtful.
DOUBTFUL = -0.5
#: Margins count up to this size.
EXTREME = 1.5
#: Characters of a subsequence, and what each character that it spans costs.
ORDER, DECAY = 3, 0.95
#: Longer words are compared in windows that overlap by half.
LONG = 24
THRESHOLD = 0.5
#: Words that a worker remembers; the cache is emptied when full.
WORDS = 600_000

_TOKEN = re.compile(r"[^\W_]+(?:[^\w\s]{1,2}[^\W_]+)*")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[ .*_-]{1,2}[^\W\d_](?![^\W_])){3,}")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\S)[^.!?\n]+)*")
_OTHER = re.compile(r"[\W_]+")


def _word(token: str) -> str:
    return "^" + (token if token.isalnum() else _OTHER.sub("", token))


def tokens(low: str) -> list[str]:
    """The words of a lower-case text, ^ before each; characters put between letters stay in their word, and letters spelled out one by one
    make one word more."""
    return [_word(t) for t in _TOKEN.findall(low)] + [_word(t) for t in _SPELLED.findall(low)]


def windows(word: str) -> list[str]:
    """A word, or the overlapping windows of a long one."""
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


# ---- the kernel ----


def _codes(words: list[str]) -> np.ndarray:
    """Character codes of words of one length."""
    return np.array([list(map(ord, w)) for w in words], np.int32).reshape(len(words), -1)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of the rows of a with those of b (character codes): the dynamic program over gapped common subsequences."""
    n, width, other = len(a), a.shape[1], b.shape[1]
    before = np.ones((width + 1, other + 1, n))
    for order in range(ORDER):
        after, total = np.zeros((width + 1, other + 1, n)), np.zeros(n)
        for i in range(order + 1, width + 1):
            run = np.zeros(n)
            for j in range(order + 1, other + 1):
                hit = (a[:, i - 1] == b[:, j - 1]) * before[i - 1, j - 1] * DECAY**2
                total += hit
                run = DECAY * run + hit
                after[i, j] = DECAY * after[i - 1, j] + run
        before = after
    return total


def _self_kernel(a: np.ndarray) -> np.ndarray:
    """_kernel() of the rows with themselves: what it sums is symmetric, so half of it is enough."""
    n, width = len(a), a.shape[1]
    before, total = np.ones((width + 1, width + 1, n)), np.zeros(n)
    for order in range(ORDER):
        after, total = np.zeros((width + 1, width + 1, n)), np.zeros(n)
        for i in range(order + 1, width + 1):
            run = np.zeros(n)
            for j in range(order + 1, i + 1):
                hit = (a[:, i - 1] == a[:, j - 1]) * before[i - 1, j - 1] * DECAY**2
                total += hit if j == i else 2 * hit
                run = DECAY * run + hit
                after[i, j] = DECAY * (after[i - 1, j] if j < i else after[i, i - 1]) + run
        before = after
    return total


@lru_cache(maxsize=64)
def _places(length: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(length), ORDER)]


class Subsequences:
    """Numbers for the subsequences of some words; 0 is any other."""

    def __init__(self, words: list[str]):
        self.letters = np.array(sorted({ord(c) for w in words for c in w}), np.int32)
        size = len(self.letters) + 1  # the last letter stands for all others
        pairs: dict[tuple[int, int], int] = {}
        triples: dict[tuple[int, int], int] = {}
        for w in words:
            x = self._letters(_codes([w]))[0].tolist()
            for i, j, k, _ in _places(len(x)):
                pair = pairs.setdefault((x[i], x[j]), len(pairs) + 1)
                triples.setdefault((pair, x[k]), len(triples) + 1)
        self.pair = np.zeros((size, size), np.int32)
        for (x, y), k in pairs.items():
            self.pair[x, y] = k
        self.triple = np.zeros((len(pairs) + 1, size), np.int32)
        for (p, x), k in triples.items():
            self.triple[p, x] = k
        self.count = len(triples) + 1

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, codes)
        last = len(self.letters)
        return np.where((at < last) & (self.letters[np.minimum(at, last - 1)] == codes), at, last)

    def sums(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """For each word the sum of its normalised features by the rows of ``weights`` (one for each number)."""
        out = np.zeros((len(words), *weights.shape[1:]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) >= ORDER:
                by_length.setdefault(len(w), []).append(k)
        width, flat, triples = self.triple.shape[1], weights.ndim == 1, self.triple.ravel()
        by_place = weights[triples] if flat else None  # the weight of a pair's number and a letter
        for length, mine in by_length.items():
            codes = _codes([words[k] for k in mine])
            letters, total = self._letters(codes).T.copy(), np.zeros((len(mine), *weights.shape[1:]))
            pairs: dict[tuple[int, int], np.ndarray] = {}
            for i, j, k, decay in _places(length):
                if (i, j) not in pairs:
                    pairs[i, j] = self.pair[letters[i], letters[j]] * width
                at = pairs[i, j] + letters[k]
                total += decay * (by_place.take(at) if flat else weights[triples.take(at)])
            norm = np.sqrt(np.maximum(_self_kernel(codes), 1e-12))
            out[mine] = total / norm.reshape(-1, *[1] * (total.ndim - 1))
        return out

    def table(self, words: list[str]) -> np.ndarray:
        """The normalised features of the words themselves: a column for each."""
        out = np.zeros((self.count, len(words)))
        for m, w in enumerate(words):
            if len(w) < ORDER:
                continue
            x, codes = self._letters(_codes([w]))[0], _codes([w])
            for i, j, k, decay in _places(len(w)):
                out[self.triple[self.pair[x[i], x[j]], x[k]], m] += decay
            out[:, m] /= np.sqrt(_kernel(codes, codes)[0])
        return out


# ---- the model ----


@dataclass
class ToxicityModel:
    """The weight of each subsequence and of none (bias), and the logistic fit of a document's evidence."""

    subsequences: Subsequences | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = 0.0
    logistic: tuple[np.ndarray, float] = field(default_factory=lambda: (np.array([1.0, 0.0, 0.0]), 0.0))
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of words; a long one has that of its most toxic window."""
        parts = [windows(w) for w in words]
        flat = self.subsequences.sums([p for x in parts for p in x], self.weights)
        starts = np.cumsum([0] + [len(x) for x in parts[:-1]])
        return np.maximum.reduceat(flat, starts) + self.bias

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text: the margin of its most toxic sentence, which is that of its most toxic word, and the logarithms of one more than the
        numbers of its toxic and of its doubtful words."""
        own = [set(tokens(t.lower())) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set().union(*own).difference(self.known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.known.update(zip(some, self.margins(some).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for k, words in enumerate(own):
            x = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            out[k] = np.clip(x.max(initial=-EXTREME), -EXTREME, EXTREME), np.log1p((x > 0).sum()), np.log1p((x > DOUBTFUL).sum())
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.subsequences is None or not texts:
            return np.zeros(len(texts))
        slopes, start = self.logistic
        return 1 / (1 + np.exp(-(self.evidence(texts) @ slopes + start)))


def _counted_words(sample: DataFrame) -> DataFrame:
    """word, z (of its log odds) by the numbers of toxic and other documents that hold it."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            count: tuple[Counter, Counter] = Counter(), Counter()
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[label].update({p for w in set(tokens(t.lower())) for p in windows(w)})
            every = list(count[0] | count[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([count[y][x] for x in every], pa.int64()) for y in (1, 0)]], ["word", "toxic", "other"])

    total = sample.groupBy().agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    counts = sample.select("text", "label").mapInArrow(words, "word string, toxic bigint, other bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).crossJoin(total)  # one row of totals
    cells = [F.col("a") + 0.5, F.col("n1") - F.col("a") + 0.5, F.col("b") + 0.5, F.col("n0") - F.col("b") + 0.5]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    return counts.select("word", (odds / F.sqrt(sum(1 / c for c in cells))).alias("z"))


def choose_landmarks(words: list[str], most: int = TELLING) -> list[str]:
    """Telling words from the best on, without those that resemble a chosen one closely."""
    if not words:
        return []
    known = Subsequences(words)
    table = known.table(words)
    taken: list[int] = []
    for k in range(len(words)):
        if len(taken) < most and (not taken or (table[:, taken].T @ table[:, k]).max() < ALIKE):
            taken.append(k)
    return [words[k] for k in taken]


def _without_copies(sample: DataFrame) -> DataFrame:
    """One of the sample's texts for each least shingle, lest a group of near copies makes its own words telling."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([int(s[0] >> np.uint64(1)) if len(s) else None for s in sets], pa.int64())], ["text", "label", "part", "least"])

    made = sample.mapInArrow(least, "text string, label int, part int, least bigint")
    turn = F.row_number().over(Window.partitionBy("least", "label").orderBy(F.xxhash64("text"), "part"))
    return made.withColumn("turn", turn).where(F.col("least").isNotNull() & (F.col("turn") == 1)).select("text", "label", "part")


def _support_vectors(rows: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """The slopes and bias of a linear support vector machine with squared hinge loss, by Newton steps whose sums the partitions make."""
    w = np.zeros(size + 1)
    for _ in range(NEWTON_STEPS):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 3, size + 1))
            for b in batches:
                if b.num_rows:
                    x = np.hstack([b.column(0).flatten().to_numpy().reshape(b.num_rows, size), np.ones((b.num_rows, 1))])
                    side = 2 * b.column(1).to_numpy() - 1
                    short = np.maximum(1 - side * (x @ w), 0)
                    cost = np.where(side > 0, TOXIC_WEIGHT, 1.0)
                    inside = x * (cost * (short > 0))[:, None]
                    total[:-1] += np.vstack([inside.T @ x, -(side * short) @ inside])
                    total[-1, 0] += cost.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        found = rows.select("x", "label").coalesce(4).mapInArrow(sums, "total binary").collect()  # four sums, of fixed size
        total = sum(np.frombuffer(r["total"]).reshape(size + 3, size + 1) for r in found)
        ridge = RIDGE * total[-1, 0] * np.diag([1.0] * size + [1e-6])
        step = np.linalg.solve(total[:-2] + ridge, total[-2] + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> ToxicityModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    sample = labelled_sample(docs, labels, "toxic", most).select(text_of().alias("text"), "label", "part")
    sample = materialise(_without_copies(sample), "toxicity-sample")
    if {r["label"] for r in sample.select("label").distinct().collect()} != {0, 1}:
        return ToxicityModel()
    counted = materialise(_counted_words(sample), "toxicity-words")
    best = {r["word"]: r["z"] for r in counted.orderBy(F.desc("z"), "word").limit(CANDIDATES).collect()}
    telling = choose_landmarks(list(best))
    drawn = [r["word"] for r in counted.orderBy(F.xxhash64("word"), "word").limit(DRAWN).collect()]
    landmarks = list(dict.fromkeys([*telling, *drawn]))
    known = Subsequences(landmarks)
    table = known.table(landmarks)
    values, vectors = np.linalg.eigh(table.T @ table)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    z = np.array([max(best[w], 0.0) for w in telling])

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.lower() for t in b.column(0).to_pylist()]
            words = sorted({p for t in texts for w in tokens(t) for p in windows(w)})
            like = {}
            for i in range(0, len(words), 4_000):
                some = words[i : i + 4_000]
                like.update(zip(some, (known.sums(some, table)[:, : len(z)] * z).max(1).tolist(), strict=True))
            chosen: dict[tuple[str, float], None] = {}
            for t, label in zip(texts, b.column(1).to_pylist(), strict=True):
                witness = {max(own, key=lambda w: (like[w], w)) for s in _SENTENCE.findall(t) if (own := [p for w in tokens(s) for p in windows(w) if p in like])}
                best = sorted(((like[w], w) for w in witness), reverse=True)
                chosen.update(((w, float(label)), None) for v, w in best[: TOXIC_WORDS if label else OTHER_WORDS] if not label or v >= CLOSE * best[0][0])
            found = list(chosen)
            for i in range(0, len(found), 4_000):
                some = found[i : i + 4_000]
                x = known.sums([w for w, _ in some], table) @ whiten
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([y for _, y in some], pa.float64())], ["word", "x", "label"])

    rows = materialise(sample.select("text", "label").mapInArrow(sentences, "word string, x array<double>, label double"), "toxicity-sentences")
    # A word stands once among the others, whatever the number of documents.
    rows = rows.where("label = 1").select("x", "label").unionByName(rows.where("label = 0").dropDuplicates(["word"]).select("x", "label"))
    slopes, bias = _support_vectors(materialise(rows, "toxicity-examples"), len(landmarks))
    model = ToxicityModel(known, table @ (whiten @ slopes), bias)
    model.weights[0] = 0.0

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.evidence(b.column(0).to_pylist()).tolist(), pa.list_(pa.float64())), b.column(1).cast(pa.float64())], ["x", "label"])

    found = sample.select("text", "label").mapInArrow(evidence, "x array<double>, label double")
    found = found.select(array_to_vector("x").alias("features"), "label", F.when(F.col("label") == 1, TOXIC_WEIGHT).otherwise(1.0).alias("weight")).cache()
    # A more toxic or further toxic word never speaks for a document; doubtful words may.
    least = Matrices.dense(1, 3, [0.0, 0.0, -np.inf])
    fit = LogisticRegression(maxIter=100, regParam=1e-4, weightCol="weight", lowerBoundsOnCoefficients=least).fit(found)
    found.unpersist()
    model.logistic = fit.coefficients.toArray(), float(fit.intercept)
    return model


def with_scores(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the kept columns) and ``score``: a narrow projection."""
    kept = docs.columns if keep is None else keep
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["doc", "score"])

    return base.mapInArrow(run, T.StructType([*struct_of(base, ["doc"]), T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    made = with_scores(docs, fit_toxicity(docs, labels), ["doc_id"]).select("doc.doc_id", "score")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
