"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a short vector of statistics. Cosines of random projections of the standardised vector approximate a Gaussian
kernel. Every partition of the labelled sample sums its part of the normal equations; the sums meet on the driver, where they are
as large as the number of features squared. A quarter of the sample is kept from the fit for the isotonic calibration.

Defined cases: a null or empty text has all-zero statistics and is scored like any other; without labels every score is 0.5;
labels other than 0 and 1 and labels of held-out documents are not used; of several labels of a document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import held_out, materialise, slices, struct_of, text_of
from brightfield.llm.learning import TRAIN_DOCUMENTS, isotonic, labelled_sample

COSINES = 256
RIDGE = 1e-3
SEED = 11
THRESHOLD = 0.3

_BYTES = np.arange(256)
_GROUPS = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES == 32,
    _BYTES == 10,
    _BYTES >= 128,
    _BYTES == 124,
    _BYTES == 33,
    np.isin(_BYTES, [35, 36, 37, 38, 42, 64]),
    np.isin(_BYTES, [44, 46]),
    np.isin(_BYTES, [60, 61, 62, 91, 92, 93, 94, 95, 96, 123, 125, 126]),
    _BYTES < 32,
]).T.astype(np.float64)
STATISTICS = _GROUPS.shape[1] + 10


def statistics(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return np.zeros(STATISTICS)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUPS / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, different = len(words), len(set(words))
    sentences = 1 + raw.count(b". ") + raw.count(b".\n")
    length = (len(raw) - raw.count(b" ")) / n
    first = set(words[: n // 2])
    more = [
        np.log1p(len(raw)),
        length,
        different / n,
        np.log1p(different) / np.log1p(n),
        1 - len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)),
        min(n / sentences, 200) / 200,
        np.log1p(max(map(len, words))),
        sum(w in first for w in words[n // 2 :]) / max(1, n - n // 2),
        np.log1p(len(max(lines, key=len))),
    ]
    return np.concatenate([shares, more])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale) @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        raw = self.raw(np.stack([statistics(t) for t in texts]))
        # A thousandth of the score keeps the order of texts inside a level of the isotonic fit.
        return 0.999 * np.clip(np.interp(raw, *self.knots), 0, 1) + 0.001 / (1 + np.exp(-4 * (np.clip(raw, -5, 5) - 0.5)))


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((STATISTICS, COSINES)) / np.sqrt(STATISTICS / 2)
    shift = rng.uniform(0, 2 * np.pi, COSINES)
    z = np.sqrt(2 / COSINES) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + shift)
    return np.hstack([z, np.ones((len(x), 1))])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> QualityModel:
    sample = labelled_sample(docs, labels, "quality", most).select(text_of().alias("text"), "label", "part")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([statistics(t).tolist() for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2)], ["x", "label", "part"])

    measured = materialise(sample.mapInArrow(measure, "x array<double>, label int, part int"), "quality-sample")
    train = measured.where("part > 0")
    moments = train.agg(*[f(F.col("x")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    none = QualityModel(np.zeros(0), np.zeros(0), np.zeros(0), (np.zeros(0), np.zeros(0)))
    if moments[0] is None:
        return none
    mean, scale = np.array(moments[0::2], float), np.maximum(np.array(moments[1::2], float), 1e-3)
    size = COSINES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                z = features(np.array(b.column(0).to_pylist()), mean, scale)
                total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = train.select("x", "label").coalesce(8).mapInArrow(sums, "total binary").collect()  # eight sums, of fixed size
    total = sum(np.frombuffer(r["total"]).reshape(size, size + 1) for r in parts)
    weights = np.linalg.solve(total[:, :size] + RIDGE * max(1.0, total[-1, size - 1]) * np.eye(size), total[:, size])
    model = QualityModel(mean, scale, weights, (np.zeros(1), np.zeros(1)))
    kept = measured.where("part = 0").select("x", "label").collect()  # bounded by the sample
    if not kept:
        kept = train.select("x", "label").collect()
    model.knots = isotonic(model.raw(np.array([r["x"] for r in kept])), np.array([r["label"] for r in kept], float))
    return model


def with_scores(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the kept columns) and ``score``: a narrow projection."""
    kept = docs.columns if keep is None else keep
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["doc", "score"])

    return base.mapInArrow(run, T.StructType([*struct_of(base, ["doc"]), T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    made = with_scores(docs, fit_quality(docs, labels), ["doc_id"]).select("doc.doc_id", "score")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    return with_scores(docs, fit_quality(docs, labels)).where(F.col("score") >= threshold).select("doc.*")
