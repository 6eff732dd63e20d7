"""What the trained classifiers share: labelled samples and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import held_out

#: The most labelled documents that a classifier is fitted on; a hash of the id chooses among more.
TRAIN_DOCUMENTS = 50_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, text, label (0 or 1), part (0 to 3, by hash) of at most ``most`` labelled documents that are not held out.

    The chosen ids are bounded by ``most``, so they are broadcast and the texts stay where they are.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing fit by pooling adjacent violators, as points to interpolate between: both ends of each level."""
    order = np.argsort(score, kind="stable")
    values, starts = np.unique(score[order], return_index=True)
    means = np.add.reduceat(label[order].astype(float), starts) / np.diff([*starts, len(order)]) if len(order) else np.zeros(0)
    blocks: list[list[float]] = []  # least and greatest score, mean label, weight
    for value, mean, weight in zip(values.tolist(), means.tolist(), np.diff([*starts, len(order)]).tolist(), strict=True):
        blocks.append([value, value, mean, float(weight)])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, y1, w1 = blocks.pop()
            lo, _, y0, w0 = blocks.pop()
            blocks.append([lo, hi, (y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1])
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[2] for b in blocks for _ in range(2)])
