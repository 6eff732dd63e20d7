"""Whitening against the whole covariance, its eigenvectors, and exact sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.llm import queries, whitening
from brightfield.llm.common import table
from tests.conftest import SF

VECTORS = "vec_id long, embedding array<double>, component string, n double"


def brute(vectors, components=4):
    """(n, exact sums, eigenvalues, eigenvectors, trace) of the distinct integer vectors."""
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    centred = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(x))
    return len(x), x.sum(axis=0).tolist(), value[::-1][:components], vector[:, ::-1][:, :components], value.sum()


def assert_whitened(rows, vectors, close=1e-9):
    """``vectors``: (id, usable vector) of every row."""
    n, sums, value, vector, trace = brute([v for _, v in vectors])
    assert len(rows) == len(vectors) * len(value)
    by_row = sorted({(r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in rows})
    vectors = list({i: (i, v) for i, v in vectors}.values())  # repeated rows have the same values
    assert {(r.n, r.identity_error) for r in rows} == {(n, rows[0].identity_error)} and rows[0].identity_error < 1e-10
    x = np.floor(256 * np.array([v for _, v in sorted(vectors)], float)).astype(np.int64)
    k = len(value)
    assert [r[0] for r in by_row[::k]] == sorted(i for i, _ in vectors)
    assert [r[2] for r in by_row[::k]] == [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x.tolist()]
    got = np.array([r[3] for r in by_row]).reshape(-1, k)
    want = (x - np.array(sums) / n) @ vector / np.sqrt(value)
    for c in range(k):
        sign = np.sign(got[:, c] @ want[:, c])
        assert np.abs(got[:, c] - sign * want[:, c]).max() < close
    assert np.allclose([r[4] for r in by_row[:k]], value / trace, rtol=1e-12)


def usable(rows):
    return [(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]


@pytest.mark.parametrize("parts", [1, 90])
def test_table(spark, parts):
    docs = table(spark, SF, "embeddings").repartition(parts)
    assert_whitened(whitening.whiten(docs).collect(), usable(docs.collect()))


def test_query(spark):
    made = queries.queries()["op13_whitening"](spark, SF)
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert_whitened(made.collect(), usable(table(spark, SF, "embeddings").collect()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(6) * [9, 5, 3, 1, 0.1, 100]).tolist(), "x", 0.5) for k in range(200)]
    odd = [None, [], [1.0], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.0] * 5 + [-float("inf")], [1.0, None] * 3, [0.0] * 7]
    good = rows + rows[:70] + [(900, [-0.0] * 6, "x", 1.0), (900, [0.0] * 6, "x", 1.0), (901, [1e4] * 6, "y", None)]
    docs = spark.createDataFrame(good + [(1000 + k, v, "x", 1.0) for k, v in enumerate(odd)], VECTORS)
    assert_whitened(whitening.whiten(docs.repartition(5)).collect(), [r[:2] for r in good])


def test_few_dimensions_and_null_ids(spark):
    rows = [(1, [0.0, 0.5]), (2, [1.0, 0.25]), (None, [2.0, 9.0]), (None, [2.0, 9.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = whitening.whiten(docs)
    assert sorted((r.vec_id or 0, r.component) for r in made.collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert_whitened(whitening.whiten(docs.where("vec_id IS NOT NULL").unionAll(docs.where("vec_id IS NULL").withColumn("vec_id", F.lit(3)))).collect(), [(i or 3, v) for i, v in rows])


def test_nothing_varies(spark):
    docs = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    for some in (docs, docs.limit(0), docs.where("vec_id = 1"), docs.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert whitening.whiten(some).count() == 0
    along = spark.createDataFrame([(k, [0.0, 1.0 * k, 3.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(along).collect()} == {1}


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(k) * 2**14, float(k * k), -1.0 * 2**34, k % 3 + 0.5]) for k in range(50)]
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, sums, *_ = brute([v for _, v in rows])
    exact = {k: sum((n * int(np.floor(256 * c)) - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in rows}
    assert n == 50 and {r.vec_id: r.deviation for r in made} == {k: v if v < 2**63 else None for k, v in exact.items()}
    assert {r.deviation is None for r in made} == {True, False}


@pytest.mark.parametrize("dimension", [3, 16, 64, 300])
@pytest.mark.parametrize("shape", ["flat", "steep", "pairs", "low rank"])
def test_components_by_direct_solve(dimension, shape):
    rng = np.random.default_rng(dimension)
    q = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    k = np.arange(dimension)
    value = {"flat": 1 + (dimension - k) / dimension, "steep": 0.5**k, "pairs": 1.0 + (dimension - k) // 2, "low rank": (k < 2) * 1.0}[shape]
    a = q * value @ q.T
    got, vectors, certified = whitening.leading_components(lambda b: a @ b, dimension)
    wanted = min(4, dimension)
    assert np.allclose(got, value[:wanted], atol=1e-12) and certified < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12
