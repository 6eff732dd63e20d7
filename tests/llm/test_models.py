"""Trained models against direct solutions and plain Python."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from brightfield.llm import pii, quality, toxicity
from brightfield.llm.common import table
from brightfield.llm.learning import isotonic
from tests.conftest import SF
from tests.llm.test_operators import ODD, documents, prose, slow_kernel

SMALL = SF.replace("sf0.001", "sf0.01")


def test_quality_by_a_direct_solve(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit_quality(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = quality.labelled_sample(docs, labels, "quality").collect()
    assert {r.doc_id: r.label for r in rows} == known
    train, kept = [r for r in rows if r.part > 0], [r for r in rows if r.part == 0]
    x = np.stack([quality.statistics(r.text or "") for r in train])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    rng = np.random.default_rng(quality.SEED)
    w, shift = rng.standard_normal((quality.STATISTICS, quality.COSINES)) / np.sqrt(quality.STATISTICS / 2), rng.uniform(0, 2 * np.pi, quality.COSINES)
    lift = lambda x: np.array([[np.sqrt(2 / quality.COSINES) * np.cos(np.clip((row - model.mean) / model.scale, -6, 6) @ w[:, j] + shift[j]) for j in range(quality.COSINES)] + [1.0] for row in x])
    z, y = lift(x), np.array([r.label for r in train], float)
    ridge = quality.RIDGE * len(train)
    stacked = np.vstack([z, np.sqrt(ridge) * np.eye(z.shape[1])])  # ridge as least squares with more rows
    direct = np.linalg.lstsq(stacked, np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.abs(z @ model.weights - z @ direct).max() < 1e-6
    held = lift(np.stack([quality.statistics(r.text or "") for r in kept])) @ direct
    points, values = isotonic(held, np.array([r.label for r in kept], float))
    assert np.allclose(np.interp(held, *model.knots), np.interp(held, points, values), atol=1e-6)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, quality.STATISTICS))
    z = quality.features(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-apart / quality.STATISTICS)).max() < 0.3


def plain_margin(model, word):
    """A word's margin by walking all of its subsequences."""
    known = model.subsequences
    letter = {chr(c): k for k, c in enumerate(known.letters.tolist())}
    best = -np.inf
    for w in toxicity.windows(word):
        x = [letter.get(c, len(letter)) for c in w]
        total = sum(toxicity.DECAY ** (k - i + 1) * model.weights[known.triple[known.pair[x[i], x[j]], x[k]]] for i, j, k in combinations(range(len(w)), 3))
        best = max(best, (total / slow_kernel(w, w) ** 0.5 if len(w) >= toxicity.ORDER else 0.0) + model.bias)
    return best


def test_toxicity_scores_in_plain_python(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    texts = ["The edhe of idiot in there.", "nothing of it", "you m-o-r-o-n, c l o w n!", "", "a", "Trash und Müll " + "x" * 30, "plain words\nof two lines. clownish trashy"]
    slopes, start = model.logistic
    for text, score in zip(texts, model.scores(texts), strict=True):
        margins = [plain_margin(model, w) for w in set(toxicity.tokens(text.lower()))]
        most = min(max(max(margins, default=-toxicity.EXTREME), -toxicity.EXTREME), toxicity.EXTREME)
        evidence = [most, np.log(1 + sum(m > 0 for m in margins)), np.log(1 + sum(m > toxicity.DOUBTFUL for m in margins))]
        assert score == pytest.approx(1 / (1 + np.exp(-(np.dot(slopes, evidence) + start))), abs=1e-9)


def test_models_take_odd_tables(spark):
    docs = documents(spark, [*ODD, prose(1, 40), prose(1, 40)]).unionAll(documents(spark, [prose(2, 30)] * 2).selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "found", "n_words", "doc"))
    labels = spark.createDataFrame([(None, 1, 1), (3, 1, 0), (3, 1, 0), (6, 0, 1), (7, None, None), (8, 2, 2), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (quality.scored, toxicity.scored):
        rows = scored(docs, labels).collect()
        assert len(rows) == len(ODD) + 4 and all(0 <= r.score <= 1 for r in rows)
        same = {r.doc_id: r.score for r in rows}
        assert same[len(ODD)] == same[len(ODD) + 1]
        assert scored(docs.limit(0), labels).count() == 0


def test_detector_is_fitted_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "_fitted", {})
    calls = []
    monkeypatch.setattr(pii, "fit_detector", lambda *a: calls.append(a) or pii.Detector())
    docs = documents(spark, ["a@b.cd", None])
    for _ in range(2):
        assert pii.spans(docs).count() == 2 and pii.redact(docs).count() == 2
    assert len(calls) == 1
    assert pii.spans(docs.limit(0)).count() == 0
    nobody = docs.selectExpr("CAST(NULL AS bigint) AS doc_id", "text")
    assert sorted(str(r.spans) for r in pii.spans(nobody).collect()) == ["", "email:0:6"]


def test_held_out_rows_are_a_fifth_by_hash(spark):
    rows = quality.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and re.match("0|1", str(rows[0].predicted))


def test_half_of_a_kernel_is_enough():
    rng = np.random.default_rng(1)
    for length in range(3, 14):
        codes = rng.integers(0, 4, (40, length)).astype(np.int32)
        assert np.allclose(toxicity._self_kernel(codes), toxicity._kernel(codes, codes), rtol=1e-12)
