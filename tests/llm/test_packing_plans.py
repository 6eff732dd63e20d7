"""The configuration program is never worse than filling gaps alone, and better where gaps alone waste room."""

from collections import Counter

import numpy as np
import pytest

from brightfield.llm import packing

SHAPES = {
    "uniform": lambda r: r.integers(1, 4097, 20_000),
    "lognormal": lambda r: np.clip(r.lognormal(6, 1.2, 20_000).astype(int), 1, 4096),
    "two or three": lambda r: r.integers(1200, 1901, 20_000),
    "nearly thirds": lambda r: r.integers(1300, 1501, 20_000),
    "large": lambda r: r.integers(1500, 4097, 20_000),
    "few lengths": lambda r: r.choice(r.integers(1, 4097, 12), 20_000),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", range(9))
def test_never_worse_than_filling_gaps(shape, seed):
    histogram = {int(n): c for n, c in Counter(SHAPES[shape](np.random.default_rng(seed)).tolist()).items()}
    plan, gaps = packing.plan_packing(histogram), packing.rounded(histogram, [], 0.0)
    assert plan.n_sequences <= gaps.n_sequences
    if shape in ("two or three", "nearly thirds"):
        assert plan.n_sequences < 0.975 * gaps.n_sequences
    if shape == "lognormal":
        assert plan.n_sequences == -(-sum(n * c for n, c in histogram.items()) // packing.CAPACITY)
