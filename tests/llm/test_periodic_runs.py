"""Runs against brute force over starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.llm import periodic_runs, queries
from brightfield.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import ODD, documents, prose


def brute_runs(words, least=periodic_runs.LEAST):
    """For every period the stretches over which words a period apart agree; each stretch counts for its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute_row(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    runs, kept = "".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(runs), sha(kept))


@pytest.mark.parametrize("seed", range(40))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randrange(1, 12)):
        words = []
        while len(words) < rng.randrange(1, 90):
            some = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
            words += some * rng.choice([1, 1, 2, 3, 7])
        texts.append(words[: rng.randrange(len(words) + 1)])
    codes, mark = [], 0
    for k, words in enumerate(texts):
        codes += [100 * k + w for w in words] + [100 * k + 99]
    least = rng.choice([1, 2, 12])
    got = list(zip(*[x.tolist() for x in periodic_runs.runs(np.array(codes, np.int64), least)], strict=True))
    want, at = [], 0
    for words in texts:
        want += [(at + s, m, q) for s, m, q in brute_runs(words, least)]
        at += len(words) + 1
    assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_words_of_famous_shapes():
    a, b = "a", "b"
    fibonacci = [a], [a, b]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for words in (fibonacci[1], [a] * 300, [a, b] * 150, [a] * 100 + [b] + [a] * 100, ([a, a, b] * 9 + [b]) * 12):
        codes = np.array([ord(w) for w in words] + [0], np.int64)
        assert list(zip(*[x.tolist() for x in periodic_runs.runs(codes)], strict=True)) == brute_runs(words)


def test_query_by_brute_force(spark):
    repeats = [" ".join(["again and", "again\tand"] * 30), "x " * 11, "x " * 12, "line one\n" * 9 + prose(3, 40) + " " + "line one\n" * 6, "\x1f \x85  x " * 8, ("p q r " * 5 + "s ") * 4]
    texts = [*ODD, *repeats, *[prose(k, 60) + " " + " ".join([prose(k, k)] * 3) for k in range(1, 40)], prose(1, 50), prose(1, 50)]
    docs = documents(spark, texts).withColumn("start", F.lit("x")).withColumn("n_runs", F.lit(None))
    got = sorted(map(tuple, periodic_runs.find_runs(docs.repartition(3)).collect()))
    assert got == [brute_row(k, t) for k, t in enumerate(texts)]
    assert sum(r[1] > 0 for r in got) > 30


def test_table_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LEAVES", 1000)
    docs = [r for r in table(spark, SF, "documents").collect() if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in queries.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    for r in docs:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)


def test_no_ids_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b " * 9), (None, "a b " * 9), (3, None), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, periodic_runs.find_runs(docs).collect()), key=str)
    assert got == sorted([brute_row(None, "a b " * 9)] * 2 + [brute_row(3, None)] * 2, key=str)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_one_very_long_text():
    import pyarrow as pa

    words = [f"w{i}" for i in range(5000)]
    text = " ".join(words * 60 + ["end"] + ["z"] * 100_000)
    (row,) = periodic_runs.digests([None], pa.array([text]))
    assert row[:5] == (2, 0, 300_000, 5000, 60_000)
