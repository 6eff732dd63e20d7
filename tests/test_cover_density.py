"""Cover density against brute force over all stretches of a document."""

import random

import pytest

from brightfield.operators.cover_density import WEIGHTS, ranked_matches, weighted_words


def brute(words, all_of, none_of):
    """(covers, rank) or None. Words: (word, weight). Covers: stretches with all groups that hold no shorter such stretch."""
    groups = [set(g) for g in all_of if g]
    present = {w for w, _ in words}
    if not all(g & present for g in groups) or set(none_of or []) & present:
        return None
    wanted = set().union(*groups)
    whole = lambda i, j: all(any(words[k][0] in g for k in range(i, j + 1)) for g in groups)
    covers, rank = 0, 0.0
    for i in range(len(words)):
        for j in range(i, len(words)):
            if whole(i, j):
                if not (j > i and (whole(i + 1, j) or whole(i, j - 1))):
                    hits = [words[k][1] for k in range(i, j + 1) if words[k][0] in wanted]
                    covers += 1
                    rank += len(hits) / sum(1 / w for w in hits) / (1 + j - i + 1 - len(hits))
                break
    return covers, rank


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = list("abcdefghij") + ["été", "straße", "да"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, some(rng.randrange(0, 40)), some(rng.randrange(0, 6))) for k in range(60)] + [(60, None, None), (61, "A, a! É-B", "Été")]
    queries = []
    for k in range(25):
        pool = rng.sample(words, 6)
        queries.append((k, [pool[:1], pool[1 : 1 + rng.randrange(1, 3)], pool[3:4]][: rng.randrange(1, 4)], pool[5:6] if k % 3 else None))
    queries += [(90, [], None), (91, [["a"], []], []), (92, [["a", "a", None]], [])]
    d = spark.createDataFrame(docs, "id long, title string, body string")
    q = spark.createDataFrame(queries, "query long, all_of array<array<string>>, none_of array<string>")
    from pyspark.sql import functions as F

    found = {(r.query, r.id): (r.covers, round(r.rank, 9)) for r in ranked_matches(d.select("id", weighted_words((F.col("title"), "A"), (F.col("body"), "C")).alias("words")), q).collect()}
    import re

    want = {}
    for k, title, body in docs:
        made = [(w, WEIGHTS["A"]) for w in re.findall(r"\w+", (title or "").lower())] + [(w, WEIGHTS["C"]) for w in re.findall(r"\w+", (body or "").lower())]
        for n, all_of, none_of in queries:
            groups = [[w for w in g if w] for g in all_of]
            got = brute(made, groups, none_of) if any(groups) else None
            if got:
                want[n, k] = got[0], round(got[1], 9)
    assert want and found == want


def test_close_words_count_more(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "red clinic"), (2, "red and blue clinic"), (3, "clinic red clinic"), (4, "red only")], "id long, text string")
    q = spark.createDataFrame([("q", [["red"], ["clinic"]], None)], "query string, all_of array<array<string>>, none_of array<string>")
    rows = {r.id: (r.covers, round(r.rank, 9)) for r in ranked_matches(docs.select("id", weighted_words((F.col("text"), "D")).alias("words")), q).collect()}
    assert rows == {1: (1, 0.1), 2: (1, round(0.1 / 3, 9)), 3: (2, 0.2)}
