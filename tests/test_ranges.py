"""Positions and rolling windows against plain Python, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from brightfield.operators.ranges import positions, rolling


def table(spark, seed, n=900):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randrange(5)) for k in rng.sample(range(10**6), n)] + [("one", 7, 1)]
    return rows, spark.createDataFrame(rows, "key string, at long, v int").repartition(9)


def test_positions(spark):
    rows, df = table(spark, 1)
    got = {(r.key, r.at): r.position for r in positions(df, ["key"], ["at"]).collect()}
    assert got == {(k, at): sum(x[0] == k and x[1] < at for x in rows) for k, at, _ in rows}
    assert positions(df.limit(0), ["key"], ["at"]).count() == 0


@pytest.mark.parametrize("rows_in_window,chunk", [(1, 1), (1, 50), (7, 7), (7, 8), (50, 64), (50, 5000)])
def test_rolling(spark, rows_in_window, chunk):
    rows, df = table(spark, chunk)
    made = rolling(df, ["key"], ["at"], rows_in_window, chunk, total=F.col("v"), odd=(F.col("v") % 2 == 1).cast("int")).collect()
    got = {(r.key, r.at): (r.total, r.odd, r.window_rows) for r in made}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((at, v) for k, at, v in rows if k == key)
        for i, (at, _) in enumerate(mine):
            some = [v for _, v in mine[max(0, i + 1 - rows_in_window) : i + 1]]
            want[key, at] = (sum(some), sum(v % 2 for v in some), len(some))
    assert len(made) == len(rows) and got == want


def test_a_chunk_holds_a_window(spark):
    with pytest.raises(ValueError):
        rolling(table(spark, 2)[1], ["key"], ["at"], 9, 8, total=F.col("v"))
