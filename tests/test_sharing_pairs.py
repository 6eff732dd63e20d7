"""Pairs of rows that share members: against brute force, and the query on odd parts against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brightfield import catalog
from brightfield.operators.similarity import sharing_pairs
from tests.test_similarity import sets


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_sharing_pairs_by_brute_force(spark, block):
    """Many copies, ids that come twice, nulls; blocks smaller than what holds a member."""
    made = [(k, k % 2, m) for k, m in enumerate(sets(5, 50))] + [(200 + k, 0, ["w1", "w2", "w1"]) for k in range(13)] + [(205, 0, ["w2"])]
    odd = [(900, 0, None), (901, 0, [None]), (902, None, ["w1"]), (None, 0, ["w1"])]
    df = spark.createDataFrame(made + odd, "id long, kind int, words array<string>")
    found = sorted((r.a, r.b, r.shared) for r in sharing_pairs(df, ("kind",), "words", lambda c: F.array_join(c, ","), block=block).collect())
    want = sorted((i, j, ",".join(sorted({*m} & {*n}))) for i, x, m in made for j, y, n in made if i < j and x == y and {*m} & {*n})
    assert want and found == want


def test_shared_tokens_of_odd_parts(spark, tmp_path):
    rows = [(k, ["large ring", "LARGE Rod", "red rod", "ring large  large", "a b", ""][k % 6], "Brand#1", k % 12) for k in range(300)]
    rows += [(7, "large plate", "Brand#1", 7), (7, "large plate", "Brand#1", 8), (400, None, "Brand#1", 1), (401, "large", None, 1), (402, "large", "Brand#1", None)]
    columns = "p_partkey long, p_name string, p_brand string, p_size int"
    spark.createDataFrame(rows, columns).withColumn("p_type", F.lit("T")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    name = "d6_shared_tokens"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert want and sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()) == want


def test_pairs_are_neither_shuffled_nor_grouped(spark):
    made = sharing_pairs(spark.createDataFrame([(1, 1, ["x"]), (2, 1, ["x"])], "id long, kind int, words array<string>"), ("kind",), "words")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    listed = plan.index("Generate explode(ids_b")
    assert "Aggregate" not in plan[:listed] and "Repartition" not in plan[:listed]
