"""Work in the order of a column within keys of any size: positions, chunks, and rolling windows, without a task for a whole key.

Rows are parted into ranges of (key, order), which are written once, as their bounds may differ when they are computed again. A row's
position is the number of its key's rows in the ranges before, which a small table tells, and its place in its own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightfield.operators.components import written

#: Rows of a chunk in which a rolling window is computed.
CHUNK = 50_000


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's position in its key, counted from 0 by ``order``, which should leave no ties."""
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n")  # a row for each range of a key
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__of"), earlier.alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__range") == F.col("__of")]
    joined = ranged.join(before, same).select(*ranged.columns, "__before")
    here = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1
    return joined.withColumn(name, (F.col("__before") + here).cast("bigint")).drop("__range", "__before")


def rolling(df: DataFrame, keys: list[str], order: list[str], rows: int, chunk: int = CHUNK, **sums: Column) -> DataFrame:
    """``df`` with sums over each row and the ``rows`` - 1 before it in its key, and ``window_rows``, how many rows these are.

    A chunk of positions also gets the last rows of the chunk before, its halo, and no task sees more than a chunk and its halo.
    """
    if chunk < rows:
        raise ValueError("a chunk must hold a whole window")
    placed = positions(df, keys, order, "__position")
    own = F.expr(f"__position div {chunk}")
    spread = placed.withColumn("__chunk", F.explode(F.when(F.col("__position") % chunk > chunk - rows, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy(*keys, "__chunk").orderBy("__position").rowsBetween(1 - rows, 0)
    made = spread.select("*", *[F.sum(c).over(last).alias(n) for n, c in sums.items()], F.count("*").over(last).alias("window_rows"))
    return made.where(F.col("__chunk") == own).drop("__chunk", "__position")
