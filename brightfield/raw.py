"""Raw texts made from table columns by expressions that Spark and DuckDB both know, so that SQL can recompute a rule from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(key: str, *values: str | None) -> str:
    """The value that a whole number chooses."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)) + " END"


def duck(expression: str) -> str:
    return expression.replace(" AS STRING)", " AS VARCHAR)").replace(" div ", " // ")


def made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(v).alias(k) for k, v in columns.items()])


def made_sql(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{duck(v)} AS {k}' for k, v in columns.items())} FROM {table}"
