"""Directory entities over the given tables, once as DataFrames and once as SQL for the oracle.

Locations are customers in towns around their nation's place (the twelve of a block that share a nation share a town), organizations are suppliers, offerings are line items of a
location's orders, treatments are parts in a tree, reviews are documents, tasks and ledgers are events, pages are pages.
"""

from __future__ import annotations

import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_in_workers(spark: SparkSession) -> None:
    """Where this package is not installed, let Python workers look for it in the folder it came from."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    made = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rated = F.col("c_acctbal") >= 0
    return made.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.expr("c_custkey div 15").alias("org_id"),
        F.col("n_name").alias("country_code"),
        F.col("c_mktsegment").alias("locality"),
        F.col("n_regionkey").alias("region"),
        F.expr("CAST(-48 + 4 * c_nationkey AS DOUBLE) + CAST((c_custkey div 12 * 7919) % 200 AS DOUBLE) / 100 - 1 + CAST(c_custkey % 2 AS DOUBLE) / 250").alias("latitude"),
        F.expr("CAST(-168 + 14 * c_nationkey AS DOUBLE) + CAST((c_custkey div 12 * 104729) % 211 AS DOUBLE) / 100 - 1").alias("longitude"),
        F.when(F.col("c_custkey") % 17 == 0, "inactive").otherwise("active").alias("status"),
        (F.col("c_custkey") % 23 == 0).alias("is_virtual"),
        F.when(rated, F.floor(F.col("c_acctbal") / 2500) + 1).cast("int").alias("rating"),
        F.when(rated, F.col("c_custkey") % 40).cast("int").alias("review_count"),
    )


#: Rows of a task where dealt() deals them out.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, hashed by keys to as many tasks as leave each TASK_ROWS of them; adaptive execution would make a few
    large tasks of narrow rows, as it goes by their compressed bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *keys)


def supplied(spark: SparkSession, sf_dir: str, places: DataFrame) -> DataFrame:
    """(treatment_id, and the columns of ``places``) once for every treatment that one of the places (location_id, ...) offers.

    Places meet the orders, which are fewer than the lines.
    """
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("treatment_id"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("location_id")).join(places, "location_id")
    pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("treatment_id", *places.columns)
    return dealt(pairs, line.count(), "treatment_id", "location_id").distinct()


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("canonical_name"), F.col("s_nationkey").alias("nation"))


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id numbers an order's lines: no global order is needed for it."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE)
    line = line.withColumn("turn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    made = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber")
    return made.select(
        (F.col("l_orderkey") * 1000 + F.col("turn")).alias("id"),
        F.col("o_custkey").alias("location_id"),
        F.col("l_partkey").alias("treatment_id"),
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("price_amount"),
        F.col("l_returnflag").alias("price_currency"),
        F.when(n == 1, "service").when(n == 2, "session").when(n == 3, "visit").when(n == 4, "package").otherwise("unit").alias("price_unit"),
        F.when(F.col("l_linestatus") == "O", "retail").otherwise("trade").alias("price_audience"),
        F.col("l_shipdate").alias("updated_at"),
    )


def treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") >= 10, F.expr("p_partkey div 10")).alias("parent_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("author"), "text", "lang", "n_chars")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue rows: five priorities, attempts from the payload, four states."""
    state = F.col("event_id") % 4
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("task_type"),
        F.col("user_id").alias("entity_id"),
        (F.col("event_id") % 5).alias("priority"),
        (F.col("event_id") % 3).cast("int").alias("attempts"),
        F.when(state == 0, "pending").when(state == 1, "claimed").when(state == 2, "completed").otherwise("failed").alias("status"),
        F.col("value").alias("cost"),
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active")


SQL = {
    "locations": """locations AS (SELECT c_custkey AS id, c_name AS name, c_custkey // 15 AS org_id, n_name AS country_code, c_mktsegment AS locality, n_regionkey AS region,
  CAST(-48 + 4 * c_nationkey AS DOUBLE) + CAST((c_custkey // 12 * 7919) % 200 AS DOUBLE) / 100 - 1 + CAST(c_custkey % 2 AS DOUBLE) / 250 AS latitude,
  CAST(-168 + 14 * c_nationkey AS DOUBLE) + CAST((c_custkey // 12 * 104729) % 211 AS DOUBLE) / 100 - 1 AS longitude,
  CASE WHEN c_custkey % 17 = 0 THEN 'inactive' ELSE 'active' END AS status, c_custkey % 23 = 0 AS is_virtual,
  CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 2500) + 1 AS INT) END AS rating, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 40 AS INT) END AS review_count
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "organizations": "organizations AS (SELECT s_suppkey AS org_id, s_name AS canonical_name, s_nationkey AS nation FROM supplier)",
    "offerings": """offerings AS (SELECT l_orderkey * 1000 + turn AS id, o_custkey AS location_id, l_partkey AS treatment_id, l_suppkey AS source_id,
  CASE WHEN l_discount <> 0 THEN l_extendedprice END AS price_amount, l_returnflag AS price_currency,
  CASE l_linenumber WHEN 1 THEN 'service' WHEN 2 THEN 'session' WHEN 3 THEN 'visit' WHEN 4 THEN 'package' ELSE 'unit' END AS price_unit,
  CASE WHEN l_linestatus = 'O' THEN 'retail' ELSE 'trade' END AS price_audience, l_shipdate AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS turn FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey)""",
    "treatments": "treatments AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id, p_type AS category, p_name AS name, p_brand AS brand, p_size AS size FROM part)",
    "reviews": "reviews AS (SELECT doc_id AS id, source AS author, text, lang, n_chars FROM documents)",
    "tasks": """tasks AS (SELECT event_id AS id, event_type AS task_type, user_id AS entity_id, event_id % 5 AS priority, CAST(event_id % 3 AS INT) AS attempts,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, value AS cost, props AS payload, ts AS created_at FROM events)""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` (a SELECT, or further ", name AS (...)" expressions and a SELECT) over the named roles."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names) + "\n" + body
