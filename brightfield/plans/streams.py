"""The event ledger run through streams, micro-batch by micro-batch; the SQL computes the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.operators.components import place_for
from brightfield.registry import query
from brightfield.roles import import_in_workers, read, sql, tasks
from brightfield.streaming import ledger


@query("z1_windowed_stream", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def z1(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type and window, updated as events come in."""
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    work = lambda s: ledger.windowed_counts(s, "6 hours", "1 hour").select(F.col("window.start").alias("start"), "event_type", "n", "value")
    return ledger.replay(e, "event_id", work, ["start", "event_type"], place_for(spark, "stream")).withColumn("value", F.round("value", 4))


@query("z4_net_totals", "SELECT user_id AS key, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS rows, round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END), 4) AS amount FROM events GROUP BY 1")
def z4(spark: SparkSession, d: str) -> DataFrame:
    """A derived table kept current by deltas: every change is merged into the totals of its key, and only touched keys are rewritten."""
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1).cast("bigint")
    changes = read(spark, d, "events").select("event_id", F.col("user_id").alias("key"), sign.alias("sign"), F.col("value").alias("amount"))
    return ledger.replay(changes, "event_id", ledger.net_totals, ["key"], place_for(spark, "stream")).withColumn("amount", F.round("amount", 4))


@query("z5_failure_halts", sql(""", o AS (SELECT task_type, id, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS bad FROM tasks), r AS (SELECT task_type, id, sum(bad) OVER w AS failures, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY task_type ORDER BY id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT task_type AS kind, arg_max(n, id) AS n, CAST(arg_max(failures, id) AS BIGINT) AS failures, min(id) FILTER (WHERE n = 500 AND failures * 4 > n) AS halted_at FROM r GROUP BY 1""", "tasks"))
def z5(spark: SparkSession, d: str) -> DataFrame:
    """For every kind of task its last outcomes, and where it halted for good, from state that is carried between micro-batches."""
    import_in_workers(spark)
    outcomes = tasks(spark, d).select(F.col("task_type").alias("kind"), F.col("id").alias("at"), (F.col("status") == "failed").alias("failed"))
    return ledger.replay(outcomes, "at", ledger.failure_halts, ["kind"], place_for(spark, "stream"))
