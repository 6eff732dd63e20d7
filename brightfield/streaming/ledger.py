"""Streams over append-only ledgers: windowed counts, click records, and batches that keep a derived table current."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from brightfield.functions.text import is_bot


def events(spark: SparkSession, path: str) -> DataFrame:
    """An append-only folder of event files as a stream, with an event time that can be watermarked."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value by event type and time window; later rows than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def clicks(requests: DataFrame) -> DataFrame:
    """Requests as click records: the agent only as a digest, robots marked."""
    return requests.select("location_id", "clicked_at", F.sha2(F.coalesce("user_agent", F.lit("")), 256).alias("user_agent_hash"), is_bot(F.col("user_agent")).alias("is_bot"))


#: Parts of a merged table; a batch rewrites those that its keys fall into.
BUCKETS = 8


def merged_table(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest version of every bucket of a table that merge_into() keeps (of versions under ``before``); null if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    every = spark.read.parquet(target)
    every = every if before is None else every.where(F.col("version") < before)
    newest = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(newest, ["bucket", "version"]).drop("version", "bucket")


def merge_into(target: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink for updated rows: a batch's rows replace those of their keys in the table at ``target``.

    Rows lie in buckets by key. A batch writes only its buckets again, as a version with the batch's number, so that a batch that
    is run again after a failure overwrites its own version, and merges with what was there before it.
    """

    def merge(df: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        news = df.withColumn("bucket", bucket)
        old = merged_table(df.sparkSession, target, number)
        if old is not None:
            touched = news.select("bucket").distinct()
            kept = old.withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi")  # as many rows as buckets
            news = news.unionByName(kept.join(df.select(*keys), keys, "left_anti").select(news.columns))
        news.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")

    return merge


def keep_current(stream: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """For every micro-batch, recompute the derived rows of the keys that it touches, and merge them into the table at ``target``."""
    merge = merge_into(target, [key])
    return stream.writeStream.foreachBatch(lambda df, n: merge(recompute(df.select(key).distinct()), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net_totals(changes: DataFrame, key: str = "key", sign: str = "sign", amount: str = "amount") -> DataFrame:
    """The rows and amount of every key after changes that add (sign 1) and take away (-1), as state that deltas are merged into: only
    the keys that a batch touches are updated. Keys without rows remain with none."""
    return changes.groupBy(key).agg(F.sum(sign).alias("rows"), F.sum(F.col(sign) * F.col(amount)).alias("amount"))


#: Rows of a micro-batch of a replayed table, about; a table is replayed in STEPS of them at least.
BATCH_ROWS, STEPS = 5_000_000, 3


def replay(df: DataFrame, order: str, work: Callable[[DataFrame], DataFrame], keys: list[str], place: str) -> DataFrame:
    """A table run through ``work`` as a stream, a micro-batch for each range of the whole number ``order``, and the merged result.

    Every range is appended to the source folder and run to its end before the next one comes, under one checkpoint, as files arrive
    in a ledger's folder.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    steps = max(STEPS, -(-n // BATCH_ROWS))
    step = F.floor((F.col(order) - F.lit(low)) * steps / F.lit((high or 0) - (low or 0) + 1))
    spark, source, target = df.sparkSession, f"{place}/source", f"{place}/target"
    for k in range(steps):
        df.where(F.coalesce(step, F.lit(0)) == k).write.mode("append").parquet(source)
        updates = work(spark.readStream.schema(df.schema).parquet(source))
        query = updates.writeStream.foreachBatch(merge_into(target, keys)).outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return merged_table(spark, target)


#: The last outcomes of a kind of task that are looked at, and the share of failures among them over which it halts.
RECENT, FAILING = 500, 0.25
#: Stands for no halt in the state; no outcome has this number.
NOWHERE = -(2**62)


def failure_halts(outcomes: DataFrame, recent: int = RECENT, share: float = FAILING) -> DataFrame:
    """For every kind of task (kind, at, failed): kind, n and failures of its last outcomes, and halted_at, where it halted for good.

    A kind halts at the first outcome that closes a window of ``recent`` outcomes with a larger share of failures; every window is
    looked at, also those within a micro-batch and across two. Outcomes are taken in order of ``at`` within a micro-batch. The state of
    a kind is at most ``recent`` flags and where it halted.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        flags, halted = state.get if state.exists else ([], NOWHERE)
        news = pd.concat(list(batches)).sort_values("at", kind="stable")
        every = np.concatenate([np.array(flags, bool), news["failed"].to_numpy(bool)])
        if halted == NOWHERE:
            sums = np.append(0, np.cumsum(every))
            over = np.flatnonzero(sums[recent:] - sums[:-recent] > share * recent) if len(every) >= recent else []
            if len(over):
                halted = int(news["at"].iloc[over[0] + recent - 1 - len(flags)])
        last = every[-recent:]
        state.update((last.tolist(), halted))
        yield pd.DataFrame({"kind": [key[0]], "n": [len(last)], "failures": [int(last.sum())], "halted_at": [halted]})

    made = outcomes.groupBy("kind").applyInPandasWithState(update, "kind string, n long, failures long, halted_at long", "flags array<boolean>, halted_at long", "update", GroupStateTimeout.NoTimeout)
    return made.withColumn("halted_at", F.nullif("halted_at", F.lit(NOWHERE)))
