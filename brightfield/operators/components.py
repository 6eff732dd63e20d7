"""Connected components of pairs, by label propagation with written rounds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _remove(spark: SparkSession, place: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def place_for(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, removed when the interpreter ends. Only in local mode may the session
    name no such folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="brightfield-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place}/brightfield-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str = "components") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = place_for(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files behind written frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/brightfield-" in path:
                _remove(df.sparkSession, path)


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over the pairs (a, b).

    Every round a node takes the least label among its neighbours, and then the label of its label, so that long chains take
    logarithmically many rounds. Rounds are written to the shared folder, which cuts the lineage and survives lost executors.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = near.select(F.col("node").alias("via"), F.col("label").alias("top"))
        now = written(near.join(up, F.col("label") == F.col("via"), "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        drop_written(labels)
        if now.where("label <> old").isEmpty():
            drop_written(edges)
            return now.select("node", F.col("label").alias("component"))
        labels = now.select("node", "label")
