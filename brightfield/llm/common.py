"""What the training-text operators share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where they share all folders, may the session leave it unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="brightfield-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def _remove(spark: SparkSession, place: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def materialise(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and outlives lost executors.

    It goes to ``path`` for good, or into the shared folder until drop_materialised or the interpreter's end.
    """
    spark = df.sparkSession
    place = path or f"{shared_dir(spark)}/brightfield-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    if not path:
        atexit.register(_remove, spark, place)
    return spark.read.schema(df.schema).parquet(place)


def drop_materialised(*frames: DataFrame) -> None:
    """Delete the files behind materialised frames that nothing reads any more."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/brightfield-" in name:
                _remove(df.sparkSession, name)


#: Bytes of a batch that a Python worker turns into objects at once.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about SLICE_BYTES, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _import_in_workers(spark: SparkSession) -> None:
    """Where this package is not installed, let Python workers look for it in the folder it came from."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def small_batches(spark: SparkSession) -> None:
    """Let Spark read and hand over long texts in small batches, unless the session has chosen the sizes itself."""
    _import_in_workers(spark)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, "8m")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_texts(df: DataFrame, work: Callable[[list[str]], list[tuple]], fields: T.StructType, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``doc`` (a struct of the kept input columns) and ``found`` (what ``work`` makes of each text; null text: empty).

    The kept columns travel inside a struct, so no input column can clash with a new one. Narrow: no shuffle.
    """
    kept = df.columns if keep is None else keep
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_of(text).alias("text"))
    schema = T.StructType([base.schema["doc"], T.StructField("found", fields, False)])
    found = _arrow_type(df.sparkSession, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = work(batch.column(1).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in found]
            parts = [pa.array(list(c), f.type) for c, f in zip(columns, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(parts, fields=list(found))], ["doc", "found"])

    return base.mapInArrow(run, schema)


def _arrow_type(spark: SparkSession, fields: T.StructType) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.struct([pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in fields])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def struct_of(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])
