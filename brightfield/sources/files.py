"""Reading and writing delimited text and JSON, and merging into tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.operators.components import written


def _header(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Quoted text with a header: doubled quotes, cells of several lines, column names in lower case."""
    df = spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    return df.toDF(*[_header(c) for c in df.columns])


def read_planner(spark: SparkSession, path: str, delimiter: str = ",", needed: tuple[str, ...] = ("keyword", "avg_monthly_searches")) -> DataFrame:
    """A report whose header comes after any lines of preamble: the first row with the needed names; blank keywords go.

    Cells may hold line breaks. Such a report comes as one file, which is read whole by one task; only its width, its header's place
    and names reach the driver. The width is that of the widest line; a record over several lines that is wider still is refused.
    """
    lines = spark.read.text(path).select((F.length("value") - F.length(F.replace("value", F.lit(delimiter), F.lit("")))).alias("n"))
    width = (lines.agg(F.max("n")).first()[0] or 0) // len(delimiter) + 1
    wide = spark.read.csv(path, sep=delimiter, header=False, quote='"', escape='"', multiLine=True, schema=", ".join(f"c{i} string" for i in range(width + 1)))
    if not wide.where(F.col(f"c{width}").isNotNull()).isEmpty():
        raise ValueError(f"a record has more than {width} cells")
    rows = wide.select(F.monotonically_increasing_id().alias("line"), F.array_compact(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")) for i in range(width)])).alias("cells"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    names = F.transform("cells", lambda x: plain(x["v"]))
    fits = [F.exists(names, lambda x: x.startswith(n)) for n in needed]
    head = rows.where(F.coalesce(reduce(lambda a, b: a & b, fits), F.lit(False))).orderBy("line").limit(1).select("line", names.alias("names")).first()
    if head is None:
        raise ValueError(f"no row names {needed}")
    kept = [F.col("cells")[i]["v"].alias(n or f"c{i}") for i, n in enumerate(head["names"]) if n is not None]
    return rows.where(F.col("line") > head["line"]).select(*kept).where(F.trim("keyword") != "")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Quotes only where needed, nulls as empty cells, nested values as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, sep=delimiter, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that are none are left out, malformed_json_lines() has them."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def malformed_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line) of what read_json_lines() leaves out: lines that are not blank and no object of the schema."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    read = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", f"{schema}, __corrupt string", options).alias("x"))
    return read.where((F.trim("line") != "") & (F.col("x").isNull() | F.col("x.__corrupt").isNotNull())).select("line")


def json_rows(column: Column, schema: str) -> Column:
    """The rows of a JSON array of objects, for ``select(inline(...))``."""
    return F.from_json(column, f"array<struct<{schema}>>")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in place; rows for which ``keep`` (over ``old``) holds stay as they are."""
    guarded = old.withColumn("__keep", F.coalesce(keep if keep is not None else F.lit(False), F.lit(False)))
    values = [c for c in old.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__new"))
    joined = guarded.join(right, keys, "full")
    take_new = F.coalesce("__new", F.lit(False)) & ~F.coalesce("__keep", F.lit(False))
    return joined.select(*keys, *[F.when(take_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], unions: tuple[str, ...] = (), either: tuple[str, ...] = ()) -> DataFrame:
    """Field-wise merge: the old value where there is one; arrays united and sorted, flags or-ed."""
    right = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys])
    joined = old.join(right, keys, "full")

    def field(c: str) -> Column:
        n = F.col(f"__{c}")
        if c in unions:
            return F.array_sort(F.array_union(F.coalesce(c, F.array()), F.coalesce(n, F.array())))
        if c in either:
            return F.coalesce(c, F.lit(False)) | F.coalesce(n, F.lit(False))
        return F.coalesce(c, n)

    return joined.select(*keys, *[field(c).alias(c) for c in old.columns if c not in keys])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks; of repeated new keys one row."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def append_returning(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows to a folder and give back the keys of what was written."""
    before = written(new, "append")
    before.write.mode("append").parquet(path)
    return before.select(*keys)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
