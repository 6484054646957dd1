"""Scans and sinks of files. CSV is read without inference, doubled quotes and line breaks in fields allowed, null as empty."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.clean import RAW, required

CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "encoding": "UTF-8"}


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _fs(spark, path)
    return fs.exists(own)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session shares (spark.checkpoint.dir); a local one only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/corpusflow/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own, which cuts what led to them."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings by the header's names, null as empty."""
    rows = spark.read.options(**CSV, inferSchema=False, enforceSchema=False).csv(path)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw columns, checked and stripped."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return required(read_csv(spark, path).withColumn("row_ord", F.monotonically_increasing_id()), ("row_ord",))


def typed(rows: DataFrame) -> DataFrame:
    """Clean rows as strings, with tags_list, published_at, tag_count and published_year as values."""
    tags = C.split_tags(F.col("tags"))
    return rows.withColumns({"tags_list": tags, "tag_count": F.size(tags).cast("long"), "published_at": C.strict_date(F.col("published_date"))}).withColumn("published_year", F.year("published_at").cast("long"))


def load_clean(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return typed(read_csv(spark, path))


def read_existing(spark: SparkSession, path: str) -> DataFrame:
    """Earlier raw rows; none if the file is missing or can't be read; a missing column is empty."""
    none = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in RAW]))
    if not exists(spark, path):
        return none
    try:
        rows = read_csv(spark, path)
    except Exception as error:  # the file is damaged
        print(f"{path}: {str(error)[:200]}")
        return none
    return rows.select(*(C.clean_text(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in RAW))


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Overwrites; one file only where asked for. Arrays must have been joined, dates formatted."""
    flat = rows.drop("published_at", "tags_list")
    (flat.coalesce(1) if single else flat).write.mode("overwrite").options(header=True, escape='"', emptyValue="", encoding="UTF-8").csv(path)


def replace_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """write_csv() for rows that are read from ``path`` itself: written beside it first, then moved in its place."""
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.new"
    write_csv(rows, beside, single)
    fs, own = _fs(spark, path)
    fs.delete(own, True)
    if not fs.rename(_fs(spark, beside)[1], own):
        raise OSError(f"{beside} is complete but could not be moved to {path}")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON document, or None if it is missing or malformed."""
    if not exists(spark, path):
        return None
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return None


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, where the driver's Hadoop file system says."""
    fs, own = _fs(spark, path)
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2) + "\n", path)
