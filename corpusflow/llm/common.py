"""What the operators share: scratch tables in the shared folder, text batches and tokenization by bytes."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no shared folder and everything runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a local one only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or LOCAL_SHARED).rstrip("/")


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/corpusflow/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """For a table that nothing reads any more."""
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all other tables, once what follows reads these alone."""
        for name in sorted(self.names - set(names)):
            self.drop(name)


def row_key() -> Column:
    """96 bits that stand for a row's doc_id and text, for tables in which ids repeat; never null."""
    return F.struct(F.xxhash64("doc_id", "text").alias("x"), F.hash("text", "doc_id").alias("y"))


#: Most keys that are hot: those with more than 1 / HOT of all rows (and more than HOT_ROWS). Of so few rows as ONE_TASK, a task
#: can hold all, and no key is hot.
HOT, HOT_ROWS, ONE_TASK = 10_000, 256, 1 << 17


def hot_rows(total: int) -> int:
    """Rows beyond which a key is hot, if there are ``total``; so many keys can't be more than HOT."""
    return max(HOT_ROWS, total // HOT)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """The hot keys of ``rows``, counted with partial sums before the shuffle; None if there can't be any."""
    total = rows.count()
    if total <= ONE_TASK:
        return None
    return rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows(total)).select(on)


def split_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """A join with ``right``, in which no key repeats. Rows of the hot keys, at most HOT, are met by a broadcast and not shuffled."""
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(hot, on, "left_semi").join(few, on, how).unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes blocks and partitions, so that these grow in number and not in size."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces(batches: Iterator[pa.RecordBatch], at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose column ``at`` holds about ``limit`` bytes, which bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at).cast(pa.large_binary())])
        cut = np.cumsum(sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def release() -> None:
    """Gives freed memory back to the system at the end of a task, since Spark keeps its Python workers for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
