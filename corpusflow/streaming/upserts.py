"""Incremental counterparts: a stream of article rows kept as the latest row of each URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources.files import exists


#: Versions that are kept behind the newest one.
KEPT = 2


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, key: str = "url", order: str = "row_ord") -> StreamingQuery:
    """Each batch is merged into the table at ``target``, which has a folder for each version.

    A version is named by its batch, so that a batch that is run again after a failure starts from the same version and
    writes the same one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, target, number)
        merged = merge.upsert(before, batch, key, order) if before is not None else merge.upsert(batch.limit(0), batch, key, order)
        merged.write.mode("overwrite").parquet(f"{target}/version={number:012d}")
        drop_versions(spark, target, number - KEPT)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(n.split("=")[1]) for n in names if n.startswith("version=")]


def drop_versions(spark: SparkSession, target: str, before: int) -> None:
    """Deletes versions older than ``before``: no batch is run again that starts from one, and readers have had time to move on."""
    for number in _versions(spark, target):
        if number < before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={number:012d}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest version (older than ``before``)."""
    if not exists(spark, target):
        return None
    numbers = [n for n in _versions(spark, target) if before is None or n < before]
    return spark.read.parquet(f"{target}/version={max(numbers):012d}") if numbers else None


def first_by_url(rows: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each URL in a stream, within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by type in windows of time; late ones count until the watermark passes."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
