"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ONE_TASK, Scratch, hot_rows, split_join


def connected(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """id and component, the smallest id reachable, of every id on an edge ``a``, ``b``.

    Large-star and small-star steps in turn: each id's neighbours are linked to the smallest one, until nothing
    changes. A step shuffles the edges, which never grow in number; nothing is gathered by id, and the edges of hubs are
    met by a broadcast.
    """

    def star(pairs: DataFrame, n: int, large: bool) -> DataFrame:
        # u's neighbours v: all of them, or those smaller than u
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        counted = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = counted.select("u", F.least("u", "m").alias("m"))
        joined = split_join(around, least, ["u"], counted.where(F.col("n") > hot_rows(2 * n)).select("u") if 2 * n > ONE_TASK else None)
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, i = mark(now), 0
    while seen[0]:
        i += 1
        after = scratch.table(star(star(now, seen[0], large=True), seen[0], large=False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now, last, seen = after, seen, mark(after)
        if last == seen:
            break
    # stars now: every other id points to the smallest
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
