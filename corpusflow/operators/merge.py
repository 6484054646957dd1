"""Incremental operators: upserts by URL and first-seen links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, fresh: DataFrame, key: str = "url", order: str = "row_ord") -> DataFrame:
    """Both sides by ``key``: fresh rows win, and within a side the last by ``order``; rows without key go.

    One aggregate with max_by, combined before the shuffle: a key with very many rows costs a row for each task.
    """
    sides = existing.withColumn("__side", F.lit(0)).unionByName(fresh.withColumn("__side", F.lit(1))).where(F.coalesce(F.col(key), F.lit("")) != "")
    columns = existing.columns
    best = sides.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("__side", order)).alias("row"))
    return best.select("row.*").select(*columns)


def sorted_raw(rows: DataFrame) -> DataFrame:
    """Newest first, then URLs from last to first."""
    return rows.orderBy(F.desc("published_date"), F.desc("url"))


def first_seen(links: DataFrame) -> DataFrame:
    """The first page (and place on it) of each URL among rows of page, pos, url."""
    return links.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("at")).select("url", F.col("at.page").alias("page"), F.col("at.pos").alias("pos"))


def unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    return links.join(seen.select("url").distinct(), "url", "left_anti")


def until_nothing_new(links: DataFrame, pages: DataFrame) -> DataFrame:
    """First-seen URLs of the pages before the first one that brings none: one that is missing, empty, or has known links only.

    ``pages`` has the numbers (page) of all pages asked for, so that a missing one counts.
    """
    firsts = first_seen(links)
    new = firsts.select("page").distinct()
    stop = pages.join(new, "page", "left_anti").agg(F.min("page").alias("stop"))
    return firsts.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")
