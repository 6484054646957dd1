"""Edges between topics and between tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def coassignment_edges(assigned: DataFrame) -> DataFrame:
    """Articles for each unordered pair of first and second topic."""
    a, b = F.least("topic_id", "topic_second_id"), F.greatest("topic_id", "topic_second_id")
    return assigned.where("topic_id <> topic_second_id").groupBy(a.alias("source"), b.alias("target")).agg(F.count(F.lit(1)).alias("n"))


def tag_cooccurrence(articles: DataFrame) -> DataFrame:
    """Articles with both of two tags; pairs come from each row's own short list."""
    tags = F.array_sort(F.array_distinct(C.split_tags(F.col("tags"))))
    rows = articles.select(tags.alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count(F.lit(1)).alias("n"))
