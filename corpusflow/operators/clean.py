"""Cleaning of raw article rows: one reason for each dropped row, the kept rows with derived columns, and a report.

Rows have title, url, published_date, author, tags, excerpt, scraped_at as strings, and row_ord, their place in the
input. Reasons are judged in the order of REASONS; only rows without another fault compete for a URL, of which the
first by row_ord stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

RAW = ["title", "url", "published_date", "author", "tags", "excerpt", "scraped_at"]
REASONS = ["missing url", "missing published_date (certification page)", "unparsable published_date", "empty title", "empty excerpt", "duplicate url"]


class SchemaError(ValueError):
    """A required column is missing."""


def required(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The raw columns in their order, null as empty, stripped."""
    if missing := [c for c in RAW if c not in rows.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return rows.select(*extra, *(C.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in RAW))


def with_reason(rows: DataFrame) -> DataFrame:
    """``rows`` with published_at and drop_reason, null for rows that stay.

    The first row of each URL is found by an aggregate (combined before the shuffle) and joined by row_ord, which no
    two rows share, so that one URL with very many rows does not gather in a task.
    """
    day = C.strict_date(F.col("published_date"))
    first = (
        F.when(F.col("url") == "", REASONS[0])
        .when(F.col("published_date") == "", REASONS[1])
        .when(day.isNull(), REASONS[2])
        .when(F.col("title") == "", REASONS[3])
        .when(F.col("excerpt") == "", REASONS[4])
    )
    marked = rows.withColumn("published_at", day).withColumn("drop_reason", first)
    kept = marked.where("drop_reason IS NULL").groupBy("url").agg(F.min("row_ord").alias("row_ord")).select("row_ord", F.lit(True).alias("is_first"))
    joined = marked.join(kept, "row_ord", "left")
    return joined.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("is_first").isNull(), REASONS[5]).otherwise(F.col("drop_reason"))).drop("is_first")


def with_derived(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        F.year("published_at").cast("long").alias("published_year"),
        F.date_format("published_at", "yyyy-MM").alias("published_month"),
        F.size(C.split_tags(F.col("tags"))).cast("long").alias("tag_count"),
    )


def clean(rows: DataFrame) -> DataFrame:
    """The rows that stay, newest first, then by URL."""
    return with_derived(with_reason(rows).where("drop_reason IS NULL").drop("drop_reason")).orderBy(F.desc("published_at"), "url")


def dropped(rows: DataFrame) -> DataFrame:
    return with_reason(rows).where("drop_reason IS NOT NULL").drop("published_at")


def drop_report(marked: DataFrame) -> DataFrame:
    """drop_reason and rows of each reason that occurs, with its ordinal."""
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("drop_reason"))
    return marked.where("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).withColumn("ordinal", order.cast("long"))


def drop_examples(marked: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` URLs of each reason. Spark limits the ranks before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("drop_reason").orderBy("row_ord"))
    return marked.where("drop_reason IS NOT NULL").select("drop_reason", "url", rank.cast("long").alias("rank")).where(F.col("rank") <= n)


def report(marked: DataFrame) -> dict:
    """Counts and examples as one small record on the driver: a row for each reason and example."""
    counts = {r["drop_reason"]: r["n"] for r in drop_report(marked).orderBy("ordinal").collect()}
    total = marked.count()
    examples: dict[str, list[str]] = {reason: [] for reason in counts}
    for r in drop_examples(marked).orderBy("drop_reason", "rank").collect():
        examples[r["drop_reason"]].append(r["url"])
    lost = sum(counts.values())
    return {"rows_in": total, "rows_out": total - lost, "rows_dropped": lost, "dropped_by_reason": counts, "examples": examples}


def report_text(said: dict) -> str:
    lines = [f"rows in : {said['rows_in']}", f"rows out: {said['rows_out']}", f"removed : {said['rows_dropped']}"]
    for reason, n in said["dropped_by_reason"].items():
        shown = ", ".join(said["examples"].get(reason, []))
        lines.append(f"  - {reason}: {n}" + (f"  (e.g. {shown})" if shown else ""))
    return "\n".join(lines)


def violations(rows: DataFrame) -> DataFrame:
    """Violated invariants of clean rows, as counts in one row."""
    blank = [F.count_if(F.col(c) == "").cast("long").alias(f"blank_{c}") for c in ("url", "title", "excerpt", "published_date")]
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *blank,
        (F.count(F.lit(1)) - F.count_distinct("url")).alias("repeated_urls"),
        F.count_if(F.col("published_at").isNull()).cast("long").alias("bad_dates"),
        F.count_if(F.col("tag_count") != F.size(C.split_tags(F.col("tags")))).cast("long").alias("bad_tag_counts"),
    )


def validate(rows: DataFrame) -> None:
    found = violations(rows).first().asDict()
    wrong = {k: v for k, v in found.items() if k != "n_rows" and v}
    if wrong:
        raise AssertionError(f"violated: {wrong}")
