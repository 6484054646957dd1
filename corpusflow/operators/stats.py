"""Statistics of clean articles; each section is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def tag_rows(articles: DataFrame, *keep: str) -> DataFrame:
    return articles.select(*keep, F.explode(C.split_tags(F.col("tags"))).alias("tag"))


def tag_frequencies(articles: DataFrame) -> DataFrame:
    """Occurrences of each tag; a tag twice in a row counts twice."""
    return tag_rows(articles).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def top_tags(articles: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent tags with rank, share of articles and a bar. The rank is over n rows."""
    from pyspark.sql import Window

    total = articles.agg(F.count(F.lit(1)).alias("total"))
    top = tag_frequencies(articles).orderBy(F.desc("n"), "tag").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "tag")).cast("long")
    peak = F.max("n").over(Window.partitionBy())
    return top.crossJoin(F.broadcast(total)).select(rank.alias("rank"), "tag", "n", C.share(F.col("n"), F.col("total")).alias("share"), C.bar(F.col("n"), peak).alias("bar"))


def tag_stats(articles: DataFrame) -> DataFrame:
    rows = articles.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.col("tags") != "").cast("long").alias("n_tagged_rows"),
        F.count_if(F.col("tag_count") == 0).cast("long").alias("n_untagged"),
        F.bround(F.avg("tag_count"), 2).alias("mean_tags"),
        F.max("tag_count").alias("max_tags"),
    )
    tags = tag_frequencies(articles).agg(F.count(F.lit(1)).alias("n_tags"), F.count_if(F.col("n") == 1).cast("long").alias("n_singletons"))
    return rows.crossJoin(F.broadcast(tags))


def corpus_overview(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_distinct("url").alias("n_urls"),
        F.count_distinct(F.nullif("author", F.lit(""))).alias("n_authors"),
        F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("last_day"),
        F.count_if(F.col("author") == "").cast("long").alias("n_without_author"),
    )


def text_length_stats(articles: DataFrame) -> DataFrame:
    """Words of titles and excerpts: mean, exact median, least, most."""
    sizes = articles.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.size(C.words(F.col(c))).cast("long").alias("n")) for c in ("title", "excerpt")))).alias("x")).select("x.*")
    # counted by length first: the median is of few distinct lengths then, not of all rows in one buffer
    counts = sizes.groupBy("field", "n").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("field").agg(
        F.bround(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 4).alias("mean_words"),
        F.expr("percentile(n, 0.5, c)").alias("median_words"),
        F.min("n").alias("min_words"),
        F.max("n").alias("max_words"),
    )


def year_histogram(articles: DataFrame) -> DataFrame:
    counts = articles.groupBy("published_year").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("peak"))
    return counts.crossJoin(F.broadcast(whole)).select("published_year", "n", C.share(F.col("n"), F.col("total")).alias("share"), C.bar(F.col("n"), F.col("peak")).alias("bar"))


def recent(articles: DataFrame, months: int = 12) -> DataFrame:
    """Articles after the same day ``months`` before the newest one."""
    last = articles.agg(F.add_months(F.max("published_at"), -months).alias("after"))
    return articles.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("published_at") > F.col("after")).cast("long").alias("n_recent"), F.count(F.lit(1)).alias("n_articles"))


def report_text(articles: DataFrame, cleaning: dict | None, top: int = 20, title: str = "Cleaned dataset") -> str:
    """The text report; collects one row a section, a row a year and ``top`` tags."""
    head = lambda x: ["", x, "-" * len(x)]
    lines = [title, "=" * len(title), *head("1. Cleaning summary")]
    if cleaning is None:
        lines.append("(no report found)")
    else:
        removed, rows = cleaning.get("rows_dropped", 0), cleaning.get("rows_in", 0)
        lines += [f"raw rows     : {rows}", f"clean rows   : {cleaning.get('rows_out', 0)}", f"removed      : {removed} ({removed / rows * 100 if rows else 0:.1f}%)"]
        for reason, n in (cleaning.get("dropped_by_reason") or {}).items():
            lines += [f"  {n:>5}  {reason}", *(f"         e.g. {u}" for u in (cleaning.get("examples") or {}).get(reason, [])[:3])]
    over = corpus_overview(articles).first()
    lines += [*head("2. Corpus overview"), f"articles     : {over.n_articles}", f"unique URLs  : {over.n_urls}", f"unique authors: {over.n_authors}", f"date range   : {over.first_day} .. {over.last_day}"]
    for r in sorted(text_length_stats(articles).collect(), key=lambda r: r.field != "title"):
        lines.append(f"{r.field:<9} words: mean {r.mean_words:.1f}, median {r.median_words:.0f}, min {r.min_words}, max {r.max_words}")
    if over.n_without_author:
        lines.append(f"note         : {over.n_without_author} articles have no author")
    lines += head("3. Publication dates")
    lines += [f"{r.published_year}  {r.n:>5}  {r.share:>5.1f}%  {r.bar}" for r in year_histogram(articles).orderBy("published_year").collect()]
    now = recent(articles).first()
    lines.append(f"published in the last 12 months: {now.n_recent} ({now.n_recent / max(now.n_articles, 1) * 100:.1f}%)")
    tags = tag_stats(articles).first()
    lines += [*head(f"4. Tags (top {top})"), f"distinct tags: {tags.n_tags}", f"untagged articles: {tags.n_untagged} ({tags.n_untagged / max(tags.n_articles, 1) * 100:.1f}%)"]
    lines.append(f"tags per article: mean {tags.mean_tags or 0:.2f}, max {tags.max_tags or 0}")
    if not tags.n_tags:
        return "\n".join([*lines, "(no tags in the dataset)", ""])
    lines += [f"tags used by a single article: {tags.n_singletons} ({tags.n_singletons / tags.n_tags * 100:.1f}%)", ""]
    lines += [f"{r.rank:>3}. {r.tag:<28} {r.n:>5}  {r.share:>5.1f}%  {r.bar}" for r in top_tags(articles, top).orderBy("rank").collect()]
    return "\n".join([*lines, ""])
