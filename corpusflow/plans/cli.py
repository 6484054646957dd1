"""Command line: python -m corpusflow.plans.cli crawl|clean|stats|topics."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import html, merge
from ..operators.clean import SchemaError
from ..operators.topics import best_score
from ..sources import files, web
from . import pipelines


LOG = logging.getLogger("corpusflow")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusflow")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("crawl")
    p.add_argument("--base", required=True)
    p.add_argument("--pages", type=int, default=2)
    p.add_argument("--start-page", type=int, default=1)
    p.add_argument("--limit", type=int)
    p.add_argument("--no-details", action="store_true", help="URLs only")
    p.add_argument("--delay-min", type=float, default=web.DELAY_MIN)
    p.add_argument("--delay-max", type=float, default=web.DELAY_MAX)
    p.add_argument("--existing", help="earlier rows to merge with (default: those at --output)")
    p.add_argument("--output", default="articles_raw")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("clean")
    p.add_argument("--input", default="articles_raw")
    p.add_argument("--output", default="articles_clean")
    p.add_argument("--dropped-output", default="articles_dropped")
    p.add_argument("--report-output", default="cleaning_report.json")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("stats")
    p.add_argument("--input", default="articles_clean")
    p.add_argument("--report", default="cleaning_report.json")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--output")
    p = sub.add_parser("topics")
    p.add_argument("--input", default="articles_clean")
    p.add_argument("--topics-output", default="topics.json")
    p.add_argument("--articles-output", default="articles_with_topics")
    p.add_argument("--report-output", default="topics.md")
    p.add_argument("--topics", type=int)
    p.add_argument("--topic-range", type=int, nargs=3, default=[8, 22, 2])
    p.add_argument("--vectorizer", choices=["tfidf", "count"], default="tfidf")
    p.add_argument("--min-df", type=int, default=5)
    p.add_argument("--max-df", type=float, default=0.5)
    p.add_argument("--max-features", type=int, default=5000)
    p.add_argument("--max-iter", type=int, default=25)
    p.add_argument("--random-state", type=int, default=42)
    p.add_argument("--stopword", action="append", default=[], help="a further stop word, such as the site's name; may be given again")
    p.add_argument("-v", "--verbose", action="store_true")
    return top


def topic_range(first: int, last: int, step: int) -> list[int]:
    """first, first + step, ... up to last, first in any case."""
    return list(range(first, last + 1, max(1, step))) or [first]


def crawl(spark: SparkSession, args: argparse.Namespace) -> int:
    pages = spark.read.format("web_pages").options(base=args.base, delay_min=args.delay_min, delay_max=args.delay_max)
    load = lambda urls, **options: pages.options(urls="\n".join(urls), **options).load().persist()  # noqa: E731 each page is fetched once
    try:
        listing = [r.url for r in web.listing_urls(spark, args.base, args.pages, args.start_page).orderBy("page").collect()]
        order = spark.createDataFrame(list(enumerate(listing)), "page int, page_url string")
        found = load(listing, listing=True)
        links = merge.first_seen(html.article_links(found, base=args.base).join(order, "page_url")).orderBy("page", "pos")
        urls = [r.url for r in (links.limit(args.limit) if args.limit else links).collect()]  # as many as are fetched one by one
    except Exception as error:
        if "RobotsUnavailable" in str(error):
            LOG.error("the robots rules can't be read: nothing is fetched")
            return 2
        raise
    LOG.info("%d articles on the listing pages", len(urls))
    if not urls:
        LOG.error("no articles collected")
        return 1
    if args.no_details:
        files.write_csv(spark.createDataFrame([(u,) for u in urls], "url string"), args.output, single=True)
        return 0
    fresh = load(urls, listing=False, begun=True)
    if fresh.isEmpty():
        LOG.error("no articles collected")
        return 1
    rows = pipelines.crawl(spark, fresh, args.existing or args.output, dt.datetime.now(dt.timezone.utc).date().isoformat()).persist()
    pipelines.validate_raw(rows)
    n, tagged = rows.count(), rows.where(F.col("tags") != "").count()
    files.replace_csv(rows, args.output, single=True)
    print(f"{n} rows, {tagged} with tags")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.__dict__.get("verbose") else logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("corpusflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.dataSource.register(web.WebPages)
    try:
        if args.command == "crawl":
            return crawl(spark, args)
        if args.command == "clean":
            print(pipelines.clean.report_text(pipelines.clean_files(spark, args.input, args.output, args.dropped_output, args.report_output)))
        elif args.command == "stats":
            if files.load_clean(spark, args.input).isEmpty():
                return 1
            said = pipelines.stats_text(spark, args.input, args.report, args.top)
            print(said)
            if args.output:
                files.write_text(spark, said, args.output)
        else:
            ks = [args.topics] if args.topics else topic_range(*args.topic_range)
            done = pipelines.topics_files(spark, args.input, args.topics_output, args.articles_output, args.report_output, ks, min_df=args.min_df, max_df=args.max_df, max_features=args.max_features, rounds=args.max_iter, seed=args.random_state, kind=args.vectorizer, stopwords=lexicon.stopwords(args.stopword))
            print(best_score(done.scores))
    except (FileNotFoundError, SchemaError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
