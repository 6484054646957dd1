"""Whole pipelines: pages to raw rows, raw to clean rows, clean rows to statistics and to topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import clean, graph, html, merge, stats, text, topics
from ..sources import files


def crawl(spark: SparkSession, pages: DataFrame, existing: str, scraped_at: str, section: str | None = "blog") -> DataFrame:
    """Raw rows of ``pages`` merged with the CSV at ``existing``; fresh ones win. Write it with files.replace_csv() where that is the output too."""
    rows = html.article_rows(pages, scraped_at, section).drop("tag_source").withColumn("row_ord", F.monotonically_increasing_id())
    before = files.read_existing(spark, existing).withColumn("row_ord", F.monotonically_increasing_id())
    return merge.sorted_raw(merge.upsert(before, rows)).drop("row_ord")


def validate_raw(rows: DataFrame) -> None:
    """Unique URLs, titles, and tags within the limit; the exact columns."""
    if set(rows.columns) != set(clean.RAW):
        raise AssertionError(f"columns: {sorted(set(rows.columns) ^ set(clean.RAW))}")
    n, urls, untitled, many = rows.agg(F.count(F.lit(1)), F.count_distinct("url"), F.count_if(F.col("title") == ""), F.count_if(F.size(F.split("tags", r"\|")) > lexicon.MAX_TAGS)).first()
    if n != urls or untitled or many:
        raise AssertionError(f"{n - urls} repeated URLs, {untitled} without title, {many} with too many tags")


@dataclass
class Cleaned:
    kept: DataFrame
    dropped: DataFrame
    report: dict


def clean_rows(rows: DataFrame) -> Cleaned:
    marked = clean.with_reason(rows).persist()
    kept = clean.with_derived(marked.where("drop_reason IS NULL").drop("drop_reason")).orderBy(F.desc("published_at"), "url")
    return Cleaned(kept, marked.where("drop_reason IS NOT NULL").drop("published_at"), clean.report(marked))


@dataclass
class Topics:
    payload: dict
    articles: DataFrame
    scores: list[dict] = field(default_factory=list)


def model_topics(articles: DataFrame, candidates: list[int], stopwords: list[str] | None = None, rules=lexicon.LABEL_RULES, min_df: int = 5, max_df: float = 0.5, max_features: int = 5000, rounds: int = 25, seed: int = 42, kind: str = "tfidf", source: str = "articles") -> Topics:
    """Topics of clean articles: preprocessing, term weights, the search for the number of topics, and what follows."""
    if kind not in ("tfidf", "count"):
        raise ValueError(f"unknown kind of weights: {kind}")
    spark, stop = articles.sparkSession, stopwords or lexicon.stopwords()
    docs = text.corpus(articles)
    n = docs.count()
    # written, so that the plans of all that follows stay small
    tokens = files.written(text.prepared_docs(docs, "url", "document", stop), "tokens")
    vocab = text.vocabulary_list(tokens, "url", n, min_df, max_df, max_features)
    names = sorted(term for term, _, _ in vocab)
    if not names:
        raise ValueError("the vocabulary is empty")
    weights = "weights" if kind == "tfidf" else F.col("counts").cast("array<double>").alias("weights")
    vectors = files.written(text.term_vectors(tokens, "url", vocab, n).select("url", "ids", weights), "vectors")
    scores, models = topics.select_topics(vectors, names, candidates, n, rounds, seed)
    best = topics.best_score(scores)
    lam = models[best["n_topics"]]
    tw = topics.topic_weights(spark, lam, names).persist()
    keywords = topics.top_terms(tw).persist()
    found = topics.infer_lda(vectors, lam, "url")
    assigned = files.written(topics.dominant(found.unionByName(topics.uniform(docs, vectors, len(lam), "url")), "url"), "assigned")
    labels = topics.assign_labels(keywords, topics.rule_rows(spark, rules)).persist()
    enriched = topics.articles_with_topics(articles, assigned, labels, keywords, "url").persist()
    settings = {"input": source, "library": "corpusflow", "algorithm": "lda", "vectorizer": kind, "ngram_range": [1, 2], "min_df": text.least_df(n, min_df), "max_df": max_df, "max_features": max_features, "n_features": len(names), "random_state": seed, "max_iter": rounds, "candidates": candidates}
    return Topics(_payload(enriched, assigned, tw, keywords, labels, settings, scores, n, len(lam)), enriched, scores)


def _payload(enriched, assigned, tw, keywords, labels, settings, scores, n: int, k: int) -> dict:
    """The nested record of a model: a few rows for each topic."""
    name = {r.topic_id: r.label for r in labels.collect()}
    words: dict[int, list] = {i: [] for i in range(k)}
    for r in keywords.orderBy("topic_id", "rank").collect():
        words[r.topic_id].append({"term": r.term, "weight": round(r.weight, 5)})
    sizes = {r.topic_id: r for r in topics.topic_sizes(assigned, tw).collect()}
    tags: dict[int, list] = {i: [] for i in range(k)}
    for r in topics.tag_lift(enriched).orderBy("topic_id", "rank").collect():
        tags[r.topic_id].append({"tag": r.tag, "count": r.n, "share": r.tag_occurrence_share, "lift": r.lift})
    shown: dict[int, list] = {i: [] for i in range(k)}
    for r in topics.topic_examples(enriched, "url").orderBy("topic_id", "rank").collect():
        shown[r.topic_id].append({"title": r.title, "url": r.url})
    matrix = [[1.0 if i == j else 0.0 for j in range(k)] for i in range(k)]
    for r in topics.similarity(tw).collect():
        matrix[r.source][r.target] = matrix[r.target][r.source] = round(r.cosine, 4)
    edges = [r.asDict() for r in topics.similarity_edges(tw).orderBy(F.desc("weight"), "source", "target").collect()]
    return {
        "source": settings["input"],
        "n_documents": n,
        "n_topics": k,
        "settings": settings,
        "selection": scores,
        "topics": [{"topic_id": i, "label": name[i], "keywords": words[i], "article_count": sizes[i].article_count, "share": sizes[i].share, "top_tags": tags[i], "examples": shown[i]} for i in range(k)],
        "similarity": {"metric": "cosine", "matrix": matrix},
        "edges": edges,
        "coassignment_edges": [r.asDict() for r in graph.coassignment_edges(assigned).orderBy("source", "target").collect()],
    }


def validate_topics(payload: dict) -> None:
    total = sum(t["article_count"] for t in payload["topics"])
    labels = [t["label"] for t in payload["topics"]]
    if total != payload["n_documents"] or len(set(labels)) != len(labels) or len(labels) != payload["n_topics"]:
        raise AssertionError("topics do not partition the articles under distinct labels")


def topics_report(payload: dict) -> str:
    """The model as Markdown."""
    lines = ["# Topic model", "", f"- Documents: {payload['n_documents']}", f"- Topics: {payload['n_topics']}", f"- Features: {payload['settings']['n_features']}", "", "## Selection", "", "| Topics | UMass coherence | Perplexity |", "| --- | --- | --- |"]
    lines += [f"| {s['n_topics']} | {s['coherence_umass']:.4f} | {s['perplexity']:.1f} |" for s in payload["selection"]]
    for t in payload["topics"]:
        lines += ["", f"## {t['topic_id']}. {t['label']}", "", f"{t['article_count']} articles ({t['share']:.1%})", "", "Keywords: " + ", ".join(k["term"] for k in t["keywords"]), ""]
        lines += [f"- {g['tag']}: {g['count']} ({g['share']:.1%} of the topic's tags, lift {g['lift']})" for g in t["top_tags"]]
        lines += [f"- [{e['title']}]({e['url']})" for e in t["examples"]]
    led = sorted((t for t in payload["topics"] if t["top_tags"]), key=lambda t: (-t["top_tags"][0]["lift"], t["topic_id"]))
    lines += ["", "## Leading tags", "", "| Topic | Tag | Lift |", "| --- | --- | --- |", *(f"| {t['label']} | {t['top_tags'][0]['tag']} | {t['top_tags'][0]['lift']} |" for t in led)]
    lines += ["", "## Similar topics", "", *(f"- {e['source']} – {e['target']}: {e['weight']}" for e in payload["edges"]), ""]
    return "\n".join(lines)


def clean_files(spark: SparkSession, source: str, output: str, dropped: str, report: str) -> dict:
    done = clean_rows(files.load_raw(spark, source))
    clean.validate(done.kept)
    files.write_csv(done.kept.drop("row_ord"), output)
    files.write_csv(done.dropped.drop("row_ord"), dropped)
    files.write_json(spark, done.report, report)
    return done.report


def topics_files(spark: SparkSession, source: str, topics_json: str, articles_csv: str, report: str, candidates: list[int], **settings) -> Topics:
    """Validates before it writes."""
    done = model_topics(files.load_clean(spark, source), candidates, source=source, **settings)
    validate_topics(done.payload)
    files.write_csv(done.articles, articles_csv)
    files.write_json(spark, done.payload, topics_json)
    files.write_text(spark, topics_report(done.payload), report)
    return done


def stats_text(spark: SparkSession, source: str, report: str | None, top: int = 20) -> str:
    return stats.report_text(files.load_clean(spark, source), files.read_json(spark, report) if report else None, top)
