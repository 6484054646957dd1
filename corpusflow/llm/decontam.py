"""Benchmark decontamination by a distributed positional inverted index; DataFrame operations only.

Method: the documents' tokens that occur in any benchmark item are stored once as postings (term, row, position) in the
shared folder; a row is known by hashes of its doc_id and text. A benchmark window asks for its terms from the rarest on: the postings of its rarest term,
shifted back by the term's offset, are the candidate starts; those are intersected with the shifted postings of the
second rarest term, and what is left with those of all other terms. What survives are exact phrase matches.
``proximity`` answers with the same lists where all of a window's terms stand within a distance of each other.

Broadcast are the vocabulary and the windows of the benchmark, and ids of candidate documents, each only if its counted
size is within ``BROADCAST_BYTES``; beyond that the same joins are left to shuffles.

Defined cases: null and empty texts have no words, hits or items; an item without words is no window and one of fewer
words than ``size`` is one window; equal windows of several items count for each of these; a document of any length is
matched as a whole; rows that repeat a doc_id give a row each, with the hits of their own text; an empty table on either
side gives no hits; other columns are ignored by ``matches`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, row_key, split_join

SIZE = 10
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words with A-Z still as they are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands behind the last word of each document; its position is the number of words. No word is empty.
END = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z as a-z; most words need no change, which lower() finds fastest."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """For a broadcast if that many rows are few enough, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


@dataclass
class Index:
    """postings: term, row, pos, doc_id (of an end only). windows: window, n, at (offset), term. items: window, item_id."""

    scratch: Scratch
    postings: DataFrame
    windows: DataFrame
    items: DataFrame
    n_windows: int
    n_items: int


def build(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> Index:
    scratch = Scratch(docs.sparkSession, "decontam")
    own = benchmark.select("item_id", F.transform(words(F.col("text")), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    phrases = own.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(size)).alias("phrase")).distinct()
    items = scratch.table(phrases, "phrases")
    numbered = scratch.table(items.select("phrase").distinct().withColumn("window", F.monotonically_increasing_id()), "numbered")
    n_windows = numbered.count()
    terms = numbered.select(F.explode("phrase").alias("word")).distinct()
    vocabulary = scratch.table(terms.withColumn("term", F.monotonically_increasing_id() + 1), "vocabulary")
    n_terms = vocabulary.count()
    known = vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term")))

    # the key is made before the explosion, so that no token carries its text along; _outer, since Spark would else filter by
    # the size of the list (it always has an end), and find the words twice
    keyed = docs.select("doc_id", row_key().alias("row"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("words"))
    tokens = keyed.select("doc_id", "row", F.posexplode_outer("words").alias("pos", "word"))
    tokens = tokens.select("doc_id", "row", "pos", lowered(F.col("word")).alias("word"))
    postings = scratch.table(tokens.join(bounded(known, n_terms, 64), "word").select("term", "row", "pos", F.when(F.col("term") == 0, F.col("doc_id")).alias("doc_id")), "postings")

    placed = numbered.select("window", F.size("phrase").alias("n"), F.posexplode("phrase").alias("at", "word"))
    windows = scratch.table(placed.join(vocabulary, "word").select("window", "n", "at", "term"), "windows")
    owners = scratch.table(items.join(numbered, "phrase").select("window", "item_id"), "items")
    return Index(scratch, postings, windows, owners, n_windows, owners.count())


def ranked(index: Index) -> DataFrame:
    """windows with ``rarity``, 1 for the term of the window that is rarest in the documents; without windows of which a term never occurs."""
    counts = index.postings.where("term > 0").groupBy("term").count()
    order = Window.partitionBy("window").orderBy("count", "at")
    rows = index.windows.join(counts, "term").withColumn("rarity", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("window")))
    return index.scratch.table(rows.where("found = n").select("window", "n", "at", "term", "rarity"), "ranked")


def _shifted(index: Index, windows: DataFrame) -> DataFrame:
    """Starts that the postings of one term of each window allow: window, n, row, start."""
    wanted = bounded(windows.select("window", "n", "at", "term"), index.n_windows, 40)
    return index.postings.join(wanted, "term").where("pos >= at").select("window", "n", "row", (F.col("pos") - F.col("at")).alias("start"))


def matches(index: Index) -> DataFrame:
    """Exact phrase matches: window, n, row, start."""
    rows, scratch = ranked(index), index.scratch
    first, second = _shifted(index, rows.where("rarity = 1")), _shifted(index, rows.where("rarity = 2"))
    both = first.join(second.select("window", "row", "start"), ["window", "row", "start"], "left_semi")
    # rows that repeat an id with their text give each start again; the counts below are of different ones
    left = scratch.table(both.distinct().unionByName(first.where("n = 1").distinct()), "left")

    documents = scratch.table(left.where("n > 2").select("row").distinct(), "candidates")
    narrowed = index.postings.join(bounded(documents, documents.count(), 24), "row", "left_semi")
    more = left.where("n > 2").join(bounded(rows.where("rarity > 2").select("window", "at", "term"), 8 * index.n_windows, 40), "window")
    wanted = more.select("window", "n", "row", "start", "term", (F.col("start") + F.col("at")).alias("pos"))
    found = wanted.join(narrowed, ["row", "pos", "term"], "left_semi").groupBy("window", "n", "row", "start").count()
    return scratch.table(found.where("count = n - 2").drop("count").unionByName(left.where("n <= 2")).distinct(), "matches")


def proximity(index: Index, distance: int) -> DataFrame:
    """Where all different terms of a window stand within ``distance`` words of its rarest one, in any order: window, doc_id, pos (of the rarest)."""
    rows = ranked(index).dropDuplicates(["window", "term"])
    needed = Window.partitionBy("window")
    rows = rows.withColumn("terms", F.count(F.lit(1)).over(needed)).withColumn("least", F.min("rarity").over(needed))
    anchors = index.postings.join(rows.where("rarity = least").select("window", "terms", "term"), "term").select("window", "terms", "row", F.col("pos").alias("anchor"))
    # an equality on stretches of positions keeps the join from pairing all of a document's tokens
    stretch = lambda c: F.floor(c / F.lit(distance + 1))
    around = anchors.withColumn("stretch", F.explode(F.array(*(stretch(F.col("anchor")) + i for i in (-1, 0, 1)))))
    others = index.postings.join(rows.where("rarity > least").select("window", "term"), "term").select("window", "row", "pos", "term", stretch(F.col("pos")).alias("stretch"))
    near = around.join(others, ["window", "row", "stretch"]).where(F.abs(F.col("pos") - F.col("anchor")) <= distance)
    found = near.groupBy("window", "row", "anchor", "terms").agg(F.count_distinct("term").alias("count")).where("count = terms - 1")
    single = anchors.where("terms = 1").select("window", "row", "anchor")
    named = index.postings.where("term = 0").select("row", "doc_id").distinct()
    return found.select("window", "row", "anchor").unionByName(single).distinct().join(named, "row").select("window", "doc_id", F.col("anchor").alias("pos"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as strings, sorted) of every document."""
    index = build(docs, benchmark, size)
    found = matches(index)
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("row", "window").distinct().join(bounded(index.items, index.n_items, 40), "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    sizes = index.postings.where("term = 0").select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    # rows that repeat an id with their text have one key
    out = split_join(sizes, hit.join(items, "row", "left"), ["row"], hot_keys(sizes, ["row"]), "left")
    out = index.scratch.table(out, "report")
    index.scratch.keep("report")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    index = build(docs, benchmark, size)
    found = matches(index).select(F.col("row").alias("__row")).distinct()
    index.scratch.keep("matches")
    return docs.withColumn("__row", row_key()).join(bounded(found, found.count(), 24), "__row", "left_anti").select(*docs.columns)


REPORT_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:least(i + 9, len(w))] AS t FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(t) AS n FROM win),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
