"""Tokens, vocabulary, lemmas and term weights of a corpus.

What is done to a token depends on the token, and for lemmas on what the corpus attests, but not on its place. So the
distinct matches of the token pattern are counted first, cleaned and lemmatized once each. Of the corpus, a lemma depends
only on the verbs it attests: prepared_docs() sends these to the tasks, which hold whole documents as arrays, so that no
token is shuffled. Rows of tokens, as content_lemmas() has them, are looked up in the table of words: the most frequent
ones, a bounded number, by a broadcast, and the others by a join.

A pair of words is no more frequent than either word. So vocabulary_list() counts words first, and then only pairs of such
as can still reach the vocabulary, by numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..sources.files import written


def corpus(articles: DataFrame) -> DataFrame:
    return articles.withColumn("document", F.concat("title", F.lit(". "), "excerpt"))


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, raw: matches of the token pattern."""
    return docs.select(key, F.posexplode(C.raw_tokens(F.col(text))).alias("pos", "raw"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """token and n of every token that the matches stand for."""
    counts = rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("n", F.explode(C.token_parts(F.col("raw"))).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))


def is_content(token: Column, stopwords: list[str]) -> Column:
    return token.isin(sorted(lexicon.DOMAIN_TERMS)) | (~token.isin(stopwords) & (F.length(token) >= lexicon.MIN_LENGTH))


def _bases(vocab: DataFrame, protected: list[str]) -> DataFrame:
    """token, fixed (the lemma where a list has it, or null) and base (the singular) of every token."""
    token = F.col("token")
    irregular = F.element_at(C._map(lexicon.IRREGULAR), token)
    fixed = F.when(token.isin(protected), token).when(token.isin(list(lexicon.IRREGULAR)), irregular)
    base = vocab.select("token", fixed.alias("fixed"), F.coalesce(C.depluralize(token), token).alias("base"))
    return base.withColumn("fixed", F.coalesce("fixed", F.when((F.col("base") != token) & F.col("base").isin(protected), F.col("base"))))


def attested_verbs(vocab: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """token and verb of the tokens in -ing and -ed whose verb is in ``vocab`` too."""
    base, options = _bases(vocab, sorted(lexicon.DOMAIN_TERMS) if protected is None else protected), []
    for suffix in ("ing", "ed"):
        b, n = F.col("base"), F.length("base") - len(suffix)
        stem = F.substring(b, F.lit(1), n)
        undoubled = F.when((n > 2) & (F.substring(b, n, F.lit(1)) == F.substring(b, n - 1, F.lit(1))), F.substring(b, F.lit(1), n - 1))
        fits = F.col("fixed").isNull() & b.endswith(suffix) & (n >= lexicon.MIN_LENGTH)
        options += [F.when(fits, x) for x in (stem, F.concat(stem, F.lit("e")), undoubled)]
    candidates = base.where(F.col("base").endswith("ing") | F.col("base").endswith("ed")).select("token", F.posexplode(F.array(*options)).alias("order", "stem"))
    known = vocab.select(F.col("token").alias("stem"))
    return candidates.where("stem IS NOT NULL").join(known, "stem").groupBy("token").agg(F.min(F.struct("order", "stem")).getField("stem").alias("verb"))


def lemmas(vocab: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """token and lemma of every token of ``vocab``."""
    protected = sorted(lexicon.DOMAIN_TERMS) if protected is None else protected
    return _bases(vocab, protected).join(attested_verbs(vocab, protected), "token", "left").select("token", F.coalesce("fixed", "verb", "base").alias("lemma"))


def token_parts(raw: str) -> list[str]:
    """As columns.token_parts() has them; most matches are letters only, which stay as they are."""
    if raw.isalpha() and raw not in lexicon.CANONICAL:
        return [raw]
    bare = raw.strip("-_/").rstrip(".")
    return lexicon.CANONICAL.get(bare, bare).split(" ") if bare.strip(lexicon.NUMBER_MARKS) else []


class Lemmatizer:
    """The content lemmas of a match of the token pattern, by the same rules as columns.token_parts(), lemmas() and is_content()."""

    def __init__(self, verbs: dict[str, str], stopwords: list[str]):
        self.verbs, self.stop, self.known = verbs, frozenset(stopwords), {}

    def __call__(self, raw: str) -> list[str]:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[raw] = self.content(raw)
        return found

    def content(self, raw: str) -> list[str]:
        own = [self.lemma(x) for x in token_parts(raw) if x not in self.stop]
        return [x for x in own if x in lexicon.DOMAIN_TERMS or (x not in self.stop and len(x) >= lexicon.MIN_LENGTH)]

    def lemma(self, token: str) -> str:
        if token in lexicon.DOMAIN_TERMS:
            return token
        return lexicon.IRREGULAR.get(token) or self.verbs.get(token) or singular(token)


def singular(token: str) -> str:
    """As columns.depluralize(), and the token itself where that has none."""
    n = len(token)
    if not token.endswith("s"):
        return token
    if token.endswith("ies") and n > 4:
        return token[:-3] + "y"
    if token.endswith(("sses", "shes", "ches", "xes", "zes")) and n > 4:
        return token[:-2]
    if n > lexicon.MIN_LENGTH and not token.endswith(tuple(lexicon.NO_PLURAL)):
        return token[:-1]
    return token


def offsets(lists: pa.Array) -> np.ndarray:
    """Where each list of the flattened array begins, and its end; nulls are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


#: lexicon.TOKEN for texts in lower case, without the steps back that could find nothing.
MATCHES = r"[a-z][a-z0-9]*+(?:\+\+|#)|\.?[a-z0-9]++(?:[-._/][a-z0-9]++)*+"

#: What has letters of MATCHES in lower case only, beside A-Z.
FOLDED = {"\u0130": "i\u0307", "\u212a": "k"}
_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= ord("A")) & (_BYTE <= ord("Z")), _BYTE + 32, _BYTE).astype(np.uint8)
_WORD = np.isin(_BYTE, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_JOINS = np.isin(_BYTE, np.frombuffer(b"-._/", np.uint8))


def matches(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The matches of MATCHES in the texts in lower case, one after another, and where those of each text begin, and their end.

    Runs of letters and digits that one of ``-._/`` joins are one match, with a point before it. A run of its own that begins
    with a letter and has no point takes a following ``#`` or ``++``.
    """
    for x, lower in FOLDED.items():
        texts = pc.replace_substring(texts, x, lower)
    texts = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")  # a line break ends each text
    sizes = pc.binary_length(texts).to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if not bounds[-1]:
        return np.zeros(len(bounds), np.int64), pa.array([], pa.string())
    own = np.frombuffer(texts.buffers()[2], np.uint8)[: bounds[-1]]
    own = _LOWER[own]
    word = _WORD[own]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[::2], edges[1::2]  # each run's first byte and the byte behind it
    head, tail = np.ones(len(first), bool), np.ones(len(first), bool)
    head[1:] = (first[1:] - last[:-1] != 1) | ~_JOINS[own[last[:-1]]]
    tail[:-1] = head[1:]
    alone = tail[head]
    first, last = first[head], last[tail]
    point = (first > 0) & (own[first - 1] == ord("."))
    able = alone & ~point & (own[first] >= ord("a"))
    double = (own[last] == ord("+")) & (own[np.minimum(last + 1, len(own) - 1)] == ord("+"))
    begin, end = first - point, last + np.where(able, np.where(own[last] == ord("#"), 1, 2 * double), 0)
    held = np.zeros(len(own), np.int8)
    held[begin] += 1
    held[end] -= 1
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    values = own[np.cumsum(held, dtype=np.int8).view(bool)]
    return np.searchsorted(begin, bounds), pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(values))

#: Bytes of text in a block, and rows of words or pairs that are dealt to one partition, about.
BLOCK, DEALT = 8 << 20, 1 << 19

#: Bytes of text that are searched for matches at once, which several arrays are as long as.
PIECE = 1 << 20

#: Matches that a task remembers, about.
REMEMBERED = 1 << 18

#: Bytes of text in a partition of documents that are dealt anew, and the most that a partition of a scan may hold.
LOAD, MOST_LOAD = 64 << 20, 256 << 20


class Block(NamedTuple):
    """Documents (``keys``) whose tokens are ``words[codes[ends[i]:ends[i + 1]]]``; ``groups`` has a list for each, or is None."""

    keys: pa.Array
    groups: pa.Array | None
    ends: np.ndarray
    codes: np.ndarray
    words: pa.Array

    def row(self, keys: pa.DataType) -> pa.RecordBatch:
        lists = pa.list_(pa.list_(pa.int64()))
        groups = pa.nulls(1, lists) if self.groups is None else pa.ListArray.from_arrays(pa.array([0, len(self.groups)], pa.int32()), self.groups.cast(lists.value_type))
        codes = self.codes.astype(np.uint16 if len(self.words) <= 1 << 16 else np.int32).tobytes()
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
        counts = [pa.array([n], pa.int64()) for n in (len(self.words), len(self.codes))]
        return pa.RecordBatch.from_arrays([one(self.keys, keys), groups, one(pa.array(self.ends), pa.int32()), pa.array([codes], pa.binary()), one(self.words, pa.string()), *counts], BLOCK_COLUMNS)


BLOCK_COLUMNS = ["keys", "groups", "ends", "codes", "words", "n_words", "n_tokens"]


def _block_schema(kind: str) -> str:
    return f"keys array<{kind}>, groups array<array<bigint>>, ends array<int>, codes binary, words array<string>, n_words bigint, n_tokens bigint"


def _key_kind(blocks: DataFrame) -> str:
    return blocks.schema["keys"].dataType.elementType.simpleString()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of batches with the first five of BLOCK_COLUMNS."""
    for batch in batches:
        for keys, groups, ends, codes, words in zip(*(batch.column(i) for i in range(5))):
            ends, codes = ends.values.to_numpy(zero_copy_only=False).astype(np.int64), codes.as_buffer()
            numbers = np.frombuffer(codes, np.uint16 if len(words.values) <= 1 << 16 else np.int32).astype(np.int64)
            yield Block(keys.values, groups.values, ends, numbers, words.values)


def _map_blocks(blocks: DataFrame, run, schema: str) -> DataFrame:
    """``run`` makes batches of an iterator of blocks."""
    return blocks.select(BLOCK_COLUMNS[:5]).mapInArrow(lambda batches: run(_read(batches)), schema)


def _dealt(blocks: DataFrame, column: str) -> int:
    """Partitions for what blocks have of ``column``."""
    return max(blocks.sparkSession.sparkContext.defaultParallelism, (blocks.agg(F.sum(column)).first()[0] or 0) // DEALT + 1)


def balanced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs``, dealt anew by key and text where one partition holds much more than a core's share of the text.

    A row group of a Parquet file is read by one task, however many partitions the scan has.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = docs.select(F.spark_partition_id().alias("part"), F.octet_length(text).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    most, total = size.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most <= min(2 * total / cores, MOST_LOAD):
        return docs
    return docs.repartition(cores * (total // (cores * LOAD) + 1), key, text)


def _cut(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices with some ``size`` bytes of text, the second column; at least one."""
    sizes = pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1
    for a, b in zip([0, *cuts], [*cuts, rows.num_rows]):
        yield rows.slice(a, b - a)


def raw_blocks(docs: DataFrame, key: str, text: str, groups: Column | None = None) -> DataFrame:
    """Blocks of all documents with the matches of the token pattern. ``groups``: an array of numbers for each document."""
    lists, grouped = F.lit(None).cast("array<bigint>") if groups is None else groups, groups is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, BLOCK):
                own = [matches(x.column(1)) for x in _cut(part, PIECE)]
                ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for x, _ in own]))]).astype(np.int64)
                coded = pa.concat_arrays([x for _, x in own]).dictionary_encode()
                yield Block(part.column(0), part.column(2) if grouped else None, ends, coded.indices.to_numpy(), coded.dictionary).row(part.column(0).type)

    rows = docs.select(F.col(key), F.col(text).alias("text"), lists.alias("groups"))
    return rows.mapInArrow(run, _block_schema(docs.schema[key].dataType.simpleString()))


def _new_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token: those of each list of matches, without the matches that the task has met before, as far as it remembers them."""
    met: set[str] = set()
    for batch in batches:
        for words in batch.column(0):
            new = set(words.values.to_pylist()) - met
            if len(met) > REMEMBERED:
                met.clear()
            met.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([t for x in new for t in token_parts(x)], pa.string())], ["token"])


def array_blocks(docs: DataFrame, key: str, groups: str | None = None) -> DataFrame:
    """Blocks of documents that have their words as the array ``tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(1).flatten().dictionary_encode()
                yield Block(batch.column(0), batch.column(2) if groups else None, offsets(batch.column(1)), coded.indices.to_numpy(), coded.dictionary).row(batch.column(0).type)

    return docs.select(key, "tokens", *([groups] if groups else [])).mapInArrow(run, _block_schema(docs.schema[key].dataType.simpleString()))


def block_docs(blocks: DataFrame, key: str) -> DataFrame:
    """key and ``tokens``: the documents of blocks, one row each."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield pa.RecordBatch.from_arrays([x.keys, pa.ListArray.from_arrays(pa.array(x.ends, pa.int32()), x.words.take(pa.array(x.codes)))], [key, "tokens"])

    return _map_blocks(blocks, run, f"`{key}` {_key_kind(blocks)}, tokens array<string>")


def _places(docs: DataFrame, key: str, text: str, verbs: dict[str, str], stopwords: list[str]) -> DataFrame:
    """key, the content lemmas of each row (``tokens``) and their places, of rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lemmatize = Lemmatizer(verbs, stopwords)
        for batch in batches:
            lists = batch.column(1)
            at, coded = offsets(lists), lists.flatten().dictionary_encode()
            own = [lemmatize(x) for x in coded.dictionary.to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            codes = coded.indices.to_numpy()
            n = sizes[codes]
            found = pa.array([y for x in own for y in x], pa.string()).take(pa.array(ranges((np.cumsum(sizes) - sizes)[codes], n)))
            ends = np.concatenate([[0], np.cumsum(n)])[at]
            inner = np.repeat(np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at)), n) * 16 + ranges(np.zeros(len(n), np.int64), n)
            ends32 = pa.array(ends, pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends32, found), pa.ListArray.from_arrays(ends32, pa.array(inner))], [key, "tokens", "places"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, C.raw_tokens(F.col(text)).alias("raw")).mapInArrow(run, f"`{key}` {kind}, tokens array<string>, places array<bigint>")


def prepared_blocks(docs: DataFrame, key: str, text: str, stopwords: list[str], group: Column | None = None) -> DataFrame:
    """Blocks of the documents' content lemmas in order, without documents that have none; rows of one key are one document,
    merged by place. ``group``: a number of each row, which is handed on for rows whose key is not null.

    The verbs sent to all tasks are the attested ones in -ing and -ed, which are few beside the vocabulary. What follows keeps
    the partitions of the documents, so that these are balanced() first.
    """
    held = balanced(docs.select(key, text, *([] if group is None else [group.cast("bigint").alias("group_")])), key, text)
    own = None if group is None else F.when(F.col(key).isNotNull(), F.array("group_")).otherwise(F.array().cast("array<bigint>"))
    again = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("again"))
    same, repeats = F.col(key).eqNullSafe(F.col("again")), not again.isEmpty()
    once = held.join(again, same, "left_anti") if repeats else held
    raw = written(raw_blocks(once, key, text, own), "raw")
    words = raw.select("words")
    if repeats:
        others = held.join(again, same, "left_semi")
        words = words.unionByName(written(raw_blocks(others, key, text).select("words"), "raw"))
    tokens = written(words.mapInArrow(_new_tokens, "token string"), "words").repartition(_dealt(raw, "n_words"), "token").distinct()
    verbs = dict(map(tuple, attested_verbs(tokens).collect()))

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        lemmatize = Lemmatizer(verbs, stopwords)
        for x in found:
            of = [lemmatize(w) for w in x.words.to_pylist()]
            sizes = np.array([len(y) for y in of], np.int64)
            coded, n = pa.array(list(chain.from_iterable(of)), pa.string()).dictionary_encode(), sizes[x.codes]
            codes = coded.indices.to_numpy()[ranges((np.cumsum(sizes) - sizes)[x.codes], n)]
            lengths = np.diff(np.concatenate([[0], np.cumsum(n)])[x.ends])
            kept = pa.array(lengths > 0)
            yield Block(x.keys.filter(kept), None if x.groups is None else x.groups.filter(kept), np.concatenate([[0], np.cumsum(lengths[lengths > 0])]), codes, coded.dictionary).row(x.keys.type)

    blocks = _map_blocks(raw, run, _block_schema(_key_kind(raw)))
    if not repeats:
        return blocks
    merged = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("places", "tokens"))))
    several = _places(others, key, text, verbs, stopwords).groupBy(key).agg(merged.alias("x")).select(key, F.col("x.tokens").alias("tokens"))
    if group is not None:
        several = several.join(others.groupBy(F.col(key).alias("again")).agg(F.flatten(F.collect_list(own)).alias("groups")), same).drop("again")
    return blocks.unionByName(array_blocks(several, key, "groups" if group is not None else None))


def prepared_docs(docs: DataFrame, key: str, text: str, stopwords: list[str]) -> DataFrame:
    """key and its content lemmas in order (``tokens``), of documents that have any, as prepared_blocks() has them."""
    return block_docs(prepared_blocks(docs, key, text, stopwords), key)


#: The most frequent words, which are met by a broadcast.
FREQUENT = 10_000


def content_lemmas(rows: DataFrame, stopwords: list[str], key: str) -> DataFrame:
    """key, pos, tokens: the lemmas of each match that carry content, before and after lemmatization; matches without any are left out."""
    counts = rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("raw", F.posexplode(C.token_parts(F.col("raw"))).alias("at", "token"))
    own = lemmas(parts.select("token").distinct()).where(is_content(F.col("lemma"), stopwords))
    content = parts.where(~F.col("token").isin(stopwords)).join(own, "token").groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("at", "lemma"))).alias("x"))
    # frequent words that carry none have an empty list, so that they are met like all others
    words = counts.join(content, "raw", "left").select("raw", "n", F.coalesce("x.lemma", F.array().cast("array<string>")).alias("tokens"))
    often = words.orderBy(F.desc("n"), "raw").limit(FREQUENT)
    met = rows.join(F.broadcast(often.select("raw", F.col("tokens").alias("met"))), "raw", "left")
    rare = met.where("met IS NULL").join(words.select("raw", "tokens"), "raw").select(key, "pos", "tokens")
    return met.where("met IS NOT NULL").select(key, "pos", F.col("met").alias("tokens")).unionByName(rare).where(F.size("tokens") > 0)


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """key and its tokens in order; a document's own tokens only."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("x")).select(key, F.flatten("x.tokens").alias("tokens"))


def ngrams(docs: DataFrame, key: str) -> DataFrame:
    """key, term: words and pairs of neighbouring words of the array ``tokens``."""
    pairs = F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return docs.select(key, F.explode(F.concat("tokens", F.when(F.size("tokens") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))


def least_df(n: int, min_df: int = 5, small: int = 50) -> int:
    return min_df if n >= small else 1


def term_statistics(terms: DataFrame, key: str) -> DataFrame:
    """df, the documents with a term, and cf, its occurrences. Counted by document first, so no set of ids is kept."""
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocabulary_terms(stats: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.5, most: int = 5000) -> DataFrame:
    """The terms of a model: within the bounds of df, the most frequent ``most`` of them (ties by name)."""
    return stats.where((F.col("df") >= least_df(n_docs, min_df)) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("cf"), "term").limit(most)


def tfidf(terms: DataFrame, vocab: DataFrame, n_docs: int, key: str) -> DataFrame:
    """key, term, weight: tf times ln((n + 1) / (df + 1)) + 1, rows scaled to unit length."""
    from pyspark.sql import Window

    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocab.select("term", "df"), "term").withColumn("w", F.col("tf") * (F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


#: Words that may be in pairs are numbered on the driver, if there are at most so many.
NUMBERED = 1 << 18


def _word_counts(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    """term, df and cf of the words of each block."""
    for x in found:
        words = len(x.words)
        _, held, _ = _grouped(np.repeat(np.arange(len(x.keys)), np.diff(x.ends)), x.codes, max(words, 1))
        yield pa.RecordBatch.from_arrays([x.words, pa.array(np.bincount(held, minlength=words)), pa.array(np.bincount(x.codes, minlength=words))], ["term", "df", "cf"])


def _numbers(x: Block, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the documents, their numbers in ``words`` (-1 for others), their documents, and whether the next is of the same one."""
    codes = pc.fill_null(pc.index_in(x.words, value_set=words), -1).to_numpy().astype(np.int64)[x.codes]
    of = np.repeat(np.arange(len(x.keys)), np.diff(x.ends))
    return codes, of, of[:-1] == of[1:]


def _grouped(of: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, id) in order, and how often each occurs."""
    both, n = np.unique(of * width + ids, return_counts=True)
    return both // width, both % width, n


def _pairs(x: Block, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours that are both in ``words``, as one number, and their documents."""
    codes, of, same = _numbers(x, words)
    met = np.flatnonzero(same & (codes[:-1] >= 0) & (codes[1:] >= 0))
    return codes[met] * max(len(words), 1) + codes[met + 1], of[met]


def _pair_counts(found: Iterator[Block], words: pa.Array) -> Iterator[pa.RecordBatch]:
    """pair, df and cf of the pairs of ``words`` in each block."""
    k = max(len(words), 1)
    for x in found:
        ids, of = _pairs(x, words)
        _, ids, n = _grouped(of, ids, k * k)
        each, place = np.unique(ids, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(place, minlength=len(each))), pa.array(np.bincount(place, n, len(each)).astype(np.int64))], ["pair", "df", "cf"])


def _likely_pairs(blocks: DataFrame, words: pa.Array, least: int, total: int) -> np.ndarray | None:
    """All pairs that can have a count of ``least``, in order; None if they are too many for the driver.

    Such a pair has at least one block's share of ``least`` in some block, by the block's share of all ``total`` tokens.
    """

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        known = np.array([], np.int64)
        for x in found:
            each, n = np.unique(_pairs(x, words)[0], return_counts=True)
            new = np.setdiff1d(each[n >= least * (len(x.codes) / total) * (1 - 1e-9)], known, assume_unique=True)
            known = np.union1d(known, new) if len(known) < NUMBERED else new
            yield pa.RecordBatch.from_arrays([pa.array(new)], ["pair"])

    pairs = _map_blocks(blocks, run, "pair bigint").distinct().limit(NUMBERED + 1).toArrow().column(0).to_numpy()
    return np.sort(pairs) if len(pairs) <= NUMBERED else None


def _counts_of(blocks: DataFrame, words: pa.Array, pairs: np.ndarray) -> DataFrame:
    """pair, df and cf of ``pairs``, which are few, so that a task sums them all."""

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        df, cf = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for x in found:
            ids, of = _pairs(x, words)
            at = np.minimum(np.searchsorted(pairs, ids), max(len(pairs) - 1, 0))
            held = pairs[at] == ids if len(pairs) else np.zeros(len(ids), bool)
            _, own, n = _grouped(of[held], at[held], max(len(pairs), 1))
            df += np.bincount(own, minlength=len(pairs))
            cf += np.bincount(own, n, len(pairs)).astype(np.int64)
        own = np.flatnonzero(cf)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[own], df[own], cf[own])], ["pair", "df", "cf"])

    return _map_blocks(blocks, run, "pair bigint, df bigint, cf bigint").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary_list(docs: DataFrame, key: str, n_docs: int, min_df: int = 5, max_df: float = 0.5, most: int = 5000) -> list[tuple[str, int, int]]:
    """As block_vocabulary(); ``docs`` has one row a key, and words without spaces as ``tokens``."""
    return block_vocabulary(written(array_blocks(docs, key), "blocks"), n_docs, min_df, max_df, most)


def block_vocabulary(blocks: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.5, most: int = 5000) -> list[tuple[str, int, int]]:
    """term, df and cf as vocabulary_terms() has them, in order, of written blocks in which no key repeats.

    The ``most`` words within the bounds have counts of ``least`` or more, so a term with fewer, or a pair with such a word, is
    none of the ``most`` terms. Of the pairs, those are counted that a first pass over the blocks finds often enough in one of
    them; all, where there is no such bound.
    """
    spark, low = blocks.sparkSession, least_df(n_docs, min_df)
    words = written(_map_blocks(blocks, _word_counts, "term string, df bigint, cf bigint").repartition(_dealt(blocks, "n_words"), "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "words")
    within = (F.col("df") >= low) & (F.col("df") <= max_df * n_docs)
    full, least = words.where(within).orderBy(F.desc("cf")).limit(most).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = least if full == most else 0
    able = words.where((F.col("df") >= low) & (F.col("cf") >= least))
    names = [r.term for r in able.select("term").limit(NUMBERED + 1).collect()]
    if len(names) > NUMBERED:  # so many words are equally frequent that numbering them bounds nothing
        own = vocabulary_terms(term_statistics(ngrams(block_docs(blocks, "key"), "key"), "key"), n_docs, min_df, max_df, most)
        return [(r.term, r.df, r.cf) for r in own.collect()]
    numbered, k = pa.array(names, pa.string()), max(len(names), 1)
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    likely = _likely_pairs(blocks, numbered, least, total) if least else None
    if likely is not None:
        counted = _counts_of(blocks, numbered, likely)
    else:
        pairs = _map_blocks(blocks, lambda found: _pair_counts(found, numbered), "pair bigint, df bigint, cf bigint")
        counted = pairs.repartition(_dealt(blocks, "n_tokens"), "pair").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    counted = counted.where(within & (F.col("cf") >= least))
    number = spark.createDataFrame(list(enumerate(names)), "i bigint, w string")
    first, second = number.toDF("a", "wa"), number.toDF("b", "wb")
    named = counted.withColumns({"a": F.expr(f"pair div {k}"), "b": F.col("pair") % k}).join(F.broadcast(first), "a").join(F.broadcast(second), "b").select(F.concat("wa", F.lit(" "), "wb").alias("term"), "df", "cf")
    own = able.where(within).select("term", "df", "cf").unionByName(named).orderBy(F.desc("cf"), "term").limit(most)
    return [(r.term, r.df, r.cf) for r in own.collect()]


class Terms:
    """The terms of a vocabulary, by their places in order, as they are found in blocks."""

    def __init__(self, vocab: list[tuple[str, int, int]]):
        self.names = sorted(term for term, _, _ in vocab)
        split = [t.split(" ") for t in self.names]
        words = sorted({w for t in split for w in t})
        place, self.k = {w: i for i, w in enumerate(words)}, max(len(words), 1)
        self.single = np.full(self.k + 1, -1, np.int64)  # the last is for the words that are in no term
        for i, t in enumerate(split):
            if len(t) == 1:
                self.single[place[t[0]]] = i
        two = sorted((place[t[0]] * self.k + place[t[1]], i) for i, t in enumerate(split) if len(t) == 2)
        self.codes, self.ids = np.array([x for x, _ in two] + [self.k**2], np.int64), np.array([i for _, i in two] + [-1], np.int64)
        self.words = pa.array(words, pa.string())

    def of(self, x: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with their distinct terms, in order, and how often each occurs."""
        codes, of, same = _numbers(x, self.words)
        met = np.flatnonzero(same & (codes[:-1] >= 0) & (codes[1:] >= 0))
        pair = codes[met] * self.k + codes[met + 1]
        at = np.searchsorted(self.codes, pair)
        alone, joined = self.single[codes], np.where(self.codes[at] == pair, self.ids[at], -1)
        return _grouped(np.concatenate([of[alone >= 0], of[met][joined >= 0]]), np.concatenate([alone[alone >= 0], joined[joined >= 0]]), max(len(self.names), 1))


def term_vectors(docs: DataFrame, key: str, vocab: list[tuple[str, int, int]], n_docs: int) -> DataFrame:
    """As block_vectors(), of documents that have their words as the array ``tokens``."""
    return block_vectors(array_blocks(docs, key), key, vocab, n_docs)


def block_vectors(blocks: DataFrame, key: str, vocab: list[tuple[str, int, int]], n_docs: int) -> DataFrame:
    """key, ids (places in the sorted terms), counts and weights (as tfidf() has them) of the documents that have any term of ``vocab``."""
    dfs, terms = {term: df for term, df, _ in vocab}, Terms(vocab)
    idf = np.log((n_docs + 1) / (np.array([dfs[t] for t in terms.names], float) + 1)) + 1

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for x in found:
            row, ids, n = terms.of(x)
            w = n * idf[ids]
            w = w / np.sqrt(np.bincount(row, w * w, len(x.keys)))[row]
            sizes = np.bincount(row, minlength=len(x.keys))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(y, kind)) for y, kind in ((ids, pa.int32()), (n, pa.int64()), (w, pa.float64()))]
            yield pa.RecordBatch.from_arrays([x.keys, *lists], [key, "ids", "counts", "weights"]).filter(pa.array(sizes > 0))

    return _map_blocks(blocks, run, f"`{key}` {_key_kind(blocks)}, ids array<int>, counts array<bigint>, weights array<double>")


def group_counts(blocks: DataFrame, vocab: list[tuple[str, int, int]]) -> DataFrame:
    """topic_id, idx, c: occurrences of each term in the documents of each group. Groups are few, so that a task sums them all."""
    terms = Terms(vocab)

    def run(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        width, sums = len(terms.names), {}
        for x in found:
            row, ids, n = terms.of(x)
            at, coded = offsets(x.groups), pc.dictionary_encode(x.groups.flatten(), null_encoding="encode")
            sizes = np.diff(at)[row]
            group = coded.indices.to_numpy()[ranges(at[row], sizes)]
            c = np.bincount(group * width + np.repeat(ids, sizes), np.repeat(n, sizes), len(coded.dictionary) * width).reshape(-1, width)
            for name, own in zip(coded.dictionary.to_pylist(), c):
                sums[name] = sums.get(name, 0) + own
        for name, own in sums.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.array(own[held].astype(np.int64))], ["topic_id", "idx", "c"])

    return _map_blocks(blocks, run, "topic_id bigint, idx int, c bigint").groupBy("topic_id", "idx").agg(F.sum("c").alias("c"))


def named_terms(spark, vocab: list[tuple[str, int, int]]) -> DataFrame:
    """idx and term of the terms of term_vectors(), at most the vocabulary's cap."""
    return spark.createDataFrame(list(enumerate(sorted(t for t, _, _ in vocab))), "idx int, term string")
