"""Near-duplicates by MinHash with odd sketches.

Method: a document is the set of its distinct five-word shingles. BANDS x ROWS MinHash samples give band keys, and
documents that share one are candidates. The samples are also folded into an odd sketch, a bitmap in which each sample
flips one bit, so that the population count of two sketches' exclusive-or estimates high similarities closely.
Candidates whose estimate is far too low are dropped. A second odd sketch folds the whole set; two such differ in at
most as many bits as the sets differ in shingles, which rules out pairs for certain. All others are compared on their
full sets, which alone decides.

Groups of copies: documents with one set are one class, which has a number of its own. In a bucket (the classes of one
band key) each class is compared with three of them (by number the smallest and the largest, and the smallest by a
hash), not with all. Components follow from the confirmed links. Only in buckets that then still hold several
components, the classes outside the largest one are compared with all others across components. So no link between
components is left out, while a group of copies costs rows in proportion to its size.

Hot groups: keys with more than a bounded share of the rows (a set that very many documents have, a bucket of very many
classes, a class in very many pairs) are at most HOT, and are met by a broadcast and not shuffled.

Defined cases: texts of fewer than five words are one shingle of all their words; null, empty and blank texts have the
empty set and link with nothing; very long texts have whole sets; rows that repeat an id are one node, linked with what
any of them links with, and give a row each; ids may be of any type that can be ordered; rows whose id is null are
compared by their texts but are no node, and ``keep_first`` keeps them where no row with an id is in their component; an
empty table gives an empty result; other columns are ignored by ``components`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, hot_rows, pieces, release, row_key, split_join
from .graph import connected
from .vec import Words, mix, shingles

SHINGLE, PERCENT = 5, 85
#: A pair of similarity 0.85 misses all bands with a probability of (1 - 0.85**5)**28 = 8e-8, one of 0.8 with 1.5e-5.
BANDS, ROWS = 28, 5
#: Bits of the odd sketch, which are held in longs.
BITS = 512
ODD = [f"o{i}" for i in range(BITS // 64)]
#: An estimate so far below a least similarity of 0.85 drops a candidate: six times the estimate's spread there.
DOUBT = 0.21
#: Bits of the odd sketch of the whole set.
WHOLE_BITS = 1024
WHOLE = [f"p{i}" for i in range(WHOLE_BITS // 64)]
#: Pairs of one document, or classes of one bucket, that go to one group of rows.
SALT = 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)


def samples(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples of non-empty sets that stand one after another, a row of BANDS * ROWS for each."""
    a = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    b = mix(a)
    # multiply and shift: the upper half decides
    return np.stack([np.minimum.reduceat((own * a[i] + b[i]) >> np.uint64(32), first) for i in range(len(a))], 1)


def band_keys(rows: np.ndarray) -> np.ndarray:
    rows = rows.reshape(len(rows), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * GOLD + rows[:, :, k])
    return key.view(np.int64)


def odd_sketches(rows: np.ndarray) -> np.ndarray:
    """Parities of each row's samples dealt over BITS bits, as longs."""
    n, k = rows.shape
    at = mix(rows * GOLD + np.arange(1, k + 1, dtype=np.uint64))
    return parities(at.ravel(), np.repeat(np.arange(n), k), n, BITS)


def parities(values: np.ndarray, row: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps of n rows in which each value of a row flips one bit."""
    flips = np.bincount((values % np.uint64(bits)).astype(np.int64) + row * bits, minlength=n * bits).reshape(n, bits)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.int64).reshape(n, -1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity by the number of bits in which two odd sketches differ."""
    return 1 + BITS / (4 * BANDS * ROWS) * np.log(1 - np.minimum(2 * differing / BITS, 1 - 1e-9))


def most_differing(percent: int) -> int:
    """Differing bits beyond which the estimate is under the least similarity by more than DOUBT, which grows with the spread there."""
    doubt = DOUBT * np.sqrt(percent * (100 - percent) / (PERCENT * (100 - PERCENT)))
    return int(BITS / 2 * (1 - np.exp((percent / 100 - doubt - 1) * 4 * BANDS * ROWS / BITS)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), n_shingles, the set's digest ``d1``, ``d2``, ``bands`` and the odd sketches; all but the first three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 1 << 20):
            own, first = shingles(Words([x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]), SHINGLE)
            n = np.diff(first)
            full = np.flatnonzero(n)
            place = np.full(len(n), -1)
            place[full] = np.arange(len(full))
            take = pa.array(place, mask=place < 0)
            begins = first[:-1][full]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64())]
            if len(full):
                rows = samples(own, begins)
                digest = [np.add.reduceat(mix(own ^ s), begins).view(np.int64) for s in (np.uint64(0), GOLD)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(rows).ravel()))
                whole = parities(mix(own), np.repeat(np.arange(len(full)), n[full]), len(full), WHOLE_BITS)
                columns += [pa.array(x).take(take) for x in digest] + [bands.take(take)] + [pa.array(x).take(take) for x in (*odd_sketches(rows).T, *whole.T)]
            else:
                columns += [pa.nulls(len(n), pa.int64())] * 2 + [pa.nulls(len(n), pa.list_(pa.int64()))] + [pa.nulls(len(n), pa.int64())] * len(ODD + WHOLE)
            yield pa.record_batch(columns, names=["doc_id", "row", "n_shingles", "d1", "d2", "bands", *ODD, *WHOLE])
        release()

    odd = ", ".join(f"{x} long" for x in ODD + WHOLE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row struct<x:long,y:int>, n_shingles long, d1 long, d2 long, bands array<long>, {odd}")


def _plausible(percent: int) -> Column:
    """That odd sketches and sizes of ``l`` and ``r`` don't rule out a link."""
    differing = lambda names: sum((F.bit_count(F.col(f"l.{x}").bitwiseXOR(F.col(f"r.{x}"))) for x in names), F.lit(0))
    l, r = F.col("l.n_shingles"), F.col("r.n_shingles")
    # sets of such a similarity differ in at most (100 - percent) / (100 + percent) of their sizes' sum
    possible = differing(WHOLE) * (100 + percent) <= (100 - percent) * (l + r)
    return possible & (differing(ODD) <= most_differing(percent)) & (100 * F.least(l, r) >= percent * F.greatest(l, r))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that the odd sketches don't rule out; ``pairs`` is a written table."""
    one = classes.select("id", "n_shingles", *ODD, *WHOLE)
    with_ = lambda left, x, side: split_join(left, one.select(F.col("id").alias(x), F.struct("n_shingles", *ODD, *WHOLE).alias(side)), [x], hot_keys(pairs, [x]))
    return with_(with_(pairs, "b", "r"), "a", "l").where(_plausible(percent)).select("a", "b")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of classes whose full sets have 100 * intersection >= percent * union.

    The text of ``b`` travels once for each of its pairs, that of ``a`` once for each of its salts, so that a document
    of very many pairs is dealt over many tasks, of which each holds one batch and one set.
    """
    salts = max(1, -(-pairs.count() // SALT))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # one text of each class; rows that repeat an id with its text are one before the shuffle
    text = docs.select(row_key().alias("row"), "text").join(classes.join(needed, "id").select("id", "row"), "row").groupBy("id").agg(F.first("text").alias("text"))
    left = salted.select("a", "salt").distinct().join(text, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = split_join(salted, text.withColumnRenamed("id", "b"), ["b"], hot_keys(salted, ["b"])).select("a", "salt", "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in pieces(batches, 3, 1 << 20):
            own, first = shingles(Words([x or b"" for x in batch.column(3).cast(pa.binary()).to_pylist()]), SHINGLE)
            found: list[tuple[int, int]] = []
            for i, (a, salt, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                part = own[first[i] : first[i + 1]]
                if b is None:
                    held = (a, salt, part)
                elif held[:2] == (a, salt):
                    both = len(np.intersect1d(held[2], part, assume_unique=True))
                    if both and 100 * both >= percent * (len(part) + len(held[2]) - both):
                        found.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    # each left text comes before its partners
    together = left.unionByName(right).repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return together.mapInArrow(compare, "a long, b long")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every document."""
    return _components(docs, percent).drop("row")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    every = scratch.table(sketches(docs), "sketches")
    full = every.where("d1 IS NOT NULL")
    # what belongs to the set is equal in all rows of a class
    own = [F.first(x).alias(x) for x in ("n_shingles", "bands", *ODD, *WHOLE)]
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *own).withColumn("id", F.monotonically_increasing_id())
    classes = scratch.table(classes, "classes")

    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct(F.xxhash64("id"), "id")).getField("id").alias("mid")).where("low < high")
    buckets = scratch.table(buckets, "buckets")
    hot = buckets.where(F.col("n") > hot_rows(BANDS * classes.count())).select("key")
    bucketed = scratch.table(split_join(members, buckets, ["key"], hot), "bucketed")
    stars = scratch.table(_ordered(bucketed.select("id", F.explode(F.array("low", "high", "mid")).alias("star")).distinct(), "id", "star"), "stars")
    tried = scratch.table(plausible(stars, classes, percent), "tried")
    scratch.drop("stars")
    links = scratch.table(confirmed(tried, classes, docs, percent), "links")

    # an id with several sets links their classes
    several = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("doc_id")
    of = full.select("doc_id", "d1", "d2").join(several, "doc_id", "left_semi").distinct().join(classes.select("d1", "d2", "id"), ["d1", "d2"])
    links = scratch.table(links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a < id").select("a", F.col("id").alias("b"))), "all-links")
    labels = connected(links, scratch, "first")

    # buckets of more classes than were all compared with each other, in which several components are left
    component = F.coalesce("component", "id")
    labelled = bucketed.where("n > 3").select("id", "key", "n").join(labels, "id", "left").select("id", "key", "n", component.alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("key").agg(F.max(F.struct("size", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    opened = scratch.table(split_join(labelled, main.select("key", "main"), ["key"], hot), "opened")
    if not opened.isEmpty():
        one = opened.join(classes.select("id", "n_shingles", *ODD, *WHOLE), "id").withColumn("chunks", F.ceil(F.col("n") / SALT))
        all_ = one.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        others = one.where("component <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        l, r = others.alias("l"), all_.alias("r")
        # between two that are both outside the main component, once
        across = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.main")) | (F.col("l.id") < F.col("r.id")))
        met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.chunk") == F.col("r.chunk")) & across & _plausible(percent))
        pairs = _ordered(met.select(F.col("l.id").alias("x"), F.col("r.id").alias("y")), "x", "y")
        more = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"), "more")
        labels = connected(links.unionByName(confirmed(more, classes, docs, percent)), scratch, "last")

    # the smallest id of each component, by class
    told = scratch.table(classes.select("id", "d1", "d2", "least").join(labels, "id", "left").withColumn("component", component), "told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = split_join(told, least, ["component"], hot_keys(told, ["component"])).select("d1", "d2", "component_id")
    rows = full.select("doc_id", "row", "n_shingles", "d1", "d2")
    out = scratch.table(split_join(rows, by_class, ["d1", "d2"], hot_keys(rows, ["d1", "d2"])).drop("d1", "d2"), "out")
    scratch.keep("sketches", "out")
    # an empty set links with nothing, but its id may have other rows
    bare = every.where("d1 IS NULL").select("doc_id", "row", "n_shingles")
    known = _also_bare(full, bare, out)
    return out.unionByName(bare.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")))


def _also_bare(full: DataFrame, bare: DataFrame, out: DataFrame) -> DataFrame:
    """doc_id and component_id of the ids of rows without words that rows with words have too."""
    ids = bare.where("doc_id IS NOT NULL").select("doc_id").distinct().join(full.select("doc_id"), "doc_id", "left_semi")
    return out.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are first (by doc_id) of their component."""
    copies = _components(docs, percent).where("NOT doc_id <=> component_id").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_key()).join(copies, "__row", "left_anti").select(*docs.columns)


COMPONENTS_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:least(i + 4, len(w))] AS g FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(doc_id, m) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) USING (doc_id)
"""
