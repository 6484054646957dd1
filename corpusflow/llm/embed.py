"""Near-duplicate vectors by spherical k-means cells.

Method: spherical k-means, fitted on a bounded sample, assigns every vector to the cell of its nearest centroid, its
home, and lets it look into its ``PROBES`` next cells. Cells are in proportion to the vectors, CELL of them each, up to
CELLS cells; beyond ONE_LEVEL cells, centroids are fitted and searched in two levels, the nearest BEAM upper cells first.
Within a cell, blocks of cosine products in double precision compare all that is there with the vectors at home there;
only products of at least the threshold are links. The components of the links are the groups of copies, and the
smallest id represents each.

Equal vectors are one class with a weight and a number of its own, so that many copies of one vector cost one. A cell is
dealt into blocks of at most about BLOCK vectors at home and CHUNK that look in, so that a task row's size does not grow
with a cell; a block reports each vector's number of links and the smallest number of its part, never the pairs.

Sampling only places the cells: every vector is indexed, and every vector looks for all its links. Links between
vectors of which neither looks into the other's home are missed; the README has the measured recall.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; a shorter
vector is filled up with zeros; rows that repeat an id are vectors of their own, which count as others, and their id is
one node; rows whose id is null are compared like all others; an empty table gives an empty result; labels and other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, split_join
from .graph import connected

THRESHOLD = 0.9
PROBES = 8
#: Vectors for each cell, most cells (a model of 34 MB at 64 dimensions), and sampled vectors for each of them.
CELL, CELLS, SAMPLE = 160, 1 << 16, 8
#: Cells from which there are two levels, and how many upper cells a vector searches then.
ONE_LEVEL, BEAM = 1024, 24
BLOCK, CHUNK = 1024, 4096


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), size))
    if (lengths == size).all():
        out[:] = values.reshape(len(column), size)
    else:
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    out /= np.abs(out).max(1, keepdims=True, initial=1e-300)  # against overflow of squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means: assignment by cosine, means scaled to unit length."""
    if not len(sample):
        return sample
    pick = np.random.default_rng(seed).permutation(len(sample))[:k]
    out = sample[pick].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 4096] @ out.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(out)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), out)
    return out


class Cells:
    """Centroids in one or two levels: ``top``, and for each of these the numbers of its cells, which follow each other."""

    def __init__(self, sample: np.ndarray, k: int):
        if k <= ONE_LEVEL:
            self.top, self.first, self.all = None, None, centroids(sample, k)
            return
        top = centroids(sample, math.isqrt(k))
        home = np.concatenate([(sample[i : i + 4096] @ top.T).argmax(1) for i in range(0, len(sample), 4096)])
        parts = [centroids(sample[home == t], max(1, round(k * (home == t).mean()))) for t in range(len(top))]
        kept = [t for t, x in enumerate(parts) if len(x)]
        self.top, self.all = top[kept], np.concatenate([parts[t] for t in kept])
        self.first = np.cumsum([0, *(len(parts[t]) for t in kept)])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, the nearest first; -1 where fewer were searched."""
        if self.top is None:
            return np.argsort(-(x @ self.all.T), axis=1, kind="stable")[:, :n].astype(np.int32)
        beam = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :BEAM]
        found, score = np.full((len(x), beam.shape[1], n), -1, np.int32), np.full((len(x), beam.shape[1], n), -2.0)
        for t in np.unique(beam):
            row, place = np.nonzero(beam == t)
            near = x[row] @ self.all[self.first[t] : self.first[t + 1]].T
            best = np.argsort(-near, axis=1, kind="stable")[:, :n]
            found[row, place, : best.shape[1]] = best + self.first[t]
            score[row, place, : best.shape[1]] = np.take_along_axis(near, best, 1)
        order = np.argsort(-score.reshape(len(x), -1), axis=1, kind="stable")[:, :n]
        return np.take_along_axis(found.reshape(len(x), -1), order, 1)


def block_links(c: pd.DataFrame, b: pd.DataFrame, cell: int, size: int, threshold: float) -> pd.DataFrame:
    """Links between vectors that are or look in here (c) and a block of those at home here (b): id, links, root."""
    left, right = matrix(pa.array(c["vector"]), size), matrix(pa.array(b["vector"]), size)
    met = left @ right.T >= threshold
    ids, own = c["class"].to_numpy(), b["class"].to_numpy()
    met &= ids[:, None] != own[None, :]
    i, j = np.nonzero(met)
    home, weight, other = c["home"].to_numpy(), c["weight"].to_numpy(), b["weight"].to_numpy()
    probes = np.stack(b["probes"].to_numpy()) if len(b) else np.zeros((0, 1))
    # if j looks into i's home too, that cell counts the link for j; at home together, the other direction does
    back = (home[i] != cell) & ~(probes[j] == home[i][:, None]).any(1)
    counts_c = np.bincount(i, other[j], len(c)).astype(np.int64)
    counts_b = np.bincount(j[back], weight[i[back]], len(b)).astype(np.int64)
    # components within the block, by the smallest id spread until nothing changes
    label, place = np.concatenate([ids, own]), np.concatenate([i, j + len(c)])
    far = np.concatenate([j + len(c), i])
    while len(i):
        new = label.copy()
        np.minimum.at(new, place, label[far])
        if (new == label).all():
            break
        label = new
    touched = np.unique(place)
    return pd.DataFrame({"id": np.concatenate([ids, own])[touched], "links": np.concatenate([counts_c, counts_b])[touched], "root": label[touched]})


def components(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    value = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", value.alias("vector")).withColumn("valid", F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    valid, bare = rows.where("valid").select("vec_id", "vector"), rows.where("NOT valid").select("vec_id")
    alone = bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = valid.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("class", F.monotonically_increasing_id())
    classes = scratch.table(classes, "classes")
    n, size = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return alone
    k = min(CELLS, -(-n // CELL))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("order")
        yield pa.record_batch([pa.array([pickle.dumps(Cells(matrix(table.column("vector"), size), k))])], names=["cells"])

    # at most CELLS * SAMPLE vectors by a hash of theirs
    sample = classes.select(F.xxhash64("vector").alias("order"), "vector").orderBy("order").limit(k * SAMPLE).repartition(1)
    cells = pickle.loads(sample.mapInArrow(fit, "cells binary").first()[0])
    model, probes = spark.sparkContext.broadcast(cells), min(probes, len(cells.all) - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                near = model.value.nearest(matrix(batch.column(2), size), probes + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probes + 1), pa.int32()), pa.array(near.ravel()))
                yield pa.record_batch([*batch.columns, lists], names=["class", "weight", "vector", "near"])

    placed = scratch.table(classes.select("class", "weight", "vector").mapInArrow(assign, "class long, weight long, vector array<double>, near array<int>"), "placed")
    looks = placed.select("class", "weight", F.posexplode("near").alias("order", "cell"))
    # a row for each cell, at most CELLS
    sizes = looks.groupBy("cell").agg(F.count_if(F.col("order") == 0).alias("own"), F.count(F.lit(1)).alias("all")).where("own > 0 AND cell >= 0")
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("own") / BLOCK).alias("blocks"), F.ceil(F.col("all") / CHUNK).alias("chunks")))
    base = placed.select("class", "weight", "vector", F.element_at("near", 1).alias("home"), F.col("near").alias("probes"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n))
    at_home = base.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("block", deal("blocks", 1)).withColumn("chunk", to("chunks")).withColumn("own", F.lit(True))
    look_in = base.withColumn("cell", F.explode("probes")).join(sizes, "cell").withColumn("chunk", deal("chunks", 2)).withColumn("block", to("blocks")).withColumn("own", F.lit(False))
    columns = ["cell", "block", "chunk", "own", "class", "weight", "vector", "home", "probes"]

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return block_links(frame[~frame["own"]], frame[frame["own"]], int(key[0]), size, threshold)

    parts = at_home.select(columns).unionByName(look_in.select(columns)).groupBy("cell", "block", "chunk").applyInPandas(compare, "id long, links long, root long")
    parts = scratch.table(parts, "parts")
    links = parts.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    edges = parts.select(F.col("id").alias("a"), F.col("root").alias("b"))
    # an id with several vectors is one node
    named = valid.where("vec_id IS NOT NULL").select("vec_id", F.xxhash64("vector").alias("h"))
    several = named.groupBy("vec_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("vec_id")
    of = valid.join(several, "vec_id", "left_semi").distinct().join(classes.select("vector", "class"), "vector").select("vec_id", "class")
    same = of.join(of.groupBy("vec_id").agg(F.min("class").alias("b")), "vec_id").select(F.col("class").alias("a"), "b")
    labels = connected(edges.unionByName(same), scratch).withColumnRenamed("id", "class")
    told = classes.join(links, "class", "left").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    told = scratch.table(told.select("vector", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    known = split_join(told, least, ["component"], hot_keys(told, ["component"])).select("vector", "n_links", "component_id")
    out = scratch.table(split_join(valid, known, ["vector"], hot_keys(valid, ["vector"])).select("vec_id", "n_links", "component_id"), "out")
    scratch.keep("out")
    joined = bare.join(out.join(bare.distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("component_id")), "vec_id", "left")
    return out.unionByName(joined.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


COMPONENTS_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
r(vec_id, m) AS (SELECT x, y FROM l UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.m = l.x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x), c AS (SELECT vec_id, min(m) AS m FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
