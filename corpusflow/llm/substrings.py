"""Removal of bytes that lie in a string of 200 bytes which also starts elsewhere, by distributed prefix doubling.

Method: Spark sorts and counts rank pairs of positions at growing offsets (25, 50, 100, 175, 225 bytes), gives equal pairs
one rank, drops the unique ones after each offset, and stops past the threshold. Ranking every position of the corpus
would move many times the corpus, so positions are picked by content, which picks them alike wherever bytes are alike:

1. The anchor of a 200-byte window is its leftmost 25-byte string of smallest hash. Windows come in runs of one anchor
   (about 90). Equal windows have equal anchors at equal distances, so that an anchor whose rank, the hash of its 25
   bytes, is unique has no repeated window; Spark counts the ranks and drops these.
2. Runs that are equal as a whole would tie at every offset: their windows are repeated, and one of them goes on.
3. The positions of a run are the points of a grid of 25 bytes laid through its anchor. Rounds of doubling rank the
   strings of 50, 100 and 175 bytes at each point by the pair of ranks at the point and at the one further on.
   A window holds the 175 bytes at its first point, so that a point that is dropped by then has no repeated window.
   The 25 windows that share a first point lie within the 225 bytes from the point before on: where these are repeated,
   all of them are.
4. What is in between (windows near the end of a match) is ranked window by window, with one of each kind of run that
   it may be equal to.

All steps are aggregates and joins of rows: no task holds what shares a rank, nothing changes with size, and runs of very
frequent ranks are met by a broadcast of these. Bytes are
judged on the input, and matches never cross documents. Ranks on which bytes are removed have 128 bits of two
independent hashes at the length in question (whole runs: 96, besides the 64 of the anchor).

Defined cases: null and empty texts have no bytes; texts shorter than the threshold lose nothing; periodic texts repeat
within themselves; rows that repeat a document repeat all its bytes; very long texts are treated whole; an empty table
gives an empty result; other columns of the input are kept by ``remove`` (ones named removed or kept are replaced), and
internal names start with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, pieces, row_key, split_join
from .decontam import bounded
from .vec import BASE, mix, powers

LENGTH = 200
_TABLES = [mix(np.arange(a, a + 256, dtype=np.uint64) * np.uint64(BASE)) for a in (1000, 2000)]
KEY = "__key struct<x:long,y:int>"


def grid(length: int) -> tuple[int, int, int]:
    """Bytes between points, and how many such steps every window surely holds and the windows of one point lie in."""
    step = max(1, length // 8)
    return step, (length - step + 1) // step, -(-length // step) + 1


def _sums(buffer: np.ndarray, family: int = 0) -> np.ndarray:
    up, _ = powers(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_TABLES[family][buffer] * up[: len(buffer)], out=out[1:])
    return out


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """reduce() over each stretch of ``width``, by running values from both ends of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, fill, np.uint64)]).reshape(-1, width)
    ahead = reduce.accumulate(blocks, 1).ravel()
    back = reduce.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return reduce(back[:n], ahead[width - 1 : width - 1 + n])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and where each text begins (one more at the end)."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` entries of each row: the row and the number within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(buffer: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor: text, start in it, windows, anchor behind the start, its rank, and 64 and 32 bits of the run as a whole."""
    sizes, first = np.diff(offsets), grid(length)[0]
    n = len(buffer) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.int32)
    sums, width = _sums(buffer), length - first + 1
    at = np.arange(len(buffer) - first + 1)
    rank = _spans(sums, at, at + first)
    least = _sliding(rank, width, np.minimum, (1 << 64) - 1)
    inside = np.zeros(n + 1, bool)  # windows that don't cross texts
    cuts = np.zeros(n + 2, np.int64)
    full = np.flatnonzero(sizes >= length)
    cuts[offsets[full]] += 1
    np.subtract.at(cuts, offsets[full + 1] - length + 1, 1)
    inside[:] = np.cumsum(cuts[: n + 1]) > 0
    change = np.ones(n + 1, bool)
    change[1:n] = least[1:] != least[:-1]
    change[offsets[(offsets > 0) & (offsets < n)]] = True
    change[1:] |= inside[1:] != inside[:-1]
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    value = least[starts]
    # places that have the smallest hash of any window: several in a run of periodic text, of which each is the anchor up to itself
    spread = np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside[:n], least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    picked = np.flatnonzero(_sliding(spread, width, np.maximum, 0)[: len(rank)] == rank)
    names, name = np.unique(rank[picked], return_inverse=True)
    scale = len(buffer) + 1
    keyed = np.sort(name * scale + picked)
    own = np.searchsorted(names, value) * scale
    low, high = np.searchsorted(keyed, own + starts), np.searchsorted(keyed, own + ends - 1 + width)
    row, i = _within(high - low)
    anchor = keyed[low[row] + i] - own[row]
    begin = starts[row]
    again = np.flatnonzero(i > 0)
    begin[again] = np.maximum(begin[again], anchor[again - 1] + 1)
    end = np.minimum(ends[row], anchor + 1)
    some = begin < end
    begin, end, anchor, value = begin[some], end[some], anchor[some], value[row][some]
    text = np.searchsorted(offsets, begin, "right") - 1
    shape = mix((anchor - begin).astype(np.uint64))
    whole = _spans(sums, begin, end - 1 + length) ^ shape
    check = (_spans(_sums(buffer, 1), begin, end - 1 + length) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return text, begin - offsets[text], end - begin, anchor - begin, value, whole, check


def _listed(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """__key, text and ``own``, the rows (structs of ``columns``) of each text that has any; fewer than its bytes."""
    own = rows.groupBy("__key").agg(F.collect_list(F.struct(*columns)).alias("own"))
    return _narrowed(texts, rows.select("__key").distinct())[0].join(own, "__key").select("__key", "text", "own")


def _field(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(2).flatten().field(name).to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, valid: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(values.view(np.int64), mask=~valid))


def _points(open_: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """id, names (hashes of the bytes from each point to the next) and checks (a second hash of the bytes around each point's windows)."""
    step, _, wide = grid(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            buffer, offsets = _joined(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            start, n, anchor, rank = (_field(batch, x).astype(np.int64) for x in ("start", "n", "anchor", "rank"))
            high, low = anchor // step, (anchor - n + 1) // step
            origin = offsets[doc] + start + anchor - step * (high + 1)
            groups = high - low + 1
            row, i = _within(groups + wide - 1)
            at = origin[row] + step * i
            valid = (at >= offsets[doc[row]]) & (at + step <= offsets[doc[row] + 1])
            near = np.where(valid, at, 0)
            # points of different anchors, and of one at different distances, are told apart
            apart = mix(rank.view(np.uint64)[row] + mix((high[row] + 1 - i).astype(np.uint64)))
            names = mix(_spans(_sums(buffer), near, np.where(valid, near + step, near)) ^ apart)
            point, j = _within(groups)
            begin = origin[point] + step * j
            whole = (begin >= offsets[doc[point]]) & (begin + wide * step <= offsets[doc[point] + 1])
            begin = np.where(whole, begin, 0)
            checks = _spans(_sums(buffer, 1), begin, np.where(whole, begin + wide * step, begin))
            columns = [pa.array(_field(batch, "id")), _lists(names, valid, groups + wide - 1), _lists(checks, whole, groups)]
            yield pa.record_batch(columns, names=["id", "names", "checks"])

    return _listed(open_, texts, "id", "rank", "start", "n", "anchor").mapInArrow(cut, "id long, names array<long>, checks array<long>")


def _paired(points: DataFrame, ahead: int) -> DataFrame:
    """id, i, name: the pair of the ranks at each point and ``ahead`` points on, where both are left."""
    pair = F.transform("names", lambda x, i: F.when(x.isNotNull() & F.get("names", i + ahead).isNotNull(), F.xxhash64(x, F.get("names", i + ahead))))
    return points.select("id", F.posexplode(pair).alias("i", "name")).where("name IS NOT NULL")


def _doubled(points: DataFrame, ahead: int) -> DataFrame:
    """``points`` with the ranks of the pairs; unique ones are dropped."""
    pairs = _paired(points, ahead)
    again = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    # a run's points are at most 16
    kept = pairs.join(again, "name", "left_semi").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("i", "name"))).alias("m"))
    return kept.select("id", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.try_element_at("m", i)).alias("names"))


def _windows(groups: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """__key, start, done and two hashes of every single window of the groups (__key, low, high, done)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            buffer, offsets = _joined(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            low, high = _field(batch, "low").astype(np.int64), _field(batch, "high").astype(np.int64)
            row, i = _within(high - low + 1)
            start = low[row] + i
            at = start + offsets[doc[row]]
            hashes = [_spans(_sums(buffer, k), at, at + length).view(np.int64) for k in (0, 1)]
            yield pa.record_batch([batch.column(0).take(pa.array(doc[row])), pa.array(start, pa.int32()), pa.array(_field(batch, "done").astype(bool)[row]), *map(pa.array, hashes)], names=["__key", "start", "done", "h0", "h1"])

    return _listed(groups, texts, "low", "high", "done").mapInArrow(cut, f"{KEY}, start int, done boolean, h0 long, h1 long")


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of sorted stretches that overlap or touch."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.concatenate([reach[np.flatnonzero(new)[1:] - 1], reach[-1:]])


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", row_key())


def _narrowed(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with and without a key in ``keys``; ``keys`` is broadcast if it is small."""
    few = bounded(keys, keys.count(), 24)
    return docs.join(few, "__key", "left_semi"), docs.join(few, "__key", "left_anti")


def spans(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """__key (of doc_id and text), start and end of stretches of repeated bytes; they may overlap."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    texts = _key(docs).select("__key", "text")
    step, sure, wide = grid(length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            text, start, n, anchor, rank, whole, check = runs(*_joined(batch.column(1)), length)
            columns = [pa.array(x) for x in (rank.view(np.int64), whole.view(np.int64), check)]
            columns += [batch.column(0).take(pa.array(text)), *(pa.array(x, pa.int32()) for x in (start, n, anchor))]
            yield pa.record_batch(columns, names=["rank", "whole", "check", "__key", "start", "n", "anchor"])

    every = scratch.table(texts.mapInArrow(find, f"rank long, whole long, check int, {KEY}, start int, n int, anchor int"), "runs")
    again = scratch.table(every.groupBy("rank").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "ranks")
    often = F.col("count") > hot_rows(every.count())
    left = scratch.table(split_join(every, again.select("rank"), ["rank"], again.where(often).select("rank"), "left_semi"), "left")
    scratch.drop("runs")
    scratch.drop("ranks")
    alike = ["rank", "whole", "check"]
    classes = left.groupBy(alike).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("__key", "start", "n", "anchor")).alias("run"))
    classes = scratch.table(classes.select(*alike, "count", "run.*"), "classes")
    past = split_join(left, classes.where("count > 1").select(alike), alike, classes.where(often).select(alike), "left_semi").select("__key", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))
    shared = classes.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("rank")
    open_ = classes.join(shared, "rank", "left_semi").select(F.monotonically_increasing_id().alias("id"), "rank", "__key", "start", "n", "anchor", (F.col("count") > 1).alias("done"))
    open_ = scratch.table(open_, "open")

    points = scratch.table(_points(open_, texts, length), "points")
    names, span = points.select("id", "names"), 1
    while span < sure:
        ahead = min(span, sure - span)
        last, span = span, span + ahead
        names = scratch.table(_doubled(names, ahead), f"names-{span}")
        if last > 1:
            scratch.drop(f"names-{last}")
    # of each point with windows: their first and last, and the ranks of the bytes they surely hold and lie in
    around = F.when(F.get("names", F.col("i") - 1).isNotNull() & F.get("names", F.col("i") + (wide - sure - 1)).isNotNull(), F.xxhash64(F.get("names", F.col("i") - 1), F.get("names", F.col("i") + (wide - sure - 1))))
    rows = names.join(points.select("id", "checks"), "id").join(open_, "id").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("checks"))))
    rows = rows.withColumn("point", F.col("start") + F.col("anchor") - step * ((F.col("anchor") / step).cast("int") + 1 - F.col("i")))
    rows = rows.select("__key", "done", F.get("names", "i").alias("sure"), around.alias("wide"), F.get("checks", F.col("i") - 1).alias("check"), F.greatest("start", F.col("point") - (step - 1)).alias("low"), F.least(F.col("start") + F.col("n") - 1, "point").alias("high"))
    rows = scratch.table(rows.where("sure IS NOT NULL").withColumn("wide", F.when(F.col("check").isNotNull(), F.col("wide"))), "groups")
    twice = rows.where("wide IS NOT NULL").groupBy("wide", "check").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("wide", "check", F.lit(True).alias("twice"))
    told = rows.where("wide IS NOT NULL").join(twice, ["wide", "check"], "left")
    told = scratch.table(told.unionByName(rows.where("wide IS NULL").withColumn("twice", F.lit(None).cast("boolean"))), "told")
    decided = told.where("twice AND NOT done").select("__key", F.col("low").alias("start"), (F.col("high") + length).alias("end"))

    between = told.where("twice IS NULL AND NOT done").select("sure").distinct()
    members = told.join(between, "sure", "left_semi")
    one = members.where("twice").groupBy("sure", "wide", "check").agg(F.min(F.struct("__key", "low", "high")).alias("row")).select("row.*", F.lit(True).alias("done"))
    members = scratch.table(members.where("twice IS NULL").select("__key", "low", "high", "done").unionByName(one), "members")
    windows = scratch.table(_windows(members, texts, length), "windows")
    again = windows.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("h0", "h1")
    single = windows.where("NOT done").join(again, ["h0", "h1"], "left_semi").select("__key", "start", (F.col("start") + length).alias("end"))
    return past.unionByName(decided).unionByName(single)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``removed`` (start and end of each stretch, in bytes) and ``kept`` (the remaining bytes) for ``text``."""
    docs = docs.drop("removed", "kept")
    scratch = Scratch(docs.sparkSession, "substrings")
    found = scratch.table(spans(docs, length, scratch), "spans")
    scratch.keep("spans")
    # a document's stretches are fewer than its bytes
    listed = found.groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    with_, without = _narrowed(_key(docs), found.select("__key").distinct())
    columns = docs.columns
    at = columns.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at, 1 << 20):
            removed, kept = [], []
            for text, own in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(columns)).to_pylist()):
                start, end = _merge(np.array([x["start"] for x in own], np.int64), np.array([x["end"] for x in own], np.int64))
                edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(text)]]).reshape(-1, 2)
                kept.append(b"".join(text[a:b] for a, b in edges.tolist()))
                removed.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=[*columns, "removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", removed array<struct<start:int,end:int>>, kept binary"
    touched = with_.join(listed, "__key").select(*columns, "__spans").mapInArrow(drop, schema)
    whole = without.select(*columns, F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("removed"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("kept"))
    return touched.unionByName(whole)


def digests(docs: DataFrame) -> DataFrame:
    sizes = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return remove(docs.select("doc_id", "text")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), sizes.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


DIGESTS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5_number(substr(h, 2 * s + 1, {2 * LENGTH})) AS k FROM d, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS u(s)),
t AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, s, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS gap FROM t)),
x AS (SELECT r, run, min(s) AS a, max(s) + {LENGTH} AS b FROM g GROUP BY r, run),
y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM x),
z AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS parts, max(b) AS last FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""
