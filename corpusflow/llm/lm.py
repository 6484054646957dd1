"""Language-model scores by a weighted backoff automaton.

Model: word trigrams smoothed as a hierarchical Dirichlet model (MacKay and Peto 1995) over the unigrams of the base
score, all from all training documents: P(w|uv) = (c(uvw) + b3 P(w|v)) / (c(uv) + b3), P(w|v) likewise with b2.

Automaton: its states are the empty history, each word and the start of a text, and each pair of neighbours that training
holds. An arc of a state reads a word that training has after the state's words, with the smoothed probability as its
weight, and leads to the state of the last two words. A failure arc leads to the state without the first word, and its
weight is what smoothing leaves for it, b / (c + b). The empty history reads every word. A text is traversed once from
left to right: the state is carried, failure arcs are followed until an arc reads the token, and weights add up.

The counts grow with the corpus and are never held in one place. Scan tasks pack their documents into blocks of at most
about BLOCK_BYTES of text. A block asks for the counts of its distinct words, pairs and triples and brings its own
training counts along, in sorted arrays of hashes, one for each of its parts of the hashes' range; a part adds up what
all blocks brought and answers each in its order; with the answers, a block builds the states and arcs that its texts
can reach and traverses its documents, many stretches of them at a time. Parts are at most PARTS, so that a block sends
a bounded number of rows and rows grow in proportion to the corpus. A frequent word costs one entry for each block.
Words are known by 96 bits of hash, pairs and triples by 56.

Defined cases: null, empty and blank texts have just the end token; A-Z count as a-z; without training documents all
counts are 0; a very long text is in a block of its own, and its traversal is dealt into stretches; repeated rows are
scored (and counted) each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, release, text_bytes
from .vec import BASE, Words, mix, prefix_sums, span_hashes

#: Bytes of text in a block.
BLOCK_BYTES = 10 << 20
#: Most parts of the hashes' range, about a quarter of a full block's keys.
PARTS = 1 << 18
#: Prior weights of the pair's and the triple's distribution, in tokens.
PAIR, TRIPLE = 256.0, 8.0
#: Tokens that are traversed as one stretch.
STRETCH = 128
#: Bits that the hashes of pairs and triples are shortened by.
SHORT = np.uint64(8)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of the first of each, and of each key its number among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    index = np.empty(len(keys), np.int32)
    index[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], index


class Block:
    """Tokens of some documents, and their distinct words, pairs and triples in the order of their hashes.

    ``word``, ``pair`` and ``triple`` have the number of each position's own; a text's first token has no triple (-1).
    """

    def __init__(self, texts: list[bytes]):
        hashes, sizes, known, checks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.array([END])], [np.zeros(1, np.uint32)]
        at, limit = 0, 2 << 20
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) <= limit):
                total += len(texts[end])
                end += 1
            words = Words(texts[at:end])
            counts = np.diff(words.first)
            out = np.full(len(words.hashes) + len(counts), END, np.uint64)
            spot = np.ones(len(out), bool)
            spot[np.cumsum(counts + 1) - 1] = False
            out[spot] = words.hashes
            hashes.append(out)
            sizes.append(counts + 1)
            own, first = np.unique(words.hashes, return_index=True)
            known.append(own)
            checks.append((span_hashes(prefix_sums(words.buffer, 1), words.starts[first], words.ends[first]) >> np.uint64(32)).astype(np.uint32))
            at = end
        tokens, self.sizes = np.concatenate(hashes), np.concatenate(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words, _, self.word = _unique(tokens)
        names, at = np.unique(np.concatenate(known), return_index=True)
        self.checks = np.concatenate(checks)[at][np.searchsorted(names, self.words)]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = START
        pair = mix(before * np.uint64(BASE) + tokens)
        self.pairs, place, self.pair = _unique(pair >> SHORT)
        # the start of a text is a word behind all others
        left = np.empty(len(tokens), np.int32)
        left[1:] = self.word[:-1]
        left[self.first] = len(self.words)
        self.left, self.right = left[place], self.word[place]
        inner = np.ones(len(tokens), bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        self.triples, place, triple = _unique(mix(pair[at - 1] * np.uint64(BASE) + tokens[at]) >> SHORT)
        self.triple = np.full(len(tokens), -1, np.int32)
        self.triple[at] = triple
        place = at[place]
        #: Of each triple: its first two words as a pair, its last two, and its last.
        self.begins, self.ends, self.last = self.pair[place - 1], self.pair[place], self.word[place]

    def requests(self, block: int, training: np.ndarray, parts: int) -> pa.Table:
        """A row for each kind and part: keys, checks, and the counts in this block's training documents."""
        weight = np.repeat(training, self.sizes)
        rows = []
        for kind, (keys, index, checks) in enumerate(((self.words, self.word, self.checks), (self.pairs, self.pair, None), (self.triples, self.triple, None))):
            count = np.bincount(index[weight & (index >= 0)], minlength=len(keys)).astype(np.uint32)
            part = ((keys >> (np.uint64(32) - (SHORT if kind else np.uint64(0)))) * np.uint64(parts)) >> np.uint64(32)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                rows.append((kind, int(part[a]), block, _packed_keys(keys[a:b]), checks[a:b].tobytes() if checks is not None else b"", _packed(count[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "part", "block", "keys", "checks", "counts"])


def _packed(values: np.ndarray) -> bytes:
    """All first bytes first, then all second ones: of small numbers the upper ones are 0."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.copy()
    return np.uint32(len(values)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n, size = int(np.frombuffer(data[:4], np.uint32)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(size, -1).T.copy().view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "u8"), dtype=np.uint64)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All blocks' requests of one part: the total of each distinct key, the number of each requested one, sizes of the requests."""
    counts = [_unpacked(x, "u4") for x in table.column("counts").to_pylist()]
    keys = np.concatenate([_unpacked_keys(x) for x in table.column("keys").to_pylist()])
    checks = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("checks").to_pylist()])
    order = np.lexsort((checks, keys)) if len(checks) else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    if len(checks):
        new[1:] |= checks[order][1:] != checks[order][:-1]
    name = np.empty(len(keys), np.int64)
    name[order] = np.cumsum(new) - 1
    return np.bincount(name, np.concatenate(counts).astype(float)), name, [len(x) for x in counts]


def answers(table: pa.Table) -> pa.Table:
    total, name, sizes = _summed(table)
    blocks, kind, part = table.column("block").to_pylist(), table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    ends = np.cumsum([0, *sizes])
    rows = [_packed(total[name[a:b]].astype(np.uint64)) for a, b in zip(ends[:-1], ends[1:])]
    n = len(rows)
    release()
    return pa.table([pa.array(blocks, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(rows, pa.binary())], names=["block", "kind", "part", "counts"])


def totals(table: pa.Table) -> pa.Table:
    """Training tokens and distinct words of a part, 0 for pairs and triples."""
    if table.column("kind")[0].as_py():
        return pa.table({"n": pa.array([0], pa.int64()), "v": pa.array([0], pa.int64())})
    total, _, _ = _summed(table)
    return pa.table({"n": pa.array([int(total.sum())], pa.int64()), "v": pa.array([int((total > 0).sum())], pa.int64())})


class Automaton:
    """States and arcs that a block's texts can reach; weights are log10.

    State 0 is the empty history, 1 + w a word's (w = number of words: the start's), and then one for each pair.
    ``fail`` and ``fail_weight`` are the failure arcs; ``arcs`` are numbered state * words + word, in order, with
    ``weight`` and ``target``; state 0 has ``base`` and ``first`` for all words.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, pair: float = PAIR, triple: float = TRIPLE):
        self.block, self.known, size = block, words > 0, len(words)
        unigram = (words + 1) / (n + v + 1)
        self.base, self.first = np.log10(unigram), np.where(self.known, 1 + np.arange(size), 0)
        ends = words[block.words == END]
        # how often training goes on after a state: the start does so in each document
        context = np.concatenate([words, ends if len(ends) else [0.0]])
        self.start = 1 + size if context[-1] > 0 else 0
        self.fail = np.concatenate([np.zeros(size + 2, np.int64), 1 + block.right.astype(np.int64)])
        self.fail_weight = np.concatenate([[0.0], np.log10(pair / (context + pair)), np.log10(triple / (pairs + triple))])
        two = (pairs + pair * unigram[block.right]) / (context[block.left] + pair)
        three = (triples + triple * two[block.ends]) / (pairs[block.begins] + triple)
        two_at, three_at = np.flatnonzero(pairs > 0), np.flatnonzero(triples > 0)
        arcs = np.concatenate([(1 + block.left[two_at].astype(np.int64)) * size + block.right[two_at], (size + 2 + block.begins[three_at].astype(np.int64)) * size + block.last[three_at]])
        order = np.argsort(arcs, kind="stable")
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([two[two_at], three[three_at]]))[order]
        self.target = (size + 2 + np.concatenate([two_at, block.ends[three_at]]))[order]

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of reading a word in each state, failure arcs included, and the states after."""
        total, state, size = np.zeros(len(state)), state.copy(), len(self.base)
        todo = np.flatnonzero(state)
        done = state == 0
        total[done], state[done] = self.base[word[done]], self.first[word[done]]
        while len(todo):
            key = state[todo] * size + word[todo]
            at = np.searchsorted(self.arcs, key)
            hit = (at < len(self.arcs)) & (self.arcs[np.minimum(at, len(self.arcs) - 1)] == key) if len(self.arcs) else np.zeros(len(todo), bool)
            to, at = todo[hit], at[hit]
            total[to] += self.weight[at]
            state[to] = self.target[at]
            todo = todo[~hit]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
            empty = state[todo] == 0
            to = todo[empty]
            total[to] += self.base[word[to]]
            state[to] = self.first[word[to]]
            todo = todo[~empty]
        return total, state

    def traverse(self) -> tuple[np.ndarray, ...]:
        """By document: tokens, known tokens, base score, score.

        A stretch that begins within a text begins in the state that its two words before lead to from the empty
        history: states know two words, so that it is the one the traversal of the whole text is in.
        """
        block, docs = self.block, len(self.block.sizes)
        pieces_ = -(-block.sizes // STRETCH)
        doc = np.repeat(np.arange(docs), pieces_)
        begin = block.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces_) - pieces_, pieces_)) * STRETCH
        length = np.minimum(STRETCH, block.first[doc] + block.sizes[doc] - begin)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], begin[order], length[order]
        state, inside = np.full(len(doc), self.start, np.int64), np.flatnonzero(begin > block.first[doc])
        warm = np.zeros(len(inside), np.int64)
        for back in (2, 1):
            warm = self.read(warm, block.word[begin[inside] - back])[1]
        state[inside] = warm
        score = np.zeros(len(doc))
        for step in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -step, "left"))
            weight, state[:active] = self.read(state[:active], block.word[begin[:active] + step])
            score[:active] += weight
        of = np.repeat(np.arange(docs), block.sizes)
        known = np.bincount(of, self.known[block.word], docs).astype(np.int64)
        return block.sizes, known, np.bincount(of, self.base[block.word], docs), np.bincount(doc, score, docs)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (doc_id, training, text) packed into rows of about BLOCK_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    for batch in pieces(batches, 2, 1 << 20):
        if held and size + batch.nbytes > BLOCK_BYTES:
            yield row()
            held, size, number = [], 0, number + 1
        held.append(batch)
        size += batch.nbytes
    if held:
        yield row()
    release()


def _rows(table: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(table.column("payload")[0].as_py()).read_all()


def _texts(rows: pa.Table) -> list[bytes]:
    return [x or b"" for x in rows.column(2).cast(pa.binary()).to_pylist()]


def score(docs: DataFrame, training: Column, pair: float = PAIR, triple: float = TRIPLE) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of every row; learns where ``training`` holds."""
    blocks = max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    parts = min(2 * blocks, PARTS)
    given = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), "text")
    dealt = given.mapInArrow(_blocks, "block long, payload binary").repartition(2 * blocks, "block")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        rows = _rows(table)
        out = Block(_texts(rows)).requests(key[0].as_py(), rows.column(1).to_numpy(), parts)
        release()
        return out

    requests = dealt.groupBy("block").applyInArrow(ask, "kind int, part int, block long, keys binary, checks binary, counts binary").repartition(parts, "kind", "part")
    # no filter here: the shuffled requests are used by both then
    known = requests.groupBy("kind", "part").applyInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    answered = requests.groupBy("kind", "part").applyInArrow(answers, "block long, kind int, part int, counts binary")

    kind = docs.schema["doc_id"].dataType.simpleString()

    def traverse(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, right = _rows(left), right.sort_by([("kind", "ascending"), ("part", "ascending")])
        got: list[list[np.ndarray]] = [[], [], []]
        for k, counts in zip(right.column("kind").to_pylist(), right.column("counts").to_pylist()):
            got[k].append(_unpacked(counts, "u8").astype(float))
        n, v = left.column("n")[0].as_py(), left.column("v")[0].as_py()
        counts = [np.concatenate(x) if x else np.zeros(0) for x in got]
        tokens, seen, base, total = Automaton(Block(_texts(rows)), *counts, n, v, pair, triple).traverse()
        release()
        out = [rows.column(0), rows.column(1), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array([n] * rows.num_rows, pa.int64()), pa.array(base), pa.array(total)]
        return pa.table(out, names=["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    told = dealt.crossJoin(F.broadcast(known))  # one row
    schema = f"doc_id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(traverse, schema)


#: crc32 of doc_id as text: the table of its bytes by the rule of its polynomial, then one step for each byte.
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""
#: The smoothed probabilities by their definition; the token before the first is '<', the end is '>' (no word is: both are told apart by their kind).
SCORE_SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT r, doc_id, crc % 7 = 2 AS held_out, list_concat([' <'], w, [' >']) AS w FROM d JOIN crc USING (doc_id)),
t AS (SELECT r, held_out, w[i] AS x, w[i - 1] AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM l, unnest(range(2, len(w) + 1)) AS u(i)),
n1 AS (SELECT x, count(*) AS c1 FROM t WHERE NOT held_out GROUP BY x),
n2 AS (SELECT b, x, count(*) AS c2 FROM t WHERE NOT held_out GROUP BY b, x),
n3 AS (SELECT a, b, x, count(*) AS c3 FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, x),
h1 AS (SELECT b, count(*) AS h1 FROM t WHERE NOT held_out GROUP BY b),
h2 AS (SELECT a, b, count(*) AS h2 FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b),
s AS (SELECT coalesce(sum(c1), 0) AS n, count(*) AS v FROM n1),
p1 AS (SELECT t.*, n, coalesce(c1, 0) AS c1, (coalesce(c1, 0) + 1)::DOUBLE / (n + v + 1) AS p1 FROM t LEFT JOIN n1 USING (x), s),
p2 AS (SELECT p1.*, (coalesce(c2, 0) + {PAIR} * p1) / (coalesce(h1, 0) + {PAIR}) AS p2 FROM p1 LEFT JOIN n2 USING (b, x) LEFT JOIN h1 USING (b)),
p3 AS (SELECT p2.*, CASE WHEN p2.a IS NULL THEN p2 ELSE (coalesce(c3, 0) + {TRIPLE} * p2) / (coalesce(h2, 0) + {TRIPLE}) END AS p3 FROM p2 LEFT JOIN n3 USING (a, b, x) LEFT JOIN h2 USING (a, b)),
f AS (SELECT r, count(*) AS n_tokens, CAST(count_if(c1 > 0) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10(p1)) AS base_score, sum(log10(p3)) AS score FROM p3 GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM f JOIN l USING (r)
"""
