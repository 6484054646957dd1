"""Document quality from a linear-chain conditional random field over lines.

Method: every line is labelled good or bad by a linear-chain CRF whose features are properties of the line and of its
two neighbours (case, marks, digits, repetition, length). Forward-backward gives each line's marginal probability of
being good; the means of these weighted by line length aggregate into the document's quality.

Only documents are labelled. Training starts from lines with their document's label and then twice relabels the lines
of bad documents by the marginals (the worst stays bad), since such documents also hold good lines. It takes at most
``sample`` labelled rows of either label, chosen by a hash of the id, and of those as many, in the order of the hash, as
have ``sample_bytes`` of text, in chains of at most ``CHAIN`` lines. The score is the logistic function of the quality,
with the slope that fits the sample's labels (Platt 1999), shifted so that the cut with the fewest errors lies at ``CUT``.
Scoring takes whole texts of all rows.

Defined cases: null and empty texts count as one empty line; very long texts are one chain of all their lines; an empty
table gives an empty result; documents of one quality score alike, and cuts with equally few errors are settled in the
middle; repeated rows score alike, and of labelled rows that repeat an id the smallest text is learnt from; labels that
are null or in conflict are left out; without labels of both kinds every score is 0.5; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .toxicity import labelled
from .vec import Words

CHAIN = 64
#: What predicted asks of the score; the fit puts the best cut there.
CUT = 0.7

_KIND = np.full(256, 4, np.int8)  # 0 upper, 1 lower or beyond ASCII, 2 digit, 3 space, 4 mark
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58], _KIND[[32, *range(9, 14)]] = 0, 1, 1, 2, 3
#: Bounds of the bins of each property.
_BINS = (
    np.array([0.02, 0.1, 0.3, 0.6]),  # share of capitals among letters
    np.array([0.01, 0.04, 0.08, 0.15, 0.3]),  # share of marks
    np.array([0.005, 0.02, 0.06, 0.15]),  # share of marks that follow an equal one
    np.array([0.01, 0.05, 0.2]),  # share of digits
    np.array([0.02, 0.1, 0.3, 0.6]),  # share of words that repeat the one before
    np.array([0.02, 0.1, 0.25]),  # share of words without letter or digit
    np.array([2.5, 4, 6, 9]),  # bytes a word
    np.array([1, 4, 12, 40]),  # words
    np.array([0.5]),  # ends a sentence
)
_FIRST = np.cumsum([0, *(len(b) + 1 for b in _BINS)])
OWN = int(_FIRST[-1])
FEATURES = 3 * OWN + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line's properties (one column each), its length in bytes, and where each text's lines begin."""
    words = Words(texts)
    buffer, n = words.buffer, len(words.buffer)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(starts, words.offsets)
    size = (ends - starts).astype(float)
    kind = _KIND[buffer]

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return (total[ends] - total[starts]).astype(float)

    upper, lower, digit, mark = (count(kind == k) for k in (0, 1, 2, 4))
    doubled = np.zeros(n, bool)
    doubled[1:] = (kind[1:] == 4) & (buffer[1:] == buffer[:-1])
    same = np.zeros(n, bool)
    again = (words.hashes[1:] == words.hashes[:-1]) & (words.ends[1:] - words.starts[1:] == words.ends[:-1] - words.starts[:-1])
    same[words.starts[1:][again]] = True
    begun = np.zeros(n, bool)
    begun[words.starts] = True
    plain = np.zeros(n + 1, np.int64)
    np.cumsum(kind <= 2, out=plain[1:])
    bare = np.zeros(n, bool)
    bare[words.starts[plain[words.ends] == plain[words.starts]]] = True
    total = np.maximum(count(begun), 1)
    last = buffer[np.maximum(ends - 1, 0)]
    values = (
        upper / np.maximum(upper + lower, 1),
        mark / np.maximum(size, 1),
        count(doubled) / np.maximum(size, 1),
        digit / np.maximum(size, 1),
        count(same) / total,
        count(bare) / total,
        size / total,
        count(begun),
        np.isin(last, [33, 46, 63]) & (size > 0),
    )
    return np.stack([np.searchsorted(b, v, "right") + f for b, v, f in zip(_BINS, values, _FIRST)], 1), size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own, those of the line before and of the line after, or that there is none."""
    before, after = np.full_like(own, 3 * OWN), np.full_like(own, 3 * OWN + 1)
    before[1:], after[:-1] = own[:-1] + OWN, own[1:] + 2 * OWN
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = 3 * OWN
    after[np.append(starts[1:], len(own)) - 1] = 3 * OWN + 1
    return np.concatenate([own, before, after], 1)


def marginals(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected moves between labels, by forward-backward over all chains at once."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than each step
    local, step = np.exp(emit - emit.max(1, keepdims=True)), np.exp(move)
    forward, backward = np.zeros_like(emit), np.ones_like(emit)
    for t in range(steps):
        at = begin[: active[t]] + t
        a = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
        forward[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = (local[at + 1] * backward[at + 1]) @ step.T
        both = forward[at][:, :, None] * step * (local[at + 1] * backward[at + 1])[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        backward[at] = b / b.sum(1, keepdims=True)
    p = forward * backward
    return p[:, 1] / np.maximum(p.sum(1), 1e-300), pairs


def emissions(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    good = w[features].sum(1)
    return np.stack([np.zeros_like(good), good], 1)


def fit_crf(features: np.ndarray, first: np.ndarray, good: np.ndarray, w: np.ndarray, move: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) of the conditional likelihood of the line labels."""
    inner = np.ones(len(good), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(good[at].astype(int) * 2 + good[np.minimum(at + 1, len(good) - 1)], minlength=4).reshape(2, 2)
    flat, width = features.ravel(), features.shape[1]
    held = np.bincount(flat, np.repeat(good.astype(float), width), FEATURES)
    x, m, v = np.concatenate([w, move.ravel()]), 0.0, 0.0
    for i in range(1, steps + 1):
        p, pairs = marginals(emissions(features, x[:FEATURES]), x[FEATURES:].reshape(2, 2), first)
        grad = np.concatenate([held - np.bincount(flat, np.repeat(p, width), FEATURES), (seen - pairs).ravel()]) / len(good) - 1e-4 * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return x[:FEATURES], x[FEATURES:].reshape(2, 2)


def means(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each text's line probabilities, weighted by length."""
    weight = np.concatenate([[0], np.cumsum(size + 1)])
    total = np.concatenate([[0], np.cumsum(p * (size + 1))])
    return (total[first[1:]] - total[first[:-1]]) / (weight[first[1:]] - weight[first[:-1]])


def slope(value: np.ndarray, good: np.ndarray, rounds: int = 50) -> float:
    """The slope of a logistic regression of the labels on the values, by Newton's method with Platt's smoothed labels."""
    n, m = int(good.sum()), int((~good).sum())
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    x, w = np.stack([value - value.mean(), np.ones(len(value))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(w[0], 1.0))


def train(texts: list[str | None], good: np.ndarray) -> dict:
    if not len(texts) or good.all() or not good.any():
        return {"w": [0.0] * FEATURES, "move": [0.0] * 4, "slope": 0.0, "cut": 0.5, "prior": 0.5}
    parts = [line_features([(x or "").encode() for x in texts[i : i + 100]]) for i in range(0, len(texts), 100)]  # few at a time, for memory
    own, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    features = with_neighbours(own, first)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    within = np.arange(len(doc)) - first[doc]
    chains = np.append(np.flatnonzero(within % CHAIN == 0), len(doc))
    lines, w, move = good[doc], np.zeros(FEATURES), np.zeros((2, 2))
    for round_ in range(3):
        w, move = fit_crf(features, chains, lines, w, move, 60)
        p, _ = marginals(emissions(features, w), move, first)
        worst = np.minimum.reduceat(p, first[:-1])
        lines = good[doc] | ((p > 0.5) & (p > worst[doc]))
    value = means(p, size, first)
    # the cut with the fewest errors, in the middle of the gap around it
    order = np.argsort(value, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(np.where(good[order], 1, -1))])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    low, high = value[order[max(k - 1, 0)]], value[order[min(k, len(order) - 1)]]
    return {"w": w.tolist(), "move": move.ravel().tolist(), "slope": slope(value, good), "cut": float((low + high) / 2), "prior": CUT}


def qualities(texts: list[bytes], model: dict) -> np.ndarray:
    own, size, first = line_features(texts)
    p, _ = marginals(emissions(with_neighbours(own, first), np.array(model["w"])), np.array(model["move"]).reshape(2, 2), first)
    z = model["slope"] * (means(p, size, first) - model["cut"]) + np.log(model["prior"] / (1 - model["prior"]))
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = 2500, sample_bytes: int = 64 << 20) -> dict:
    """The model; ``keep`` says which labels may be learnt from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values(["doc_id"], kind="stable")
        yield pd.DataFrame({"model": [json.dumps(train([x if isinstance(x, str) else None for x in rows["text"]], rows["label"].to_numpy() == 1))]})

    found = labelled(docs, labels, "quality", keep, sample, sample_bytes).repartition(1).mapInPandas(run, "model string").first()
    return json.loads(found[0]) if found else train([], np.zeros(0, bool))


def score(docs: DataFrame, model: dict, at_least: float = CUT) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(qualities(texts, model))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= at_least).cast("int"))
