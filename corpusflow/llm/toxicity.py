"""Toxicity by weak supervision.

Method: many voters look at a document: lexicons and patterns. The lexicons are a seed of common insults, and what is
overrepresented in the labelled rows: words, word beginnings, and beginnings that several words of a document have; one
lexicon for each of these kinds and each band of log-odds, so that entries that vote together are evidence of one sort and
strength. The patterns are shouting, runs of marks, address in the second person and masked words. A generative model of
the votes, fitted by expectation maximization without labels, estimates each voter's accuracy and the strongest
correlations between voters (a tree of conditional dependences: a word's lexicon and that of its beginning, for one). Its
posterior labels train a linear classifier on entries, lexicons and pattern densities, and that scores every document.

Training takes at most ``sample`` labelled rows of either label, chosen by a hash of the id, and of those as many, in the
order of the hash, as have ``sample_bytes`` of text. Of rows whose word sequences are alike (MinHash estimate of at least
``alike`` on three-word shingles) the first one counts, since words that only copies repeat are no evidence. A lexicon has
at most ``ENTRIES`` entries, the strongest. Scoring takes whole texts of all rows. Labels choose the lexicons; scores see
the text alone.

Defined cases: null and empty texts are scored from the model's intercept; very long texts are scored whole; without any
labelled toxic row the seed lexicon alone votes; an empty table gives an empty result; entries of one strength are taken
in the order of their names; repeated rows score alike, and of labelled rows that repeat an id the smallest text is learnt
from; labels that are null or in conflict are left out; other columns, whatever their names, are ignored by ``score`` and
kept by ``reject``.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, release
from .vec import Words, mix, shingles

#: A seed of common insults.
SEED = ["idiot", "idiots", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting"]
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: Bounds of the bands of log-odds.
BANDS = (3.5, 5.0)
#: The seed, and a lexicon for each kind of entry and band.
GROUPS = 1 + 3 * (len(BANDS) + 1)
PATTERNS = {
    "shouting": re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{2,}){3,}"),
    "marks": re.compile(r"[!?]{2,}"),
    "you": re.compile(r"\byou(?:'re| are)?\b", re.I),
    "masked": re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]+\b", re.I),
}
#: Most entries of all lexicons together.
ENTRIES = 4000
#: MinHash samples of a labelled row, and how many make a band: rows alike by 0.8 share none with a probability of 2e-4.
SAMPLES, BAND = 64, 4


def entries(token: str) -> list[str]:
    return [token, *beginnings(token)]


def beginnings(token: str) -> list[str]:
    return [f"{token[:n]}-" for n in PREFIXES if len(token) >= n]


def several(own: set[str]) -> Iterator[str]:
    """Beginnings that more than one of a document's words have."""
    return (f"{e}-" for e, n in Counter(e for t in own for e in beginnings(t)).items() if n > 1)


def tokens(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def patterns(text: str | None) -> list[float]:
    """Matches of each pattern in ten thousand characters, squeezed."""
    size = len(text or "") + 200
    return [min(1.0, 40.0 * len(p.findall(text)) / size) if text else 0.0 for p in PATTERNS.values()]


def lexicon(found: list[set[str]], toxic: np.ndarray) -> dict[str, float]:
    """Entries that stand in labelled toxic documents, and hardly in others, with their log-odds."""
    ours, others = Counter(), Counter()
    for own, label in zip(found, toxic):
        (ours if label else others).update({*(e for t in own for e in entries(t)), *several(own)})
    words: dict[str, set[str]] = {}
    for t in {t for own, label in zip(found, toxic) if label for t in own}:
        for e in entries(t)[1:]:
            words.setdefault(e, set()).add(t)
    n, m = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share = n / (n + m)
    # twice this likelihood ratio is a chi-square; chance alone hardly gives as much with so many entries to choose from
    least, strong = np.log(max(2, len(ours) + len(others))) + 1, {}
    for e, c in ours.items():
        b = others[e]
        ratio = c * np.log(c / (c + b) / share) + (b * np.log(b / (c + b) / (1 - share)) if b else 0)
        if c >= 3 and ratio >= least and c >= 3 * b and c / n >= 4 * b / m:
            strong[e] = float(np.log((c + 0.1) / (n + 0.2)) - np.log((b + 0.1) / (m + 0.2)))
    # a beginning of which one word makes up most is that word's evidence
    for e in [e for e in strong if e.endswith("-") and not e.endswith("--")]:
        if max((ours[t] for t in words.get(e, ())), default=0) >= 0.8 * ours[e]:
            del strong[e]
    top = sorted(strong, key=lambda e: (-ours[e] * strong[e], e))[:ENTRIES]
    return {e: strong[e] for e in top} | {e: strong.get(e, 3.0) for e in SEED}


def group(entry: str, odds: float) -> int:
    """The lexicon of an entry."""
    if entry in SEED:
        return 0
    kind = 2 if entry.endswith("--") else 1 if entry.endswith("-") else 0
    return 1 + kind * (len(BANDS) + 1) + sum(odds >= b for b in BANDS)


class Lexicon:
    """Which entries a document has; ``cache`` tokens are remembered, with their entries and the beginnings that count if several words have them."""

    def __init__(self, names: list[str], groups: list[int], cache: int = 100_000):
        self.index, self.groups, self.size = {e: i for i, e in enumerate(names)}, np.array(groups, np.int64), cache
        self.known: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def hits(self, own: set[str]) -> list[int]:
        found: set[int] = set()
        twice: Counter[str] = Counter()
        for t in own:
            hit = self.known.get(t)
            if hit is None:
                if len(self.known) >= self.size:
                    self.known.clear()
                hit = self.known[t] = tuple(self.index[e] for e in entries(t) if e in self.index), tuple(f"{e}-" for e in beginnings(t) if f"{e}-" in self.index)
            found.update(hit[0])
            if hit[1]:
                twice.update(hit[1])
        found.update(self.index[e] for e, n in twice.items() if n > 1)
        return sorted(found)

    def lexicons(self, hits: list[int]) -> np.ndarray:
        """Which lexicons have any entry among the hits."""
        out = np.zeros(GROUPS)
        out[self.groups[hits]] = 1
        return out


def votes(hits: list[list[int]], lexicon: Lexicon, dense: np.ndarray) -> np.ndarray:
    """A row for each document: 1 for toxic, 0 for no vote, -1 for clean."""
    out = np.zeros((len(hits), GROUPS + 1 + dense.shape[1]), np.int8)
    for i, own in enumerate(hits):
        out[i, :GROUPS] = lexicon.lexicons(own)
        out[i, GROUPS] = 1 if len(own) > 1 else 0 if own else -1
    out[:, GROUPS + 1 :] = np.where(dense > 0.2, 1, np.where(dense == 0, -1, 0))
    return out


class LabelModel:
    """P(label) and P(vote | label, vote of the voter's parent in a tree), fitted by expectation maximization."""

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 16, least: float = 0.02):
        self.votes = votes + 1
        self.parent = np.full(votes.shape[1], -1)
        start = votes[:, : GROUPS + 1].astype(np.float32)
        # a majority to begin with, in which voters that (nearly) always agree have one vote between them
        voted = np.abs(start)
        agree = (start.T @ start + voted.T @ voted) / 2
        either = voted.sum(0)[:, None] + voted.sum(0)[None, :] - voted.T @ voted
        alike = (agree >= 0.98 * np.maximum(either, 1)).sum(1)
        self.posterior = np.where(start @ (1 / np.maximum(alike, 1)) > 0, 0.95, 0.05)
        self.prior = prior
        for i in range(rounds):
            if i in (1, rounds // 2):  # early, so that voters that copy one another don't decide together what is true
                self._correlate(least)
            self._fit()

    def _table(self, weights: np.ndarray, j: int, parent: int) -> np.ndarray:
        at = self.votes[:, j] if parent < 0 else self.votes[:, j] + 3 * self.votes[:, parent]
        out = np.bincount(at, weights, 3 if parent < 0 else 9).reshape(-1, 3) + 0.1
        return out / out.sum(1, keepdims=True)

    def _fit(self) -> None:
        score = np.zeros((len(self.votes), 2))
        for y, weights in enumerate((1 - self.posterior, self.posterior)):
            score[:, y] = np.log(self.prior if y else 1 - self.prior)
            for j, parent in enumerate(self.parent):
                row = 0 if parent < 0 else self.votes[:, parent]
                score[:, y] += np.log(self._table(weights, j, parent))[row, self.votes[:, j]]
        self.posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -40, 40)))

    def _correlate(self, least: float) -> None:
        """A maximum spanning forest over the voters' mutual information given the label."""
        k = self.votes.shape[1]
        self.parent[:] = -1
        info = np.zeros((k, k))
        for weights in (1 - self.posterior, self.posterior):
            total = weights.sum() + 1e-9
            for i in range(k):
                for j in range(i):
                    both = np.bincount(self.votes[:, i] * 3 + self.votes[:, j], weights, 9).reshape(3, 3) / total
                    alone = both.sum(1, keepdims=True) * both.sum(0, keepdims=True)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        info[i, j] += np.nansum(np.where(both > 0, both * np.log(both / alone), 0)) * total / len(weights)
        info += info.T
        tree = {0}
        while len(tree) < k:
            inside = sorted(tree)
            outside = [x for x in range(k) if x not in tree]
            part = info[np.ix_(inside, outside)]
            a, b = np.unravel_index(part.argmax(), part.shape)
            if part[a, b] >= least:
                self.parent[outside[b]] = inside[a]
            tree.add(outside[b])


def linear(rows: list[list[int]], dense: np.ndarray, n: int, target: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression on soft labels: n entries, the dense columns, the intercept."""
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    feature = np.array([x for row in rows for x in row], np.int64)
    w, m, v = np.zeros(n + dense.shape[1] + 1), 0.0, 0.0
    w[-1] = -2
    for step in range(1, steps + 1):
        z = np.bincount(doc, w[feature], len(rows)) + dense @ w[n:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        grad = np.concatenate([np.bincount(feature, g[doc], n), dense.T @ g, [g.sum()]]) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def unlike(texts: list[str | None], alike: float) -> list[int]:
    """Places of texts that are no copies of earlier ones, by the shares of equal MinHash samples among those with an equal band."""
    salts = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
    seen: dict[tuple[int, bytes], list[int]] = {}
    kept, out = [], []
    for begin in range(0, len(texts), 100):  # few at a time, for memory
        own, first = shingles(Words([(x or "").encode() for x in texts[begin : begin + 100]]), 3)
        for i in range(len(first) - 1):
            part = own[first[i] : first[i + 1]]
            if not len(part):
                out.append(begin + i)
                continue
            least = np.array([mix(part ^ salt).min() for salt in salts])
            keys = [(k, least[k : k + BAND].tobytes()) for k in range(0, SAMPLES, BAND)]
            if any((kept[at] == least).mean() >= alike for at in {at for key in keys for at in seen.get(key, ())}):
                continue
            for key in keys:
                seen.setdefault(key, []).append(len(kept))
            kept.append(least)
            out.append(begin + i)
    return out


def train(texts: list[str | None], toxic: np.ndarray, alike: float = 0.8) -> dict:
    if not len(texts):
        return {"entries": dict.fromkeys(SEED, 4.0), "groups": [0] * len(SEED), "dense": [0.0] * (GROUPS + len(PATTERNS)), "intercept": -3.0}
    at = unlike(texts, alike)
    texts, toxic = [texts[i] for i in at], toxic[at]
    found, dense = [tokens(x) for x in texts], np.array([patterns(x) for x in texts]).reshape(len(texts), len(PATTERNS))
    odds = lexicon(found, toxic)
    own = Lexicon(list(odds), [group(e, x) for e, x in odds.items()])
    rows = [own.hits(x) for x in found]
    prior = float(np.clip(toxic.mean(), 0.02, 0.5))
    posterior = LabelModel(votes(rows, own, dense), prior).posterior
    w = linear(rows, np.concatenate([np.array([own.lexicons(x) for x in rows]), dense], 1), len(odds), posterior)
    return {"entries": dict(zip(odds, w[: len(odds)].tolist())), "groups": own.groups.tolist(), "dense": w[len(odds) : -1].tolist(), "intercept": float(w[-1])}


class Scorer:
    def __init__(self, model: dict):
        self.lexicon = Lexicon(list(model["entries"]), model["groups"])
        self.weights, self.dense, self.intercept = np.array(list(model["entries"].values())), np.array(model["dense"]), model["intercept"]

    def score(self, text: str | None) -> float:
        hits = self.lexicon.hits(tokens(text))
        z = self.intercept + self.weights[hits].sum() + np.concatenate([self.lexicon.lexicons(hits), patterns(text)]) @ self.dense
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, text and label of at most ``sample`` rows of either label, chosen by a hash of the id among the rows where ``keep`` holds, and at most ``sample_bytes`` of text."""
    clear = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = clear.where("label = 1").orderBy(order).limit(sample).unionByName(clear.where("label = 0").orderBy(order).limit(sample))
    # at most 2 * sample ids, which bounds what is broadcast and what goes to one task
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order))).where(F.col("bytes") <= sample_bytes).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = 4000, sample_bytes: int = 64 << 20, alike: float = 0.8) -> dict:
    """The model; ``keep`` says which labels may be learnt from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values(["doc_id"], kind="stable")
        yield pd.DataFrame({"model": [json.dumps(train(rows["text"].where(rows["text"].notna(), None).tolist(), rows["label"].to_numpy() == 1, alike))]})
        release()

    found = labelled(docs, labels, "toxic", keep, sample, sample_bytes).repartition(1).mapInPandas(run, "model string").first()
    return json.loads(found[0]) if found else train([], np.zeros(0, bool))


def score(docs: DataFrame, model: dict, at_least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: more likely toxic) and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in pieces(batches, 1, 1 << 20):
            yield pa.record_batch([batch.column(0), pa.array([own.score(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])
        own.lexicon.known.clear()
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def reject(docs: DataFrame, model: dict, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not toxic."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in pieces(batches, at, 1 << 20):
            yield batch.filter(pa.array([own.score(x) < at_least for x in batch.column(at).to_pylist()], pa.bool_()))
        own.lexicon.known.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
