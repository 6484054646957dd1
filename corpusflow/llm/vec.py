"""Words of many texts at once, as arrays over one buffer of bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_SPACES = [0x20, *range(0x09, 0x0E)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _bytes(family: int = 0) -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(family))
    table[65:91] = table[97:123]
    return table


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(buffer: np.ndarray, family: int = 0) -> np.ndarray:
    """Sums of byte hashes times powers; span_hashes() takes any span's hash from them. Families are independent."""
    up, _ = powers(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_bytes(family)[buffer] * up[: len(buffer)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[_SPACES] = True
    return table


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z as a-z: ``hashes`` of all, and ``first``, where each text's begin (one more at the end)."""

    def __init__(self, texts: Sequence[bytes]):
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~_is_space()[self.buffer]
        step = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.hashes = span_hashes(prefix_sums(self.buffer), self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct n-word shingles of each text, sorted, and where each text's begin; a text of fewer words has one, of all."""
    counts = np.diff(words.first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), made)
    base = np.concatenate([[0], np.cumsum(made)])
    at = words.first[doc] + (np.arange(len(doc)) - base[doc])
    length = np.minimum(n, counts[doc])
    out, padded = np.zeros(len(doc), np.uint64), np.append(words.hashes, np.zeros(n, np.uint64))
    for k in range(n):
        out = out * np.uint64(BASE) + np.where(k < length, padded[at + k], np.uint64(k + 1))
    out = mix(out + length.astype(np.uint64))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(counts) + 1))
