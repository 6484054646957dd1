"""BPE encoding and decoding with a published tokenizer file.

Method: a contiguous rank array. A word's part boundaries stand in one array and the merge ranks of neighbouring
parts in another; the smallest rank (leftmost of equals) is found by a scan, its inner boundary is deleted and the
two neighbouring ranks are refreshed, until no rank is left. Words of more than ``LONG`` parts use a heap over linked
parts instead, with the same merges in the same order, since scans of a very long word would take quadratic time.

Defined cases: null and empty texts have no tokens and decode to the empty string; the strings of special tokens in
a text become their ids, as in the library's default; very long texts and words are encoded whole; an empty table gives
an empty result; repeated rows are encoded each for itself; other columns of the input are ignored or carried along,
whatever their names. A tokenizer file with another normalizer, split or kind of model is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, release

#: Parts of a word from which the heap is used.
LONG = 48
#: Entries of a worker's cache of words, which bounds its memory.
CACHE = 200_000
NONE = 1 << 60

# Fixed values of the tokenizer format: how a byte is written in the vocabulary (printable Latin-1 as itself, all
# others from U+0100 on), and the split pattern.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What a tokenizer file must say besides its vocabulary; the library's defaults where it says nothing.
FORMAT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: White space of the split pattern; str.split() has U+001C to U+001F besides.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    table, extra = [""] * 256, 0x100
    for b in range(256):
        if b in PRINTABLE:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        wrong = [k for k, x in FORMAT.items() if spec.get(k) != x] + [k for k, x in MODEL.items() if model.get(k, x) != x]
        wrong += ["added_tokens"] * any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        if wrong:
            raise ValueError(f"{path}: not supported: {', '.join(wrong)}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        #: Rank by the ids of two neighbouring parts; the id of what they make by rank.
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Ids of single bytes, inside a word and at its end.
        self.first = [self.ids[x] for x in byte_symbols()]
        self.last = [self.ids[x + self.suffix] for x in byte_symbols()]
        self.cache = _Chunks(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word; the suffix belongs to its last byte."""
        first = self.first
        parts = [first[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG:
            return self._merge_long(parts)
        get, made = self.ranks.get, self.made
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            parts[at] = part = made[least]
            del parts[at + 1], ranks[at]  # the boundary between the two
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | part, NONE)
            if at < len(ranks):
                ranks[at] = get(part << 32 | parts[at + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [x for x in parts if x >= 0]

    def encode(self, text: str | None) -> bytes:
        """Token ids as 32-bit integers."""
        if not text:
            return b""
        if "<" in text and self.cut and self.cut.search(text):
            return b"".join(np.int32(self.special[x]).tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter: no final form
                text = text.replace("Σ", "σ")
        text = text.lower()
        if len(self.cache) > CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, SPACE.split(text) if ODD_SPACE.search(text) else text.split()))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space."""
        if chunk.isalpha():  # one word of the split pattern
            return array("i", self.merge(chunk.encode("utf-8"))).tobytes()
        if chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
            return self.cache[chunk[:-1]] + self.cache[chunk[-1]]
        out = array("i")
        for word in SPLIT.findall(chunk):
            out.extend(self.merge(word.encode("utf-8")))
        return out.tobytes()

    def decode(self, ids) -> str:
        """The file names no decoder: the library then joins the tokens by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Chunks(dict):
    """Ids by chunk; very long chunks aren't kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = self.codec.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, an array of token ids, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches, 1):
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.record_batch([batch.column(0), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                text = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(1)]
                yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], names=[key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` of each row, by one worker a task instead of one each for encode() and decode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches, 1, 1 << 20):
            ids = [np.frombuffer(own.encode(x), np.int32) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.record_batch([batch.column(0), lists, pa.array([own.decode(x.tolist()) for x in ids], pa.string())], names=[key, "ids", "decoded"])
        own.cache.clear()
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text, and the ids if asked for."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        *(["ids"] if ids else []),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
