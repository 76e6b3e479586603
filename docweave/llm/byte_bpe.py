"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash holds the vocabulary: a pre-token that is a token itself is
resolved by one probe. Any other pre-token is merged over a linked list of its
bytes, the lowest-ranked neighbouring pair first, with a heap of the pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import table

#: Distinct pre-tokens in each of the two generations that a worker keeps, and the characters of the longest that is kept.
CACHE, CACHE_PIECE = 100_000, 64


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: ``find`` gives a key's number or -1.

    Keys fall into buckets; each bucket, the fullest first, gets the first seed that
    sends its keys to free slots. A bucket of one key stores its slot itself.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        self.seeds = np.zeros(self.buckets, "i8")
        self.slots: list[int] = [-1] * self.n
        self.keys = keys
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < self.n:
            raise ValueError("keys must be distinct")
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        alone = next((k for k, b in enumerate(order) if len(groups[b]) == 1), len(order))
        for b in order[:alone]:
            group = groups[b]
            seed = 1
            while True:
                places = [self._slot(hashes[i], seed) for i in group]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                seed += 1
            for i, p in zip(group, places, strict=True):
                self.slots[p] = i
            self.seeds[b] = seed
        free = [p for p, i in enumerate(self.slots) if i < 0]
        for b, place in zip((b for b in order[alone:] if groups[b]), free, strict=True):
            self.slots[place] = groups[b][0]
            self.seeds[b] = -1 - place
        self._seeds = self.seeds.tolist()

    def _slot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        seed = self._seeds[h % self.buckets]
        i = self.slots[-1 - seed if seed < 0 else self._slot(h, seed)]
        return i if self.keys[i] == key else -1


# The public pattern for texts of the first 256 characters alone, spelled for the faster re module.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"


class ByteBpe:
    """A vocabulary of ranks: ids are the ranks, merges go from the lowest rank up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.hash = PerfectHash(tokens)
        self.rank = [ranks[t] for t in tokens]
        self.ranks = ranks
        self.token = {ranks[t]: t for t in tokens}
        self.general = regex.compile(pattern).findall
        self.latin = re.compile(_LATIN).findall if pattern == _GENERAL else self.general
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        return cls(ranks, pattern)

    def lookup(self, piece: bytes) -> int:
        """A token's id, or -1."""
        i = self.hash.find(piece)
        return self.rank[i] if i >= 0 else -1

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is not a token: a heap of pairs over its linked bytes."""
        n = len(piece)
        rank_of, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        after = list(range(1, n + 2))  # a part's end, which is the next part's start
        before = list(range(-1, n))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, left, end = pop(heap)
            middle = after[left]
            # A pair is stale if a part of it has been merged since it was offered.
            if not alive[left] or middle >= n or after[middle] != end:
                continue
            alive[middle] = False
            after[left] = end
            if end < n:
                before[end] = left
                if (rank := rank_of(piece[left : after[end]])) is not None:
                    push(heap, (rank, left, after[end]))
            if (previous := before[left]) >= 0 and (rank := rank_of(piece[previous:end])) is not None:
                push(heap, (rank, previous, end))
        parts, at = [], 0
        while at < n:
            parts.append(rank_of(piece[at : after[at]]))
            at = after[at]
        return parts

    def _piece(self, piece: str) -> tuple[bytes, str]:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            whole = self.lookup(raw)
            ids = [whole] if whole >= 0 else self.merge(raw)
            found = (array("I", ids).tobytes(), ",".join(map(str, ids)))
        if len(piece) <= CACHE_PIECE:
            self.cache[piece] = found
        return found

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """For each pre-token its ids, packed in 32 bits each, and as decimals joined by commas."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        split = (self.latin if text.isascii() or max(text) < "\u0100" else self.general)(text)
        get = self.cache.get
        return [get(p) or self._piece(p) for p in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([packed for packed, _ in self.pieces(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def worker_codec(path: str, pattern: str) -> ByteBpe:
    """The codec that this Python worker keeps between tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe.read(path, pattern)
    return _CODECS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` of every row.

    ``path`` is a file of ranks as tiktoken reads it. A null or empty text has no ids:
    ``n_tokens`` 0 and the digest of nothing. The decoded digest is that of the bytes
    to which the ids decode. Repeated rows and null ids keep a row each; texts of any length are
    encoded whole; an empty table gives an empty result; other columns are ignored, whatever their names.

    Look-ups reach the perfect hash for every pre-token that the worker's cache lacks, so for each distinct one first.
    """
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        for batch in batches:
            counts, ids_hash, text_hash, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                pieces = codec.pieces(text)
                ids = np.frombuffer(b"".join([packed for packed, _ in pieces]), "<u4").tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([s for _, s in pieces]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.asarray(ids, "i4"))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` (binary: the decoded bytes) of rows with ``ids``; null ids decode to null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
