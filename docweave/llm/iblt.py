"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

Two versions' sketches are subtracted cell by cell; peeling cells that hold a single
digest recovers the digests in which they differ. Where peeling gets stuck, both
sketches are built anew with more cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, table

#: Cells of the stored fingerprint, in three parts, and how many times more a retry takes.
CELLS, GROWTH = 12, 4
#: Words of a line that is not cut, and of a piece of a longer one: about, and at most.
PARAGRAPH_WORDS, LONGEST_PIECE = 8, 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def paragraph_digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs: its lines, a longer one cut after every word whose own
    digest is a multiple of ``PARAGRAPH_WORDS``, so that the pieces after an edit are as they were."""
    out = set()
    digest = xxhash.xxh3_64_intdigest
    for line in text.split("\n"):
        words = line.split()
        if len(words) <= PARAGRAPH_WORDS:
            if words:
                out.add(digest(" ".join(words)))
            continue
        first = 0
        for end in [*(i for i, w in enumerate(words, 1) if not digest(w) % PARAGRAPH_WORDS), len(words)]:
            out.update([digest(" ".join(words[i : min(end, i + LONGEST_PIECE)])) for i in range(first, end, LONGEST_PIECE)])
            first = end
    return np.fromiter(out, "u8", len(out))


class Sketches:
    """One sketch for each of several sets, as rows of cells of (count, xor of digests, xor of check
    sums). Each digest is in one cell of each third of its set's row."""

    def __init__(self, n: int, cells: int):
        self.n, self.part = n, max(1, cells // 3)
        self.count = np.zeros(n * 3 * self.part, "i4")
        self.key = np.zeros(n * 3 * self.part, "u8")
        self.check = np.zeros(n * 3 * self.part, "u8")

    def add(self, owner: np.ndarray, digests: np.ndarray, signs: np.ndarray) -> None:
        check = _mix(digests, 99)
        for k in range(3):
            at = (_mix(digests, 3 * self.part + k) % np.uint64(self.part)).astype("i8") + (owner * 3 + k) * self.part
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, digests)
            np.bitwise_xor.at(self.check, at, check)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Sketches:
        out = cls(len(sets), cells)
        sizes = [len(s) for s in sets]
        if sum(sizes):
            out.add(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), np.ones(sum(sizes), "i4"))
        return out

    def __sub__(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, 3 * self.part)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (owner, digest, sign), sign 1 for what only the first has, and which rows have cells left over."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(3 * self.part + 8):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[_mix(self.key[pure], 99) == self.check[pure]]
            if not len(pure):
                break
            owner, key, sign = pure // (3 * self.part), self.key[pure], self.count[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))
            found.append((owner[new], key[new], sign[new]))
            self.add(owner[new], key[new], -sign[new])
        stuck = (self.count != 0) | (self.key != 0)
        owner, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i4"))
        return owner, key, sign, stuck.reshape(self.n, -1).any(1)

    def texts(self, sizes: list[int]) -> list[str]:
        """Each sketch as text: the set's size, then counts, digests and half check sums of its cells."""
        parts = [np.array(sizes, "<u4")[:, None], self.count.astype("<i4").reshape(self.n, -1), self.key.astype("<u8").reshape(self.n, -1), self.check.astype("<u4").reshape(self.n, -1)]
        raw = np.concatenate([np.ascontiguousarray(p).view("u1").reshape(self.n, -1) for p in parts], 1)
        return [base64.b64encode(row.tobytes()).decode() for row in raw]


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of sets the digests only in the first, those only in the second, and the cells of the sketches
    that gave them, which grow until peeling ends.

    Sizes change until peeling ends; each places the digests anew, so that no two share their cells at every size.
    A pair starts at the least size that can hold the difference of the two sets' sizes.
    """
    out: list[tuple[np.ndarray, np.ndarray, int]] = [(np.zeros(0, "u8"), np.zeros(0, "u8"), 0)] * len(pairs)
    left, cells = list(range(len(pairs))), CELLS
    attempt = 0
    while left:
        largest = max((len(a) + len(b) for a, b in (pairs[i] for i in left)), default=0)
        now = [i for i in left if cells >= abs(len(pairs[i][0]) - len(pairs[i][1])) or cells >= 8 * largest]
        if now:
            owner, key, sign, stuck = (Sketches.of([pairs[i][0] for i in now], cells) - Sketches.of([pairs[i][1] for i in now], cells)).peel()
            order = np.argsort(owner, kind="stable")
            owner, key, sign = owner[order], key[order], sign[order]
            bounds = np.searchsorted(owner, np.arange(len(now) + 1))
            for at, i in enumerate(now):
                if not stuck[at]:
                    keys, signs = key[bounds[at] : bounds[at + 1]], sign[bounds[at] : bounds[at + 1]]
                    out[i] = (keys[signs > 0], keys[signs < 0], cells // 3 * 3)
            done = {i for at, i in enumerate(now) if not stuck[at]}
            left = [i for i in left if i not in done]
        cells = cells * GROWTH if cells < 8 * largest else cells + 3 + attempt  # in the end about the same size, but other cells
        attempt += 1
    return out


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int]]:
    """Shared digests over all digests, from what peeling recovers, 1 for two empty texts; and the sketches' cells."""
    out = []
    for (a, _), (mine, theirs, cells) in zip(pairs, differences(pairs), strict=True):
        union = len(a) + len(theirs)
        out.append(((len(a) - len(mine)) / union if union else 1.0, cells))
    return out


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's start, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string()}
_OUT |= {"edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_OUT |= {"edited_cells": pa.int64(), "next_cells": pa.int64()}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_cells long, next_cells long"


#: Paragraphs, about, that are sketched together.
TOGETHER = 60_000


def _rows(triples: list[tuple[int | None, str, np.ndarray, str, np.ndarray]]) -> list[tuple]:
    """Result rows of (doc_id, text, its digests, following text, its digests)."""
    edited = [edit(text, following) for _, text, _, following, _ in triples]
    own, changed = [t[2] for t in triples], [paragraph_digests(e) for e in edited]
    prints = [Sketches.of(sets, CELLS).texts([len(s) for s in sets]) for sets in (own, changed)]
    near = likenesses([*zip(own, changed, strict=True), *((t[2], t[4]) for t in triples)])
    columns = (
        [t[0] for t in triples],
        [len(t[1]) for t in triples],
        [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
        *prints,
        *([n[part] for n in half] for part in (0, 1) for half in (near[: len(triples)], near[len(triples) :])),
    )
    return list(zip(*columns, strict=True))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def compare_with_next(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document.

    ``edited_cells`` and ``next_cells`` are the sizes of the sketches that gave the likenesses: ``CELLS`` where the returned
    fingerprints themselves do, more where a difference is too large for them and the sketches were built again.

    Next is by descending doc_id, null ids last, rows of one id by a hash of their
    texts; the first follows the last, and an only row follows itself. A null text counts as
    empty; a text of any length is fingerprinted whole; equal rows have equal fingerprints. An empty table gives an empty
    result; other columns are ignored, whatever their names. Tasks hold one range of ids each, in order; only each range's last row has to
    wait for the next range's first, which a join of one row for each range brings.
    """
    kinds = _OUT | {"part": pa.int32(), "kind": pa.string(), "text": pa.string()}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, triples, size = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                digests = paragraph_digests(text)
                if held is None:
                    yield _batch([(None,) * len(_OUT) + (part, "head", text)], kinds)
                else:
                    triples.append((*held, text, digests))
                    size += len(held[2]) + len(digests)
                held = (doc_id, text, digests)
                if size >= TOGETHER:
                    yield _batch([row + (part, "done", None) for row in _rows(triples)], kinds)
                    triples, size = [], 0
        if triples:
            yield _batch([row + (part, "done", None) for row in _rows(triples)], kinds)
        if held is not None:
            yield _batch([(held[0], *(None,) * (len(_OUT) - 1), part, "last", held[1])], kinds)

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), F.xxhash64("text"))
    found = ws.save(ordered.mapInArrow(within, f"{_SCHEMA}, part int, kind string, text string"), "within")
    parts = sorted(r["part"] for r in found.filter("kind = 'last'").select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = found.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = found.filter("kind = 'last'").select("doc_id", "text", "part").join(following, "part").join(heads, "next_part")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            triples = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)
            for d, t, x in triples:
                yield _batch(_rows([(d, t, paragraph_digests(t), x, paragraph_digests(x))]), _OUT)

    joined = ends.select("doc_id", "text", "next_text").mapInArrow(across, _SCHEMA)
    return found.filter("kind = 'done'").select(*_OUT).unionByName(joined)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"), Workspace(spark, "fingerprints"))
