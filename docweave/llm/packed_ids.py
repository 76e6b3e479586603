"""Token-ID output: shards of ids in the minimum number of bits of the vocabulary.

A shard holds whole documents. Its layout, all little-endian:

    magic "DWPK", version u16, bits u16, block u32, n_docs u64, n_ids u64
    n_docs x doc_id i64, n_docs x null flag u8, (n_docs + 1) x first id u64
    (n_blocks + 1) x byte offset of a block u64, then the blocks

A block packs ``block`` ids, each in ``bits`` bits, lowest bits first in 32-bit
words, so that any block, and so any range of ids, is unpacked alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .word_encoder import Library, worker_encoder
from .words import slices
from .work import Workspace, table

MAGIC, VERSION = b"DWPK", 1
HEAD = struct.Struct("<4sHHIQQ")
#: Ids in a block, a multiple of 32, and ids after which a shard is closed.
BLOCK, SHARD_IDS = 4096, 1 << 21


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, filled up with zeros to a multiple of 32, in ``bits`` bits each."""
    rows = np.zeros((-(-len(ids) // 32), 32), "<u8")
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), "<u8")
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, word] |= (rows[:, j] << np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        if shift + bits > 32:
            out[:, word + 1] |= rows[:, j] >> np.uint64(32 - shift)
    return out.astype("<u4").tobytes()


def unpack(packed: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    words = np.frombuffer(packed, "<u4").reshape(-1, bits).astype("<u8")
    out = np.empty((len(words), 32), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 32:
            value = value | (words[:, word + 1] << np.uint64(32 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[:n]


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """The bytes of a shard of these documents."""
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    head = HEAD.pack(MAGIC, VERSION, bits, block, len(ids), len(flat))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], "u1").tobytes()
    first = len(head) + len(known) + len(nulls) + starts.nbytes + 8 * (len(blocks) + 1)
    offsets = np.full(len(blocks) + 1, first, "<u8")
    np.add(np.cumsum([len(b) for b in blocks], dtype="<u8"), first, out=offsets[1:], casting="unsafe")
    return b"".join([head, known, nulls, starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to the ids of a shard's bytes, or of a memory map of its file."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, version, self.bits, self.block, self.n_docs, self.n_ids = HEAD.unpack_from(self.data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed-id shard")
        at = HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.data, dtype, n, at)
            at += out.nbytes
            return out

        known, nulls = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if no else int(d) for d, no in zip(known, nulls, strict=True)]
        self.starts = take("<u8", self.n_docs + 1).astype("i8")
        self.offsets = take("<u8", -(-self.n_ids // self.block) + 1).astype("i8")
        if self.offsets[-1] != len(self.data) or self.starts[-1] != self.n_ids:
            raise ValueError("a shard is cut short")

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end``, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = [
            unpack(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.n_ids - b * self.block))
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first place and ids, a run of whole blocks unpacked at a time."""
        base, held = 0, np.zeros(0, "<u4")
        for doc_id, start, end in zip(self.doc_ids, self.starts[:-1], self.starts[1:], strict=True):
            if end > base + len(held):
                base = start
                held = self.ids(start, min(self.n_ids, max(end, start + 64 * self.block)))
            yield doc_id, int(start), held[start - base : end - base]


def encode_shards(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``part, first_id, n_docs, n_ids, content``: shards in ascending doc_id order by (part, first_id).

    ``first_id`` counts within the part. Rows without a doc_id come first, rows with
    one doc_id in the order of a hash of their texts. A null or empty text is the end id alone, a very long
    one a shard of its own; an empty table gives no shards; other columns are ignored, whatever their names.
    """
    shard_ids = SHARD_IDS

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        bits = bits_for(max(encoder.library.size, end_id + 1))
        part, first, held, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            content = write_shard(doc_ids, ids, bits)
            row = {"part": [part], "first_id": [first], "n_docs": [len(ids)], "n_ids": [held], "content": [content]}
            return pa.RecordBatch.from_pydict(row, schema=SCHEMA)

        for batch in batches:
            for some in slices(batch):
                ends, flat = encoder.encode(some.column("text"))
                flat = np.insert(flat, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(flat[a:b])
                    held += b - a
                    if held >= shard_ids:
                        yield close()
                        first, held, doc_ids, ids = first + held, 0, [], []
        if ids:
            yield close()

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(shards, "part int, first_id long, n_docs long, n_ids long, content binary")


SCHEMA = pa.schema([("part", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, unpacked from the shards.

    The driver gets one sum for each part, that is for each partition of the writing job.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(totals):
        before[part], so_far = so_far, so_far + totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, content in zip(*(batch.column(c) for c in ("part", "first_id", "content")), strict=True):
                at = before[part.as_py()] + first.as_py()
                rows = [(d, at + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in Shard(content.as_buffer()).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return shards.select("part", "first_id", "content").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = encode_shards(table(spark, sf_dir, "documents"), path, end_id=1)
    return read_shards(Workspace(spark, "packed-ids").save(shards, "shards"))


__all__ = ["Library", "Shard", "bits_for", "encode_shards", "op5_token_ids", "pack", "read_shards", "unpack", "write_shard"]
