"""Words of texts as Arrow dictionary codes, and packed columns of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text that are split together.
SLICE_BYTES = 4 << 20


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin and end in the array of all words ``[^\\x20\\x09-\\x0D]+``, and that array."""
    pieces = pc.ascii_split_whitespace(texts)
    values, offsets = pieces.flatten(), pieces.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype="i8")])
    return before[offsets - offsets[0]], values.filter(full)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about ``limit`` bytes of text at a time; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as compressed bytes: first all lowest bytes of a column, then the next, as far as any is not 0."""
    parts = []
    for column in columns:
        width = max(1, (int(column.max()).bit_length() + 7) // 8) if len(column) else 1
        parts += [len(column).to_bytes(8, "little"), bytes([width])]
        parts.append(np.ascontiguousarray(column.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_columns(data: bytes) -> list[np.ndarray]:
    """The columns of ``pack_columns``, in 64 bits each."""
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        wide = np.zeros((n, 8), "u1")
        wide[:, :width] = np.frombuffer(raw, "u1", n * width, at + 9).reshape(width, n).T
        out.append(wide.view("<i8")[:, 0])
        at += 9 + n * width
    return out
