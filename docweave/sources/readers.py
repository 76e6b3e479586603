"""Texts of files that need a reader of one's own, such as scans and PDFs: which are read, through a cache by content."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes, kind and path of a file to its text; None where it has none. Raises for a file that it can't read.
Reader = Callable[[bytes, str, str], str | None]
#: Share of pixels equal to their right neighbour from which a picture counts as a screenshot, and rows that are looked at.
SCREENSHOT, SAMPLED_ROWS = 0.95, 256
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples of a pixel by PNG colour type


def png_pixels(data: bytes) -> np.ndarray | None:
    """Rows of pixels of a PNG with 8 bits a sample that is not interlaced; None for any other bytes."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    at, body, head = 8, b"", b""
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        head = data[at + 8 : at + 21] if kind == b"IHDR" else head
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    if len(head) < 13 or head[8] != 8 or head[12] or head[9] not in _CHANNELS:
        return None
    width, height, step = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), _CHANNELS[head[9]]
    try:
        raw = zlib.decompress(body)
    except zlib.error:
        return None
    line = width * step + 1
    if not width or not height or len(raw) < height * line:
        return None
    rows = np.frombuffer(raw, "u1", height * line).reshape(height, line)
    out, above = np.zeros((height, width, step), "u1"), np.zeros((width, step), "i4")
    for y in range(height):
        got, method = rows[y, 1:].reshape(width, step).astype("i4"), rows[y, 0]
        if method == 2:
            got = got + above
        elif method == 1:
            got = np.cumsum(got, 0)
        elif method in (3, 4):
            left, corner = np.zeros(step, "i4"), np.zeros(step, "i4")
            for x in range(width):
                if method == 3:
                    base = (left + above[x]) // 2
                else:
                    guess = left + above[x] - corner
                    d = [abs(guess - left), abs(guess - above[x]), abs(guess - corner)]
                    base = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above[x], corner))
                got[x] = left = (got[x] + base) & 255
                corner = above[x]
        above = got & 255
        out[y] = above
    return out


def looks_like_screenshot(data: bytes) -> bool:
    """Whether most pixels equal their right neighbour, as on a screen; a picture that can't be decoded counts as one."""
    pixels = png_pixels(data)
    if pixels is None or pixels.shape[1] < 2:
        return True
    some = pixels[:: max(1, len(pixels) // SAMPLED_ROWS)]
    return float((some[:, 1:] == some[:, :-1]).all(2).mean()) >= SCREENSHOT


def wanted(files: DataFrame) -> Column:
    """Files that a reader is asked for: originals that need one and are not named as photographs of a camera."""
    name = F.element_at(F.split("path", "[/:]"), -1)
    return (F.col("status") == "needs_ocr") & F.col("duplicate_of").isNull() & ~name.rlike(r"(?i)^(?:IMG|MKT)_\d+\.jpe?g$")


def read_with(files: DataFrame, contents: DataFrame, reader: Reader, backend: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``files`` with the texts that a reader gives, and the new rows of the cache ``sha256, backend, text``.

    ``contents`` has ``path, content``. Only contents that the cache lacks are read, each once; photographs are passed
    over. A file that the reader fails on becomes corrupt, with the error; one without text becomes empty.
    """
    todo = files.filter(wanted(files)).select("sha256", "path", "kind").dropDuplicates(["sha256"])
    known = None if cache is None else cache.filter(F.col("backend") == backend).select("sha256", "text")
    if known is not None:
        todo = todo.join(known.select("sha256"), "sha256", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, path, kind, data in zip(*(batch.column(c).to_pylist() for c in ("sha256", "path", "kind", "content")), strict=True):
                text, error = None, None
                try:
                    if kind == "pdf" or looks_like_screenshot(data):
                        text = reader(data, kind, path)
                except Exception as problem:  # noqa: BLE001 a reader of any kind
                    error = str(problem)[:500]
                rows.append((sha, text, error))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["sha256", "text", "error"])

    found = todo.join(contents, "path").select("sha256", "path", "kind", "content").mapInArrow(run, "sha256 string, text string, error string")
    new = found.filter("error is null").select("sha256", F.lit(backend).alias("backend"), "text")
    every = found if known is None else found.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    got = every.select("sha256", F.col("text").alias("new_text"), F.col("error").alias("new_error"), F.lit(True).alias("done"))
    rows = files.join(got, "sha256", "left").withColumn("takes", wanted(files) & F.col("done").isNotNull())
    status = F.when(F.col("new_error").isNotNull(), "corrupt").when(F.trim(F.coalesce("new_text", F.lit(""))) == "", "empty").otherwise("ok")
    values = {"status": status, "text": F.col("new_text"), "error": F.col("new_error"), "text_source": F.when(F.col("new_text").isNotNull(), backend)}
    return rows.select(*[F.when(F.col("takes"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in files.columns]), new


def read_stats(files: DataFrame) -> DataFrame:
    """``status, text_source, n``: what reading came to."""
    return files.groupBy("status", "text_source").agg(F.count("*").alias("n"))
