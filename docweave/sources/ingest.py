"""The table of files: a folder's files with the members of their archives and e-mails, and their texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as ops
from ..tables import Tables, ranked
from . import formats

JUNK = (".DS_Store", "Thumbs.db", "desktop.ini")
COLUMNS = "path string, parent string, top string, nth long, sha256 string, size long, ext string, kind string, status string, text_source string, text string, error string"


#: Containers within containers that are opened, unless more or fewer are asked for.
MAX_DEPTH = 16


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of the files below a folder; paths are relative to it, whatever its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(re.sub(r"([\[\]{}*?\\])", r"\\\1", root))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    relative = F.col("path").substr(F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    return found.select(relative.alias("path"), "content").filter(~F.element_at(F.split("path", "/"), -1).isin(*JUNK))


def _expand(path: str, data: bytes | Exception, parent: str | None, cap: int | None, seen: set[str], left: int) -> Iterator[tuple]:
    if path in seen:  # a second member of that name is neither kept nor opened
        return
    seen.add(path)
    if isinstance(data, Exception):
        yield (path, parent, None, None, formats.extension(path), "corrupt", "corrupt", None, None, str(data)[:500])
        return
    kind = formats.sniff(data, path)
    skip = path.rsplit("/", 1)[-1].startswith("~$") or kind in formats.IGNORED_KINDS
    status, text, error = ("skipped", None, None) if skip else formats.read(data, kind, cap)
    yield (path, parent, hashlib.sha256(data).hexdigest(), len(data), formats.extension(path), kind, status, "native" if text else None, text, error)
    if not skip:
        for name, body in formats.members(data, kind, path):
            inner = body if left or isinstance(body, Exception) else ValueError("not opened: it lies in too many containers")
            yield from _expand(name, inner, path, cap, seen, left - 1)


def expand(found: DataFrame, text_cap: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A row for each file and member of ``path, content``, read; ``top`` is the outermost file, ``nth`` its order in there.
    Texts are whole, or cut to ``text_cap`` characters. What lies in more than ``max_depth`` containers is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for frame in frames:
            for top, data in zip(frame["path"], frame["content"], strict=True):
                rows = [(p, parent, top, n, *rest) for n, (p, parent, *rest) in enumerate(_expand(top, bytes(data), None, text_cap, set(), max_depth))]
                yield pd.DataFrame(rows, columns=names)

    return found.mapInPandas(run, COLUMNS)


def ingest(spark: SparkSession, root: str, patterns: list[str] | None = None, skip_directories: list[str] | None = None, text_cap: int | None = None, tables: Tables | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The files table: ids, from 1 without gaps, ascend with path and order, members have their container's folder context,
    copies point to the first file of the same content, skipped directories are marked.

    Of two members with one path the first is kept. What can't be opened is a row of kind corrupt. The rows are written once, so that
    every reader of the table sees the same ids. Texts are whole, or cut to ``text_cap`` characters
    (the reference keeps ``formats.TEXT_CAP``).
    """
    tables = tables or Tables(spark)
    rows = tables.save(expand(scan(spark, root), text_cap, max_depth), "expanded")
    ids = ranked(rows.select("path", "parent", "top", "nth"), tables, "file-ids", F.col("top"), F.col("nth"))
    parents = ids.select(F.col("path").alias("parent"), F.col("id").alias("parent_id"))
    ordered = rows.drop("parent", "nth").join(ids.select("path", "id", "parent"), "path").join(parents, "parent", "left")
    if skip_directories:
        ordered = ordered.withColumn("status", F.when(ops.in_directories(F.col("top"), skip_directories), "skipped").otherwise(F.col("status")))
    context = ops.folder_context(F.col("top"), patterns or [])
    named = ordered.withColumns({"area": context["area"], "folder_company": context["company"], "folder_job": context["job"], "folder_job_id": context["job_id"], "folder_job_title": context["title"], "folder_category": context["category"]})
    return ops.mark_duplicates(named)
