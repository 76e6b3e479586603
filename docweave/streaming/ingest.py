"""Files as they arrive: each new file once by content, with the members it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingest import expand


def arriving(spark: SparkSession, root: str, delay: str = "7 days", text_cap: int | None = None) -> DataFrame:
    """A stream of read files below ``root``; a file whose content came within ``delay`` before is dropped. Texts are
    whole, or cut to ``text_cap`` characters."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    once = found.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return expand(once.select("path", "content"), text_cap)
