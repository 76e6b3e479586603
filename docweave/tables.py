"""Written tables between the steps of a job, and ranks that need no single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a partition that is grouped, sorted or joined.
ROWS = 500_000


def partitions(spark: SparkSession, rows: int) -> int:
    """So many that none has far more than ``ROWS`` of the rows, and one for each core at least. Spark's own count is one for all inputs, and
    it joins small partitions up to bytes as compressed, of which a row of ids has fewer than ten, so that a task's memory grows with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def spread(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` dealt to ``parts`` partitions by their keys; as they are without ``parts``."""
    return rows if parts is None else rows.repartition(parts, *keys)


class Tables:
    """Parquet tables in a folder that driver and executors share: a given one, or a new one below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        if root is None:
            base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if not base and not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"{(base or tempfile.gettempdir()).rstrip('/')}/docweave-{uuid.uuid4().hex[:12]}"
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, in place of one of that name, and return it as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def install(self, target: str) -> Tables:
        """Move the whole folder to ``target``, in place of what is there: readers see the old tables or the new ones."""
        source, goal = self._path(self.root), self._path(target.rstrip("/"))
        files = goal.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = self._path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
        if files.exists(goal):
            files.rename(goal, old)
        if not files.rename(source, goal):
            raise OSError(f"{self.root} can't be moved to {target}")
        if files.exists(old):
            files.delete(old, True)
        return Tables(self.spark, target)


def ranked(rows: DataFrame, tables: Tables, name: str, *order: Column, column: str = "id") -> DataFrame:
    """``rows`` with their place in ``order``, from 1, without gaps. Rows are dealt by ranges of the order and written once, so that every
    reader sees the same places; the driver gets one count for each range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], names=[*batch.schema.names, "_range", "_place"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType())])
    dealt = tables.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    starts, before = [], 0
    for row in sorted(dealt.groupBy("_range").count().collect()):
        starts.append((row["_range"], before))
        before += row["count"]
    known = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    return dealt.join(F.broadcast(known), "_range").withColumn(column, F.col("_place") + F.col("_before") + 1).drop("_range", "_place", "_before")


def roots(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``node, root`` of a forest ``node, parent`` in which every node's parent comes before it: links are followed to their ends by doubling."""
    found, step = tables.save(links.select("node", F.col("parent").alias("root")), f"{name}-0"), 0
    while True:
        above = found.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step += 1
        jumped = found.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        jumped = tables.save(jumped, f"{name}-{step}")
        found = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return found
