"""Shared tables between the steps of an operator."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of groups, of some tens of bytes a row, is broadcast whole.
BROADCAST_ROWS = 100_000
#: Groups that each hold at least one in so many of the rows; there can be no more than so many.
HOT_GROUPS = 1000


class Workspace:
    """Parquet tables in a new folder below ``spark.checkpoint.dir``.

    A step whose result is read more than once, or whose partition numbers or
    random choices later steps rely on, is written here first: the table is the
    same however often a lost executor makes Spark read it again, and the lineage
    ends there. Only where the session names no such folder, as in tests on one
    machine, is a temporary folder taken.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.gettempdir()
        self.spark = spark
        self.root = f"{root.rstrip('/')}/docweave-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name`` and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no result depends on any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined on ``key`` with ``groups``, a saved table with one narrow row for each key.

    ``size`` is the column of ``groups`` with a group's number of rows. A table counted
    as small is broadcast. Beyond that only the groups that hold a thousandth of the
    rows or more, at most a thousand of them, are broadcast, so that no large group
    goes to one task; the others meet in a shuffle.
    """
    total = groups.agg(F.count("*").alias("n"), F.sum(size).alias("rows")).first()
    if total["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    hot = F.broadcast(groups.filter(F.col(size) >= total["rows"] / HOT_GROUPS))
    cold = groups.filter(F.col(size) < total["rows"] / HOT_GROUPS)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key, "left")
    return rows.join(hot, key).unionByName(rest)
