"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies. Its whole part is
taken as it is; its fractional part is rounded in pairs: words move between two
documents' fractional copies, at random but without changing the expectation of
either, until one of the two is integral. What is left of a bucket, one document of
each source at most, is paired on in the next level of a reduction tree, so a source's words
miss its target by less than its last document's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Workspace, join_groups, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf of the reduction tree, and children of each node above.
BUCKET_ROWS, FAN = 4096, 16
SEED = 20


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_rows(rows: DataFrame, ws: Workspace, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 0 for the first in ``order``; no task sorts more than one range of the order.

    The driver gets the number of rows of each range, one for each partition.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            arrays = [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            at += n
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "range_no", "place"])

    schema = T.StructType([*rows.schema.fields, T.StructField("range_no", T.IntegerType()), T.StructField("place", T.LongType())])
    numbered = ws.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    counts, before = [], 0
    for row in sorted(numbered.groupBy("range_no").count().collect()):
        counts.append((row["range_no"], before))
        before += row["count"]
    starts = rows.sparkSession.createDataFrame(counts, "range_no int, before long")
    return numbered.join(F.broadcast(starts), "range_no").withColumn("rank", F.col("place") + F.col("before")).drop("range_no", "place", "before")


def source_targets(sizes: DataFrame, ws: Workspace, weights: int = 3, cap: float = 3.0) -> DataFrame:
    """``key, source, n_rows, source_size, weight, target``, a saved table with a row for each source.

    Sources by code point, null last, weigh 1 to ``weights`` in turn. They share all sizes by weight;
    a target above ``cap`` times its source's size stops there and the excess goes to the
    others by weight, again until none is above.
    """
    sources = sizes.groupBy("key", "source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = rank_rows(sources, ws, "sources", F.col("source").isNull(), F.col("source"))
    ranked = ws.save(ranked.withColumn("weight", F.col("rank") % weights + 1), "weights")
    limit = cap * F.col("source_size")
    level, stopped = None, 0
    while True:
        below = F.lit(True) if level is None else limit >= F.col("weight") * level
        found = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(below, F.col("weight"))).alias("free"),
            F.sum(F.when(~below, limit)).alias("fixed"),
            F.count(F.when(~below, 1)).alias("stopped"),
        ).first()
        if not found["free"] or (level is not None and found["stopped"] == stopped):
            break
        level, stopped = (found["total"] - (found["fixed"] or 0.0)) / found["free"], found["stopped"]
    return ws.save(ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0.0)))), "targets")


def _draw(salt: int) -> Column:
    """A number in [0, 1) that a row's id and size fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED + salt), "doc_id", "size"), 11) / F.lit(float(1 << 53))


COLUMNS = "doc_id long, source string, key string, size long, source_size long, target double, whole long, share double, bucket long, extra long"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def transfer(size_a: int, share_a: float, size_b: int, share_b: float, draw: float) -> tuple[float, float]:
    """New shares after words have moved between two documents; at least one is 0 or 1, their words' sum is the same."""
    up = min((1 - share_a) * size_a, share_b * size_b)  # words that can go from b to a
    down = min(share_a * size_a, (1 - share_b) * size_b)
    if draw * (up + down) < down:
        if (1 - share_a) * size_a <= share_b * size_b:
            return 1.0, min(1.0, max(0.0, share_b - (1 - share_a) * size_a / size_b))
        return min(1.0, share_a + share_b * size_b / size_a), 0.0
    if share_a * size_a <= (1 - share_b) * size_b:
        return 0.0, min(1.0, share_b + share_a * size_a / size_b)
    return max(0.0, share_a - (1 - share_b) * size_b / size_a), 1.0


def _pair(last: bool):
    """Pair the rows of each bucket and source, which come one after another; ``last`` also rounds what is left."""

    def settle(row: list, share: float) -> list:
        row[7] = share
        if share < 1e-9 or share > 1 - 1e-9 or not row[3]:
            row[9] = int(share > 0.5)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held: list | None = None  # [columns..., draw], with a share between 0 and 1

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

        def let_go() -> None:
            nonlocal held
            if held is not None:
                if last:
                    held[9] = int(held[10] < held[7])
                rows.append(held[:10])
                held = None

        for batch in batches:
            for values in zip(*(batch.column(n).to_pylist() for n in [*NAMES, "draw"]), strict=True):
                row = list(values)
                if held is not None and (held[8], held[2]) != (row[8], row[2]):
                    let_go()
                if settle(row, row[7])[9] is not None:
                    rows.append(row[:10])
                elif held is None:
                    held = row
                else:
                    a, b = transfer(held[3], held[7], row[3], row[7], row[10])
                    both = [settle(held, a), settle(row, b)]
                    rows.extend(r[:10] for r in both if r[9] is not None)
                    held = next((r for r in both if r[9] is None), None)
                if len(rows) >= 4000:
                    yield flush()
                    rows.clear()
        let_go()
        if rows:
            yield flush()

    return run


def mix(docs: DataFrame, ws: Workspace, weights: int = 3, cap: float = 3.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` of every row of ``docs``.

    A null text has size 0; a document of size 0 takes no words. The draws come from hashes
    of ids and sizes, so reruns agree; repeated rows and null ids are documents of their own. Rows without words
    need no partner and are spread over all buckets, rows without an id by their texts. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("salt"))
    sizes = ws.save(slim.withColumn("key", key), "sizes")
    targets = source_targets(sizes, ws, weights, cap)
    n = targets.agg(F.sum("n_rows")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = join_groups(sizes, targets.select("key", "source_size", "target", "n_rows"), "key", "n_rows")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        rows.withColumn("whole", F.floor(copies + 1e-9).cast("long"))
        .withColumn("share", F.greatest(F.lit(0.0), copies - F.col("whole")))
        .withColumn("bucket", F.pmod(F.when(F.col("size") == 0, F.monotonically_increasing_id()).otherwise(F.xxhash64(F.lit(SEED), "doc_id", "size", "salt")), F.lit(buckets)))
        .drop("salt")
        .withColumn("extra", F.lit(None).cast("long"))
    )
    settled, level = [], 0
    while True:
        last = buckets == 1
        order = [F.col("bucket"), F.col("key"), _draw(100 + level), F.col("doc_id"), F.col("size")]
        dealt = rows.repartition(F.col("bucket"), *([F.col("key")] if level else [])).withColumn("draw", _draw(200 + level))
        done = ws.save(dealt.sortWithinPartitions(*order).select(*NAMES, "draw").mapInArrow(_pair(last), COLUMNS), f"level{level}")
        settled.append(done.filter("extra is not null"))
        if last:
            break
        buckets, level = -(-buckets // FAN), level + 1
        rows = done.filter("extra is null").withColumn("bucket", F.floor(F.col("bucket") / FAN))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", F.col("whole") + F.col("extra")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def repeat_rows(docs: DataFrame, ws: Workspace, weights: int = 3, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it: not at all, once or up to ``cap`` times.

    Rows meet their copies in a shuffle at any size: one copy number for each row would not stay small enough to broadcast.
    Rows that share id, source and size divide their copies among them. Null texts and texts without words are taken
    as often as the rounding says; an empty table gives an empty result; columns keep their names, whatever they are.
    """
    keys = ["doc_id", "source", "size"]
    mixed = mix(docs, ws, weights, cap).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n_rows"))
    mixed = ws.save(mixed, "copies")
    inner = [F.col("row.doc_id").cast("long"), F.col("row.source").cast("string"), F.col("size")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("size", word_count(F.col("row.text")))
    own, nth = mixed.toDF("k0", "k1", "k2", "copies", "n_rows"), F.lit(1)
    if not mixed.filter("n_rows > 1").isEmpty():  # rows that share all three divide the copies among them
        nth = F.row_number().over(Window.partitionBy(*inner).orderBy(F.xxhash64("row.text")))
    rows = rows.withColumn("nth", nth)
    met = rows.join(own.hint("merge"), inner[0].eqNullSafe(F.col("k0")) & inner[1].eqNullSafe(F.col("k1")) & (inner[2] == F.col("k2")))
    times = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    return met.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Workspace(spark, "mixing"))
