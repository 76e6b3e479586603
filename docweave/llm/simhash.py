"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distances.

Two fingerprints that differ in at most DISTANCE bits agree wholly in one of DISTANCE + 1 blocks that their bits are cut
into; so fingerprints are joined on blocks and their distances verified. A block's value that many fingerprints share is
split by the same argument: among the bits not yet agreed on, again one of DISTANCE + 1 blocks must agree. So buckets stay
small whatever the number of documents, and no close pair is lost. Before a large bucket is split, its members are
verified against the most central of them; if links by then connect all of them, the bucket has nothing more to tell.

Only distinct fingerprints are joined. Within a bucket a search from fingerprint to fingerprint finds
what hangs together, and gives one link for each member, not one for each pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import components
from .work import Workspace, join_groups, table

WORDS, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of one bucket that a task compares with each other; larger buckets are split.
BUCKET = 500
#: Words whose hashes are held at once.
PIECE = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("i8")  # of each byte


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of the four-word shingles of a text, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone, and the six white-space characters
    if not words:
        return
    hashed = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(words) - WORDS + 1), PIECE):
        some = words[at : at + PIECE + WORDS - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), "i8", len(some)) + 1)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[WORDS - 1 :] - 1).tolist() or [len(joined)]
        yield np.array([hashed(joined[i:j], SEED) for i, j in zip(starts, stops, strict=False)], "u8")


def fingerprint(text: str | None) -> int:
    """The bits that more than half of a text's shingles have; 0 without words."""
    counts, total = np.zeros(64, "i8"), 0
    for hashes in shingle_hashes(text):
        total += len(hashes)
        columns = hashes.view("u1").reshape(-1, 8)
        for byte in range(8):
            counts[8 * byte : 8 * byte + 8] += np.bincount(columns[:, byte], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def linked(members: np.ndarray) -> np.ndarray:
    """Of distinct fingerprints, the first member that each hangs together with."""
    n = len(members)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        root[first] = first
        while queue and len(left):
            near = np.bitwise_count(members[left] ^ members[queue.pop()]) <= DISTANCE
            if near.any():
                root[left[near]] = first
                queue += left[near].tolist()
                left = left[~near]
    return root


def _links(keyed: DataFrame) -> DataFrame:
    """``a, b`` for the members of each bucket: rows ``bucket, agreed, fingerprint`` come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            ends = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            a, b = [], []
            for own in np.split(rows[:, 2].view("u8"), ends):
                root = linked(own)
                member = np.flatnonzero(root != np.arange(len(own)))
                a.append(own[root[member]].view("i8"))
                b.append(own[member].view("i8"))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            if not len(rows):
                continue
            # The last bucket of a batch may go on in the next one.
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or (held[-1][-1, :2] != rows[0, :2]).any()):
                whole = np.concatenate([*held, rows[:cut]])
                held = []
                yield found(whole)
            elif cut:
                yield found(rows[:cut])
            held.append(rows[cut:])
        if held:
            yield found(np.concatenate(held))

    return keyed.select("bucket", "agreed", "fingerprint").mapInArrow(run, "a long, b long")


def _post(rows: DataFrame) -> DataFrame:
    """``rows`` (``fingerprint, agreed``), each under the blocks of its bits outside the mask ``agreed``: ``bucket`` is the value of all bits in the new mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, list[int]] = {}
        for batch in batches:
            prints, agreed = (c.to_numpy().view("u8") for c in batch.columns)
            for mask in np.unique(agreed).tolist():
                if mask not in masks:
                    free = [bit for bit in range(64) if not mask >> bit & 1]
                    parts = np.array_split(np.array(free, "u8"), DISTANCE + 1)
                    masks[mask] = [mask | sum(1 << int(bit) for bit in part) for part in parts]
                own = prints[agreed == mask]
                for new in masks[mask]:
                    bucket, wide = own & np.uint64(new), np.full(len(own), new, "u8")
                    yield pa.RecordBatch.from_arrays([pa.array(x.view("i8")) for x in (own, wide, bucket)], names=["fingerprint", "agreed", "bucket"])

    return rows.select("fingerprint", "agreed").mapInArrow(run, "fingerprint long, agreed long, bucket long")


def _stars(crowded: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``a, b``: each bucket's most central fingerprint, next to the majority of its members in every bit, and those close to it. ``crowded``: ``key, fingerprint``."""
    bits = [F.when(2 * F.sum(F.expr(f"bit_get(fingerprint, {bit})")) > F.count("*"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(0) for bit in range(64)]
    votes = crowded.groupBy("key").agg(F.count("*").alias("n"), *(bits[k].alias(f"bit{k}") for k in range(64)))
    majority = functools.reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"bit{k}") for k in range(64)])
    votes = ws.save(votes.select("key", "n", majority.alias("majority")), f"votes{name}")
    distance = lambda other: F.bit_count(F.col("fingerprint").bitwiseXOR(F.col(other)))
    leaders = join_groups(crowded, votes, "key", "n").groupBy("key").agg(F.min(F.struct(distance("majority").alias("far"), "fingerprint")).alias("leader"), F.count("*").alias("n"))
    leaders = ws.save(leaders.select("key", "n", F.col("leader.fingerprint").alias("a")), f"leaders{name}")
    near = join_groups(crowded, leaders, "key", "n").filter((distance("a") <= DISTANCE) & (F.col("a") != F.col("fingerprint")))
    return ws.save(near.select("a", F.col("fingerprint").alias("b")).distinct(), f"stars{name}")


def close_links(prints: DataFrame, ws: Workspace) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fingerprint``) of at most DISTANCE differing bits, so many that they connect all that such pairs connect.

    A bucket's members agree in all but the free bits, of which each step leaves four fifths; a bucket of distinct
    fingerprints is small at the latest when few bits are free.
    """
    found = None
    rows, step = prints.withColumn("agreed", F.lit(0).cast("long")), 0
    while True:
        posts = ws.save(_post(rows).withColumn("key", F.struct("bucket", "agreed")), f"posts{step}")
        sizes = ws.save(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes{step}")
        met = join_groups(posts, sizes, "key", "n")
        small = met.filter(F.col("n") <= BUCKET).select("bucket", "agreed", "fingerprint")
        links = ws.save(_links(small.repartition("bucket", "agreed").sortWithinPartitions("agreed", "bucket")).distinct(), f"links{step}")
        found = links if found is None else found.unionByName(links)
        if sizes.filter(F.col("n") > BUCKET).isEmpty():
            return found
        crowded = ws.save(met.filter(F.col("n") > BUCKET).select("key", "fingerprint"), f"crowded{step}")
        found = found.unionByName(_stars(crowded, ws, str(step)))
        roots = components(found, ws, f"joined{step}").withColumnRenamed("node", "fingerprint")
        placed = ws.save(crowded.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), f"placed{step}")
        apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        apart = ws.save(apart.filter("low != high").select("key", "n"), f"apart{step}")
        rows = join_groups(crowded, apart, "key", "n").filter("n is not null").select("fingerprint", F.col("key.agreed").alias("agreed"))
        rows, step = ws.save(rows, f"rows{step}"), step + 1


def find(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``doc_id, fingerprint`` (a long), ``component_id``, the smallest doc_id that links reach, for every row of ``docs``.

    Rows with one fingerprint are linked, those without words by their fingerprint 0. Null texts count as empty. Rows without
    a doc_id link like others; a component of such rows alone has a null id. Repeated rows keep a row each. Texts of any length
    are hashed whole, a piece at a time. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    signed = ws.save(with_fingerprints(docs), "fingerprints")
    classes = ws.save(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "classes")
    links = close_links(classes.select("fingerprint"), ws)
    roots = components(links, ws, "linked")
    placed = ws.save(classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    groups = ws.save(groups.filter("n_prints > 1"), "groups")
    members = join_groups(placed, groups, "root", "n_prints")
    members = ws.save(members.select("fingerprint", "n_rows", F.coalesce("component_id", "least").alias("component_id")), "members")
    return join_groups(signed, members, "fingerprint", "n_rows").select("doc_id", "fingerprint", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), Workspace(spark, "simhash"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
