"""Merkle manifest of a data set: a tree of digests for each group of rows, one tree over the groups, and a proof for every row.

Nodes are combined by key wherever they meet. A parent waits for its children, whose number follows from the
tree's size; the last one to arrive makes it a node, which goes to its own parent at once. A task combines the
leaves that it reads, in any order, and hands on what is left without a parent, its frontier: a few nodes for each
end of a run of leaves. Frontiers are shuffled by blocks of the tree, each round to higher ones, until the roots are made.

Each finished parent leaves a link to its children. Links are read from the root down, a block at a time: what a
node's parents had beside them is its proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import rank_rows
from .work import Workspace, join_groups, table

#: Children of a full parent.
FANOUT = 2
#: Nodes of one level that lie below one node of the next block, at most.
BLOCK_NODES = 1024
#: Parents that wait in a task; beyond, they are handed on as they are.
WAITING = 100_000

FRONTIER, LINK, ROOT = 0, 1, 2
NODE = "kind int, tree long, n long, level int, index long, digest binary, children array<binary>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(*values: Column) -> Column:
    """Digest (hex) of a row: each value ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def parent_digest(children: list[bytes]) -> bytes:
    return sha256(b"".join(child.hex().encode() for child in children)).digest()


def level_sizes(n: int, fanout: int) -> list[int]:
    """Nodes on each level of a tree over ``n`` leaves, up to its root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


def block_levels(fanout: int) -> int:
    """Levels that a block spans."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_NODES:
        levels += 1
    return levels


class Combiner:
    """Parents that wait for children, and the rows that finished ones and frontiers become."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.waiting: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}
        self.sizes: dict[int, list[int]] = {}
        self.out: list[tuple] = []

    def add(self, tree: int, n: int, level: int, index: int, digest: bytes) -> None:
        if n not in self.sizes:
            self.sizes[n] = level_sizes(n, self.fanout)
        sizes = self.sizes[n]
        while level < len(sizes) - 1:
            place, own = divmod(index, self.fanout)
            arity = min(self.fanout, sizes[level] - place * self.fanout)
            _, children = self.waiting.setdefault((tree, level + 1, place), (n, {}))
            children[own] = digest
            if len(children) < arity:
                return
            del self.waiting[tree, level + 1, place]
            ordered = [children[i] for i in range(arity)]
            level, index, digest = level + 1, place, parent_digest(ordered)
            self.out.append((LINK, tree, n, level, index, None, ordered))
        self.out.append((ROOT, tree, n, level, index, digest, None))

    def hand_on(self) -> None:
        """The children of parents that are not complete become the frontier."""
        for (tree, level, place), (n, children) in self.waiting.items():
            self.out += [(FRONTIER, tree, n, level - 1, place * self.fanout + own, digest, None) for own, digest in children.items()]
        self.waiting = {}

    def rows(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        columns = list(zip(*self.out, strict=True)) or [()] * len(kinds)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


def combine(nodes: DataFrame, fanout: int) -> DataFrame:
    """Links, roots and frontiers (``NODE``) that each task makes of its ``tree, n, level, index, digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(fanout)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                combiner.add(*row)
            if len(combiner.waiting) > WAITING:
                combiner.hand_on()
            yield combiner.rows()
        combiner.hand_on()
        yield combiner.rows()

    return nodes.select("tree", "n", "level", "index", "digest").mapInArrow(run, NODE)


def _above(level: Column, index: Column, top: int, fanout: int) -> Column:
    """Index of the ancestor on level ``top``; a node of that level or of a higher one is its own."""
    return F.floor(index / F.pow(F.lit(fanout), F.greatest(F.lit(top) - level, F.lit(0)))).cast("long")


def grow(leaves: DataFrame, ws: Workspace, name: str, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Links and roots of the trees over ``leaves`` (``tree, n, index, digest``).

    A round completes every tree up to the top of its blocks, so rounds are as many as blocks stand on each other, and one
    task never holds more than one block's frontier beside what its parents wait for.
    """
    found = ws.save(combine(leaves.withColumn("level", F.lit(0)), fanout), f"{name}-round0")
    every, top = found, block_levels(fanout)
    while not (open_nodes := found.filter(F.col("kind") == FRONTIER)).isEmpty():
        block = _above(F.col("level"), F.col("index"), top, fanout).alias("block")
        met = open_nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block")
        found = ws.save(combine(met, fanout), f"{name}-round{top}")
        every, top = every.unionByName(found), top + block_levels(fanout)
    return every.filter(F.col("kind") == LINK).drop("kind", "digest"), every.filter(F.col("kind") == ROOT).select("tree", "n", "digest")


def proofs(leaves: DataFrame, links: DataFrame, trees: DataFrame, ws: Workspace, name: str, fanout: int) -> DataFrame:
    """``row, tree, n, index, subroot, proof`` of ``leaves`` (``row, tree, n, index``): the digests beside a leaf's ancestors, from the leaf up,
    then its tree's own ``proof``.

    ``trees`` has ``tree, n, subroot, proof``. Proofs of the blocks' roots are worked out first, from the highest
    blocks down; those of the leaves need only their own block's links and its root's proof.
    """
    span = block_levels(fanout)
    row_schema = leaves.schema["row"].dataType
    last = [("tree", T.LongType()), ("n", T.LongType()), ("index", T.LongType()), ("subroot", T.BinaryType()), ("proof", T.BinaryType())]
    schema = T.StructType([T.StructField("row", row_schema), *(T.StructField(k, kind) for k, kind in last)])
    n_max = trees.agg(F.max("n").alias("n")).first()["n"]
    blocks = max(1, -(-(len(level_sizes(n_max, fanout)) - 1) // span)) if n_max else 1

    def descend(top: int):
        def run(_key: tuple, found: pa.Table) -> pa.Table:
            children, root, below = {}, None, []
            arrow_rows = found.column("row")
            columns = [found.column(c).to_pylist() for c in ("kind", "n", "level", "index", "children", "subroot", "proof")]
            for place, (kind, n, level, index, own, subroot, proof) in enumerate(zip(*columns, strict=True)):
                if kind == LINK:
                    children[level, index] = own
                    if level == top - span + 1 and top > span:
                        below += [(None, n, index * fanout + i) for i in range(len(own))]
                elif kind == ROOT:
                    root = (subroot, proof)
                else:
                    below.append((place, n, index))
            subroot, above = root
            out = []
            for _, n, index in below:
                beside, at, level = [], index, top - span + 1
                while (level, at // fanout) in children:
                    own = children[level, at // fanout]
                    beside += own[: at % fanout] + own[at % fanout + 1 :]
                    at, level = at // fanout, level + 1
                out.append(b"".join(beside) + above)
            places = pa.array([place for place, _, _ in below], pa.int64())
            numbers = [pa.array([x[k] for x in below], pa.int64()) for k in (1, 2)]
            trees_of = pa.array([_key[0].as_py()] * len(below), pa.int64())
            rows = arrow_rows.combine_chunks().take(places) if len(below) else arrow_rows.slice(0, 0).combine_chunks()
            return pa.table([rows, trees_of, *numbers, pa.array([subroot] * len(below), pa.binary()), pa.array(out, pa.binary())], names=schema.names)

        return run

    none = {"row": F.lit(None).cast(row_schema), "level": F.lit(None).cast("int"), "children": F.lit(None).cast("array<binary>"), "subroot": F.lit(None).cast("binary"), "proof": F.lit(None).cast("binary")}
    order = ["kind", "tree", "n", "block", "level", "index", "row", "children", "subroot", "proof"]

    def shaped(df: DataFrame, kind: int, block: Column) -> DataFrame:
        given = df.withColumns({"kind": F.lit(kind), "block": block} | {k: v for k, v in none.items() if k not in df.columns})
        return given.select(*order)

    known = None
    for block_no in range(blocks, 0, -1):
        top = block_no * span
        least = fanout ** (top - span)  # trees of more leaves have a node above the bottom of this block
        most = fanout**top
        start = trees.filter((F.col("n") <= most) & (F.col("n") > (least if block_no > 1 else 0))).withColumn("index", F.lit(0).cast("long"))
        roots = shaped(start, ROOT, F.col("index"))
        if known is not None:
            roots = roots.unionByName(shaped(known.drop("row"), ROOT, F.col("index")))
        here = links.filter((F.col("level") > top - span) & (F.col("level") <= top))
        rows = roots.unionByName(shaped(here, LINK, _above(F.col("level"), F.col("index"), top, fanout)))
        if block_no == 1:
            rows = rows.unionByName(shaped(leaves, FRONTIER, _above(F.lit(0), F.col("index"), top, fanout)))
        known = ws.save(rows.groupBy("tree", "block").applyInArrow(descend(top), schema), f"{name}-proofs{block_no}")
    return known


@dataclass(frozen=True)
class Manifest:
    """``rows``: ``row, tree, n, index, subroot, proof`` for every row (``proof``: the digests beside its ancestors, 32 bytes each);
    ``subroots``: ``tree, group, n, subroot``; ``root`` (None of an empty table) and the number of trees."""

    rows: DataFrame
    subroots: DataFrame
    root: bytes | None
    n_trees: int
    fanout: int


def manifest(leaves: DataFrame, ws: Workspace, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves``: ``row`` (a struct, carried along), ``group`` (a string), ``sort`` (orders a group's leaves) and ``digest`` (binary).

    Groups are ordered bytewise, a null group first. Leaves that ``sort`` leaves equal are ordered by their digest; rows that are equal
    in both may swap places, which changes no digest. Nulls come first. An empty table has no root and gives no rows.
    The driver gets counts and one digest. No task holds a group: ranks come from ranges, trees grow by blocks.
    """
    # Null sorts before the rest, and is a group like any other in joins.
    keyed = leaves.withColumn("group_key", F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("="), F.col("group")))).withColumn("tie", F.monotonically_increasing_id())
    ranked = rank_rows(keyed.drop("group"), ws, "ranked", F.col("group_key"), F.col("sort"), F.col("digest"), F.col("tie")).drop("sort", "tie")
    sizes = ranked.groupBy("group_key").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    groups = ws.save(rank_rows(sizes, ws, "groups", F.col("group_key")).withColumnRenamed("rank", "tree"), "trees")
    placed = join_groups(ranked, groups, "group_key", "n").select("row", "digest", "tree", "n", (F.col("rank") - F.col("first")).alias("index"))
    links, roots = grow(placed.drop("row"), ws, "groups", fanout)
    subroots = ws.save(roots.withColumnRenamed("digest", "subroot"), "subroots")
    n_trees = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("index"), F.col("subroot").alias("digest"), F.struct("tree", "n", "subroot").alias("row"))
    top_links, top_root = grow(tops.drop("row"), ws, "top", fanout)
    found = top_root.first()
    top_tree = top_root.select("tree", "n", F.col("digest").alias("subroot"), F.lit(b"").alias("proof"))
    top = proofs(tops.drop("digest"), top_links, top_tree, ws, "top", fanout)
    rows = proofs(placed.drop("digest"), links, top.select("row.*", "proof"), ws, "rows", fanout)
    named = subroots.join(groups.select("tree", F.when(F.col("group_key") != "", F.expr("substr(group_key, 2)")).alias("group")), "tree")
    return Manifest(rows, named, bytes(found["digest"]) if found else None, n_trees, fanout)


def fold(digest: bytes, index: int, n: int, beside: bytes, fanout: int) -> tuple[bytes, bytes]:
    """The root that a leaf and the digests beside its ancestors give, and what is left of the latter."""
    at = 0
    for size in level_sizes(n, fanout)[:-1]:
        place, own = divmod(index, fanout)
        others = min(fanout, size - place * fanout) - 1
        digests = [beside[i : i + 32] for i in range(at, at + 32 * others, 32)]
        at += 32 * others
        digest, index = parent_digest([*digests[:own], digest, *digests[own:]]), place
    return digest, beside[at:]


def verify(made: Manifest, claimed: str) -> DataFrame:
    """``made.rows`` with ``folded``: the root that the digest in field ``claimed`` of ``row`` (binary) and the row's proof give, and ``proof_sha256``, the
    digest of the proof."""
    fanout, n_trees = made.fanout, made.n_trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded, digests = [], []
            columns = [batch.column("row").field(claimed), *(batch.column(c) for c in ("tree", "n", "index", "proof"))]
            for digest, tree, n, index, proof in zip(*(c.to_pylist() for c in columns), strict=True):
                subroot, rest = fold(digest, index, n, proof, fanout)
                folded.append(fold(subroot, tree, n_trees, rest, fanout)[0])
                digests.append(sha256(proof.hex().encode()).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.binary()), pa.array(digests, pa.binary())], names=[*batch.schema.names, "folded", "proof_sha256"])

    schema = T.StructType([*made.rows.schema.fields, T.StructField("folded", T.BinaryType()), T.StructField("proof_sha256", T.BinaryType())])
    return made.rows.mapInArrow(run, schema)


def audit(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``: its manifest by ``lang``, and whether a copy in which
    some rows' ``n_chars`` is one more (those whose id's crc32 7 divides) still agrees with it.

    Null columns are part of a leaf like others; rows without an id come first in their lang and are not tampered with, nor are
    those without ``n_chars``. Rows of one id are ordered by their leaves; equal rows keep a leaf each. Texts are digested whole. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    original = row_digest(*columns.values())
    tampered = row_digest(*(columns | {"n_chars": F.col("n_chars") + 1}).values())
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in COLUMNS[1:]))
    hashed = slim.select("doc_id", "lang", F.unhex(original).alias("digest"), F.when(changed, F.unhex(tampered)).alias("changed"))
    leaves = hashed.select(
        F.struct("doc_id", F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("claimed")).alias("row"), F.col("lang").alias("group"), F.col("doc_id").alias("sort"), "digest"
    )
    made = manifest(leaves, ws)
    out = verify(made, "claimed")
    text = lambda c: F.lower(F.hex(c))
    root = F.lit((made.root or b"").hex())
    return out.select("row.doc_id", text("row.leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), text("proof_sha256").alias("proof_sha256"), text("folded").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Workspace(spark, "merkle"))


def _sql_leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256(concat({', '.join(parts)}))"


_CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
            lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) AS BIGINT)"""
_NEXT = "list_transform(range(0, (len(nodes) + 1) // 2), lambda j: sha256(concat(nodes[2 * j + 1], coalesce(nodes[2 * j + 2], ''))))"

ORACLE = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} END AS bad FROM documents),
    i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    t AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM i GROUP BY lang
          UNION ALL SELECT lang, level + 1, {_NEXT} FROM t WHERE len(nodes) > 1),
    s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE len(nodes) = 1),
    u AS (SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM s UNION ALL SELECT level + 1, {_NEXT} FROM u WHERE len(nodes) > 1),
    v AS (SELECT lang, level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS j FROM t),
    w AS (SELECT level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS j FROM u),
    low AS (SELECT i.lang, i.i, list((CASE WHEN (i.i >> l.level) % 2 = 1 THEN 'L' ELSE 'R' END) || coalesce(v.node, '') ORDER BY l.level) AS steps
            FROM i JOIN (SELECT lang, level FROM t WHERE len(nodes) > 1) l ON i.lang IS NOT DISTINCT FROM l.lang
            LEFT JOIN v ON v.lang IS NOT DISTINCT FROM i.lang AND v.level = l.level AND v.j = xor(i.i >> l.level, 1) GROUP BY 1, 2),
    high AS (SELECT s.lang, list((CASE WHEN (s.i >> l.level) % 2 = 1 THEN 'L' ELSE 'R' END) || coalesce(w.node, '') ORDER BY l.level) AS steps
             FROM s JOIN (SELECT level FROM u WHERE len(nodes) > 1) l ON true LEFT JOIN w ON w.level = l.level AND w.j = xor(s.i >> l.level, 1) GROUP BY 1),
    p AS (SELECT i.*, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
          FROM i JOIN s ON s.lang IS NOT DISTINCT FROM i.lang LEFT JOIN low ON low.lang IS NOT DISTINCT FROM i.lang AND low.i = i.i
          LEFT JOIN high ON high.lang IS NOT DISTINCT FROM i.lang),
    f AS (SELECT *, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256,
                 list_reduce(list_prepend(coalesce(bad, leaf), steps), lambda a, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM p)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""
