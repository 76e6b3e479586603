"""The manifest: trees, proofs and tampering, against plain recursion."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from docweave.llm import merkle
from docweave.llm.work import Workspace

from .conftest import edge_rows


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(tree, index, fanout):
    out = []
    for nodes in tree[:-1]:
        first = index // fanout * fanout
        out.append((index - first, [x for k, x in enumerate(nodes[first : first + fanout], first) if k != index]))
        index //= fanout
    return out


def brute(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in groups[lang]], fanout)
    top = levels([trees[lang][-1][0] for lang in order], fanout)
    out = []
    for number, lang in enumerate(order):
        for index, row in enumerate(groups[lang]):
            path = proof(trees[lang], index, fanout) + proof(top, number, fanout)
            changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf((*row[:3], row[3] + 1, row[4])) if changed else leaf(row)
            for own, others in path:
                folded = h(*others[:own], folded, *others[own:])
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, h(*(x for _, others in path for x in others)), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, index string, tree string, n string, proof string"


def rows_of(n, seed=3):
    rng = random.Random(seed)
    rows = [(i * 3 % n, rng.choice(["a", None, "ü"]), rng.choice(["en"] * 8 + ["de", "", None, "日本", "z"]), rng.choice([None, 5, 70]), rng.choice([None, "", "x" * 50_000, f"text ü {i}"])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 3 + [rows[0]] * 3 + [(None, "a", "en", 3, "t"), (7, "alone", "only", 1, "one")]


@pytest.mark.parametrize("block", [1024, 4])
def test_audit_is_plain_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    if block == 4:
        monkeypatch.setattr("docweave.llm.work.BROADCAST_ROWS", 0)
        monkeypatch.setattr(merkle, "WAITING", 3)
    rows = rows_of(211)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    got = merkle.audit(docs, Workspace(spark, "m")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize(("n", "fanout"), [(1, 2), (2, 2), (65, 3), (64, 4), (37, 16)])
def test_any_fanout(spark, monkeypatch, n, fanout):
    monkeypatch.setattr(merkle, "BLOCK_NODES", 9)
    rows = [(i, "s", "en" if i % 3 else None, i, "t") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select(F.struct(F.col("doc_id").alias("id")).alias("row"), F.col("lang").alias("group"), F.col("doc_id").alias("sort"), F.unhex(merkle.row_digest(*(F.col(c) for c in merkle.COLUMNS))).alias("digest"))
    made = merkle.manifest(leaves, Workspace(spark, "m"), fanout)
    want = {r[0]: r for r in brute(rows, fanout)}
    assert made.root.hex() == want[0][3]
    got = made.rows.collect()
    assert len(got) == n
    for r in got:
        assert r.subroot.hex() == want[r.row.id][2] and h(r.proof.hex()) == want[r.row.id][4]
    assert {(r.group, r.subroot.hex()) for r in made.subroots.collect()} == {(None if i % 3 == 0 else "en", want[i][2]) for i in range(n)}
    # A proof holds for its own leaf, and for no other.
    checked = merkle.verify(merkle.Manifest(made.rows.withColumn("row", F.struct("row.id", F.unhex(F.lit("00" * 32)).alias("claimed"))), made.subroots, made.root, made.n_trees, fanout), "claimed")
    assert all(r.folded != made.root for r in checked.collect())


def test_edges(spark, edge, none):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = edge.withColumn("n_chars", F.length("text").cast("long"))
    rows = [(r[0], r[2], r[3], None if r[1] is None else len(r[1]), r[1]) for r in edge_rows()]
    got = merkle.audit(docs, Workspace(spark, "m"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))
    empty = merkle.audit(none.withColumn("n_chars", F.lit(1).cast("long")).select(*columns), Workspace(spark, "n"))
    assert empty.count() == 0 and empty.columns == got.columns
