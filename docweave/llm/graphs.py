"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: root is the smallest node that a path reaches.

    Each round hangs every node below its smallest neighbour, follows these links to their
    ends by doubling, and contracts the edges to the trees' roots; a tree has two
    nodes at least, so rounds are logarithmic. All state is in tables.
    """
    found, round_no = None, 0
    edges = ws.save(edges.filter("a != b").select("a", "b").distinct(), f"{name}-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        tree = ws.save(tree.withColumn("parent", F.least("node", "parent")), f"{name}-tree{round_no}")
        step = 0
        while True:
            above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            jumped = tree.join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved"))
            jumped = ws.save(jumped, f"{name}-jump{round_no}-{step}")
            moved = not jumped.filter("moved").isEmpty()
            tree, step = jumped.select("node", "parent"), step + 1
            if not moved:
                break
        if found is None:
            found = tree.withColumnRenamed("parent", "root")
        else:
            higher = tree.select(F.col("node").alias("root"), F.col("parent").alias("higher"))
            found = found.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            found = ws.save(found, f"{name}-found{round_no}")
        for end in ("a", "b"):
            edges = edges.join(tree.select(F.col("node").alias(end), F.col("parent").alias(f"root_{end}")), end)
        edges = edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a != b").distinct()
        edges = ws.save(edges, f"{name}-edges{round_no}")
        round_no += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
