"""The driver's star schema as a document graph: orders are documents, customers companies, parts products,
suppliers people and nations projects. Ids of the five types end in different digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import partitions

COMPANY, DOCUMENT, PRODUCT, PERSON, PROJECT = 1, 2, 3, 4, 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(key: str, kind: int) -> Column:
    return F.col(key).cast("long") * 10 + kind


def is_a(column: str, kind: int) -> Column:
    """Whether an id is of that type, by its last digit; of facts it is tested before they are shuffled."""
    return F.col(column) % 10 == kind


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for all facts."""
    orders, lines, customers = (read(spark, sf_dir, t).count() for t in ("orders", "lineitem", "customer"))
    return partitions(spark, 2 * orders + 2 * lines + customers)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, label: str, kind: int, etype: str, attrs: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("map<string,string>")
        return read(spark, sf_dir, name).select(
            entity(key, kind).alias("id"), F.lit(etype).alias("etype"), F.col(label).cast("string").alias("name"), F.col(key).cast("string").alias("key"), (none if attrs is None else attrs).alias("attrs")
        )

    orders = F.create_map(F.lit("doc_type"), F.when(F.col("o_orderstatus") == "F", "invoice").otherwise("quote"))
    folder = F.create_map(F.lit("folder"), F.when(F.col("n_regionkey") < 3, "1").otherwise("0"))
    return (
        of("customer", "c_custkey", "c_name", COMPANY, "company")
        .unionByName(of("orders", "o_orderkey", "o_orderkey", DOCUMENT, "document", orders))
        .unionByName(of("part", "p_partkey", "p_name", PRODUCT, "product"))
        .unionByName(of("supplier", "s_suppkey", "s_name", PERSON, "person"))
        .unionByName(of("nation", "n_nationkey", "n_name", PROJECT, "project", folder))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, src, rel, dst``; the order is the file, a customer's project is stated by the customer's own file."""
    orders, lines, customers = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    doc, order = entity("o_orderkey", DOCUMENT), entity("l_orderkey", DOCUMENT)
    nations = customers.select("c_custkey", "c_nationkey")
    filed = orders.join(nations, F.col("o_custkey") == F.col("c_custkey"))
    fact = lambda df, file, src, rel, dst: df.select(F.col(file).alias("file_id"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    return (
        fact(orders, "o_orderkey", doc, "ISSUED_TO", entity("o_custkey", COMPANY))
        .unionByName(fact(lines, "l_orderkey", order, "LISTS_PRODUCT", entity("l_partkey", PRODUCT)))
        .unionByName(fact(lines, "l_orderkey", entity("l_suppkey", PERSON), "AUTHORED", order))
        .unionByName(fact(filed, "o_orderkey", entity("c_nationkey", PROJECT), "HAS_DOCUMENT", doc))
        .unionByName(fact(nations, "c_custkey", entity("c_custkey", COMPANY), "HAS_PROJECT", entity("c_nationkey", PROJECT)))
    )


#: The same tables in SQL, as the first of a query's common table expressions.
SQL = """
    entities AS (
        SELECT c_custkey * 10 + 1 AS id, 'company' AS etype, c_name AS name, CAST(c_custkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS attr FROM customer
        UNION ALL SELECT o_orderkey * 10 + 2, 'document', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN 'invoice' ELSE 'quote' END FROM orders
        UNION ALL SELECT p_partkey * 10 + 3, 'product', p_name, CAST(p_partkey AS VARCHAR), NULL FROM part
        UNION ALL SELECT s_suppkey * 10 + 4, 'person', s_name, CAST(s_suppkey AS VARCHAR), NULL FROM supplier
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 5, 'project', n_name, CAST(n_nationkey AS VARCHAR), CASE WHEN n_regionkey < 3 THEN '1' ELSE '0' END FROM nation),
    facts AS (
        SELECT o_orderkey AS file_id, o_orderkey * 10 + 2 AS src, 'ISSUED_TO' AS rel, o_custkey * 10 + 1 AS dst FROM orders
        UNION ALL SELECT l_orderkey, l_orderkey * 10 + 2, 'LISTS_PRODUCT', l_partkey * 10 + 3 FROM lineitem
        UNION ALL SELECT l_orderkey, l_suppkey * 10 + 4, 'AUTHORED', l_orderkey * 10 + 2 FROM lineitem
        UNION ALL SELECT o_orderkey, CAST(c_nationkey AS BIGINT) * 10 + 5, 'HAS_DOCUMENT', o_orderkey * 10 + 2 FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT c_custkey, c_custkey * 10 + 1, 'HAS_PROJECT', CAST(c_nationkey AS BIGINT) * 10 + 5 FROM customer),
    relations AS (SELECT src, dst, rel, count(DISTINCT file_id) AS weight, 0 AS derived FROM facts WHERE src <> dst GROUP BY ALL),
    derived AS (
        SELECT a.src, b.src AS dst, 'INVOLVED_IN' AS rel, count(*) AS weight FROM relations a JOIN relations b ON a.dst = b.dst
            WHERE a.rel IN ('AUTHORED', 'SENT', 'RECEIVED') AND b.rel = 'HAS_DOCUMENT' GROUP BY ALL
        UNION ALL SELECT a.src, b.dst, 'USES_PRODUCT', count(*) FROM relations a JOIN relations b ON a.dst = b.src
            WHERE a.rel = 'HAS_DOCUMENT' AND b.rel IN ('LISTS_PRODUCT', 'DESCRIBES') GROUP BY ALL
        UNION ALL SELECT a.dst, b.dst, 'PURCHASED_OR_QUOTED', count(*) FROM relations a JOIN relations b ON a.src = b.src
            WHERE a.rel = 'ISSUED_TO' AND b.rel = 'LISTS_PRODUCT' GROUP BY ALL),
    edges AS (SELECT * FROM relations UNION ALL SELECT src, dst, rel, weight, 1 FROM derived),
    adjacency AS (SELECT src AS node, dst AS other, rel, weight, derived, 'out' AS dir FROM edges UNION ALL SELECT dst, src, rel, weight, derived, 'in' FROM edges),
    degree AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY id)"""
