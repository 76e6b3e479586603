"""Questions to a built graph, each answered by a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .tables import Tables

#: The rules behind derived relations, in words.
RULES = {
    "INVOLVED_IN": "wrote, sent or received a document of the project",
    "USES_PRODUCT": "a document of the project lists or describes the product",
    "PURCHASED_OR_QUOTED": "a document issued to the company lists the product",
}
#: Nodes that a graph draws, hops and paths of a connection, files behind a relation, entities of a page.
NODES, HOPS, PATHS, FILES, PAGE = 70, 4, 5, 400, 100


class Graph:
    """The tables that ``build.build_graph`` wrote to a folder."""

    def __init__(self, spark: SparkSession, root: str):
        tables = Tables(spark, root)
        self.spark = spark
        self.files, self.mentions, self.entities, self.edges, self.evidence, self.meta = (
            tables.read(name) for name in ("files", "mentions", "entities", "relations", "relation_evidence", "meta")
        )
        self.aliases = tables.read("aliases").join(self.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")

    def stats(self) -> DataFrame:
        """``part, kind, n``: entities by type, files by status, resolved mentions by type and method, all mentions and relations."""
        count = lambda df, part, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
        method = F.concat_ws(":", "etype", "method")
        out = count(self.entities, "entities", F.col("etype")).unionByName(count(self.files, "files", F.col("status")))
        out = out.unionByName(count(self.mentions.filter("method is not null"), "methods", method))
        for name, table in (("mentions", self.mentions), ("resolved", self.mentions.filter("entity_id is not null")), ("relations", self.edges)):
            out = out.unionByName(count(table, "totals", F.lit(name)))
        return out

    def search(self, etype: str | None = None, text: str | None = None, doc_type: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
        """A page of matching entities with their summaries, the best connected first, and ``total``, how many match."""
        found = graph.matching(self.entities, self.aliases, etype, text, doc_type)
        total = found.agg(F.count("*").alias("total"))
        page = graph.search(self.entities, self.edges, self.aliases, limit, offset, etype=etype, text=text, doc_type=doc_type)
        return self._summary(page).join(F.broadcast(total)).orderBy(F.desc("degree"), "name", "id")

    def _summary(self, rows: DataFrame) -> DataFrame:
        """``id, etype, name, key, subtitle, missing, degree``: what a list shows of an entity."""
        attr = lambda name: F.col("attrs")[name]
        subtitle = (
            F.when(F.col("etype") == "company", F.coalesce(attr("role"), attr("domain"))).when(F.col("etype") == "document", F.concat_ws(" · ", attr("doc_type"), attr("date")))
            .when(F.col("etype") == "project", attr("job_id")).when(F.col("etype") == "product", attr("code")).otherwise(F.get_json_object(attr("emails"), "$[0]"))
        )
        return rows.select("id", "etype", "name", "key", subtitle.alias("subtitle"), attr("missing").isNotNull().alias("missing"), "degree")

    def entity(self, entity_id: int) -> dict[str, DataFrame]:
        """An entity's card: itself, what it is related to in both directions, its sources, its spellings, its employer or customer."""
        own = self.entities.filter(F.col("id") == entity_id)
        company = graph.related(entity_id, self.entities, self.edges).filter("etype = 'company' and rel in ('WORKS_FOR', 'HAS_PROJECT')").select("id", "name").limit(1)
        return {
            "entity": graph.with_degree(own, self.edges),
            "related": graph.related(entity_id, self.entities, self.edges),
            "sources": graph.sources(entity_id, self.mentions, self.files, FILES),
            "aliases": self.aliases.filter(F.col("entity_id") == entity_id).orderBy(F.desc("count"), "alias"),
            "company": company,
        }

    def neighbourhood(self, center: int | None = None, depth: int = 1, limit: int = NODES, types: list[str] | None = None, derived: bool = True) -> dict[str, DataFrame]:
        """Nodes and relations to draw and, around a centre, how many neighbours are left out; without a centre, companies and their projects."""
        if center is None:
            nodes = graph.overview(self.entities, self.edges)
            edges = graph.relations_among(nodes, self.edges.filter("rel = 'HAS_PROJECT'"))
            return {"nodes": self.entities.join(nodes, "id", "left_semi"), "edges": edges}
        drawn = graph.neighbourhood(center, self.edges, self.entities, min(depth, 2), limit, types, derived)
        edges = self.edges if derived else self.edges.filter("derived = 0")
        return {
            "nodes": self.entities.join(drawn, "id"),
            "edges": graph.relations_among(drawn, edges),
            "hidden": graph.hidden_groups(center, drawn, edges, self.entities),
        }

    def explain_relation(self, relation_id: int) -> dict[str, DataFrame]:
        """A relation, the files that state it with their mentions of both ends, and for a derived one its rule and the documents behind it."""
        row = self.edges.filter(F.col("id") == relation_id).first()
        if row is None:
            raise KeyError(relation_id)
        stated = self.evidence.join(self.edges.withColumnRenamed("id", "relation_id"), "relation_id")
        files = graph.relation_evidence(row["src"], row["dst"], row["rel"], stated, self.mentions, self.files, FILES)
        grouped = files.groupBy("file_id", "path").agg(F.sort_array(F.collect_list(F.struct("entity_id", "surface", "role"))).alias("mentions")).orderBy("path")
        out = {"relation": self.edges.filter(F.col("id") == relation_id).withColumn("rule", F.lit(RULES.get(row["rel"]))), "files": grouped}
        if row["derived"]:
            out["via"] = graph.via(row["src"], row["dst"], row["rel"], self.edges, self.entities)
        return out

    def connection(self, start: int, goal: int) -> DataFrame:
        """The shortest paths between two entities, not through the owner."""
        avoid = [r["id"] for r in graph.owners(self.entities).select("id").collect()]
        return graph.shortest_paths(start, goal, self.edges, avoid, HOPS, PATHS)

    def spellings(self, text: str) -> DataFrame:
        """All spellings of the entity that a text names best."""
        return self.aliases.join(graph.best_match(text, self.entities, self.aliases).select(F.col("id").alias("entity_id"), "name"), "entity_id").orderBy(F.desc("count"), "alias")

    def file(self, file_id: int) -> dict[str, DataFrame]:
        """A file's row and its mentions with the entities that they are."""
        return {"file": self.files.filter(F.col("id") == file_id), "mentions": graph.file_mentions(file_id, self.mentions, self.entities)}

    def related(self, entity_id: int, rel: str | None = None, etype: str | None = None, limit: int = 50) -> DataFrame:
        """Related entities of one relation, without regard to its case, and type."""
        where: Column = F.lit(True)
        if rel is not None:
            where = where & (F.upper("rel") == rel.upper())
        if etype is not None:
            where = where & (F.col("etype") == etype)
        return graph.related(entity_id, self.entities, self.edges).filter(where).limit(limit)

    def preset(self, name: str) -> DataFrame:
        """Answers to standing questions: ``entities`` by type, ``customers``, ``people`` by degree, ``owner``."""
        if name == "entities":
            return self.entities.groupBy("etype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "etype")
        if name == "customers":
            return self._summary(graph.with_degree(graph.customers(self.entities, self.edges), self.edges)).orderBy(F.desc("degree"), "name")
        if name == "people":
            return self.search("person", limit=PAGE)
        if name == "owner":
            return graph.owners(self.entities).join(F.broadcast(self.meta.filter("key = 'owner_reason'").select(F.col("value").alias("reason"))), how="left")
        raise KeyError(name)
