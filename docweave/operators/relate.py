"""From facts between mentions to weighted relations between entities."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import spread

EDGE = ["src", "dst", "rel"]
#: Relations that are derived.
SHORTCUTS = ("INVOLVED_IN", "USES_PRODUCT", "PURCHASED_OR_QUOTED")


def entity_facts(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """``file_id, src, rel, dst`` between entities, of facts whose two mentions are both resolved."""
    known = mentions.filter("entity_id is not null").select("id", "entity_id")
    ends = facts.select("file_id", F.col("src").alias("src_mention"), "rel", F.col("dst").alias("dst_mention"))
    for end in ("src", "dst"):
        ends = ends.join(known.select(F.col("id").alias(f"{end}_mention"), F.col("entity_id").alias(end)), f"{end}_mention")
    return ends.select("file_id", "src", "rel", "dst")


def evidence(facts: DataFrame) -> DataFrame:
    """``src, dst, rel, file_id``: each file that states a relation, once; links to itself are no relations."""
    return facts.filter("src != dst").select(*EDGE, "file_id").distinct()


def relations(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """``src, dst, rel, weight, derived``: a stated relation weighs as many as the distinct files that state it.
    ``parts``, here and below, is the number of partitions of what is shuffled, Spark's own if not given."""
    return evidence(spread(facts.select(*EDGE, "file_id"), parts, "src", "dst")).groupBy(*EDGE).agg(F.count("*").alias("weight")).withColumn("derived", F.lit(0))


def _pairs(left: DataFrame, right: DataFrame, document: tuple[str, str], ends: tuple[str, str], rel: str, parts: int | None) -> DataFrame:
    """Pairs of relations, which ``left`` and ``right`` may repeat, that share a document, counted by their other ends. Dealt by the document,
    relations are made distinct and joined where they are."""
    once = lambda side, key: spread(side.filter("src != dst").select(*EDGE), parts, key).distinct()
    a, b = once(left, document[0]).alias("a"), once(right, document[1]).alias("b")
    joined = a.join(b, F.col(f"a.{document[0]}") == F.col(f"b.{document[1]}")).select(F.col(f"a.{ends[0]}").alias("src"), F.col(f"b.{ends[1]}").alias("dst"))
    return spread(joined, parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("rel", F.lit(rel))


def involved_in(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """A person who wrote, sent or received a project's document is involved in the project.
    ``edges``, here and in the next two, are relations, or the facts behind them, which may repeat."""
    acts = edges.filter(F.col("rel").isin("AUTHORED", "SENT", "RECEIVED"))
    return _pairs(acts, edges.filter("rel = 'HAS_DOCUMENT'"), ("dst", "dst"), ("src", "src"), "INVOLVED_IN", parts)


def uses_product(edges: DataFrame, entities: DataFrame, parts: int | None = None) -> DataFrame:
    """A project uses the products that its documents list or describe."""
    products = entities.filter("etype = 'product'").select(F.col("id").alias("dst"))
    listed = edges.filter(F.col("rel").isin("LISTS_PRODUCT", "DESCRIBES")).join(products, "dst", "left_semi")
    return _pairs(edges.filter("rel = 'HAS_DOCUMENT'"), listed, ("dst", "src"), ("src", "dst"), "USES_PRODUCT", parts)


def purchased_or_quoted(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """A company bought, or was quoted, the products that documents issued to it list."""
    return _pairs(edges.filter("rel = 'ISSUED_TO'"), edges.filter("rel = 'LISTS_PRODUCT'"), ("src", "src"), ("dst", "dst"), "PURCHASED_OR_QUOTED", parts)


def derive(edges: DataFrame, entities: DataFrame, facts: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Stated relations and the shortcuts derived from them, which weigh as many as the pairs of
    relations behind them; a shortcut that is stated already is not added. With the ``facts`` behind the relations,
    shortcuts are sought in these, so that no relation is counted before."""
    behind = edges if facts is None else facts
    found = involved_in(behind, parts).unionByName(uses_product(behind, entities, parts)).unionByName(purchased_or_quoted(behind, parts))
    stated = behind.filter(F.col("rel").isin(*SHORTCUTS) & (F.col("src") != F.col("dst"))).select(*EDGE)
    new = found.join(stated, EDGE, "left_anti").withColumn("derived", F.lit(1))
    return edges.unionByName(new.select(edges.columns))


#: Entities that are sent to every task.
FEW = 100_000


def touching(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with an end among ``ids`` (``id``, distinct). Ids counted as few are sent to the tasks, so that no fact is shuffled to find them."""
    few = len(ids.limit(FEW + 1).collect()) <= FEW
    for end in ("src", "dst"):
        marks = ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        facts = facts.join(F.broadcast(marks) if few else marks, end, "left")
    return facts.filter(F.col("_src").isNotNull() | F.col("_dst").isNotNull()).drop("_src", "_dst")


def around(facts: DataFrame, entities: DataFrame, center: int) -> DataFrame:
    """The relations, stated and derived, that touch one entity. A derived one rests on a document that a stated one links to
    the entity, so the facts that touch the entity's neighbours give all of them with their whole weights."""
    own = facts.filter((F.col("src") == center) | (F.col("dst") == center))
    near = own.select(F.explode(F.array("src", "dst", F.lit(center).cast("long"))).alias("id")).distinct()
    found = derive(relations(touching(facts, near)), entities)
    return found.filter((F.col("src") == center) | (F.col("dst") == center))


def unlinked(entities: DataFrame, edges: DataFrame, etype: str) -> DataFrame:
    """Entities of a type that no relation touches."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return entities.filter(F.col("etype") == etype).join(touched, "id", "left_anti")


def missing_documents(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents that are referred to but that no file is, that is without a mention in the role ``self``."""
    own = mentions.filter("role = 'self' and entity_id is not null").select(F.col("entity_id").alias("id")).distinct()
    return entities.filter("etype = 'document'").join(own, "id", "left_anti")


def aliases(mentions: DataFrame) -> DataFrame:
    """``entity_id, alias, method, confidence, count``: an entity's spellings, each with its most
    frequent method (the smallest of several) and its mean confidence."""
    known = mentions.filter("entity_id is not null")
    return known.groupBy("entity_id", F.col("surface").alias("alias")).agg(
        F.mode("method", deterministic=True).alias("method"), F.round(F.avg("confidence"), 3).alias("confidence"), F.count("*").alias("count")
    )


def searchable_aliases(names: DataFrame, entities: DataFrame, owner_key: str | None = None, min_length: int = 6) -> DataFrame:
    """``alias, entity_id`` that point to one company or person alone: long enough, with fewer than two dots, not the owner."""
    kinds = entities.filter(F.col("etype").isin("company", "person"))
    if owner_key is not None:
        kinds = kinds.filter(F.col("key") != owner_key)
    found = names.filter((F.length("alias") >= min_length) & ~F.col("alias").like("%.%.%")).join(kinds.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return found.groupBy("alias").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("most")).filter("entity_id = most").drop("most")


# Between a text's tokens: runs of letters and digits, and every other character by itself.
_BETWEEN = r"(?<![\p{L}\p{N}_])|(?![\p{L}\p{N}_])"


#: Aliases, and their bytes, that are sent to every task.
LOOKUP_NAMES, LOOKUP_BYTES = 100_000, 8 << 20


def _word(character: str) -> bool:
    return character.isalnum() or character == "_"


def _apart(hits: list[tuple[int, int]]) -> list[int]:
    """Numbers of the ``(start, end)`` that stay: the leftmost, of several the longest, and on from its end; equal ones all."""
    order, kept, free, last = sorted(range(len(hits)), key=lambda i: (hits[i][0], -hits[i][1])), [], 0, None
    for i in order:
        if hits[i] == last or hits[i][0] >= free:
            kept.append(i)
            last, free = hits[i], hits[i][1]
    return kept


def _looked_up(texts: DataFrame, names: list[tuple[str, int]], longest: bool) -> DataFrame:
    """Occurrences of a bounded list of aliases: one automaton with failure links finds all of them in one pass over a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities: dict[str, list[int]] = {}
        for alias, entity_id in names:
            if alias:
                entities.setdefault(alias, []).append(entity_id)
        automaton = ahocorasick.Automaton()
        for alias in entities:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for file_id, text in zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or not entities:
                    continue
                found, aliases = [], []
                for last, alias in automaton.iter(text):
                    at, end = last + 1 - len(alias), last + 1
                    if at and _word(text[at]) and _word(text[at - 1]) or end < len(text) and _word(text[end]) and _word(text[last]):
                        continue  # within a word
                    found.append((at, end))
                    aliases.append(alias)
                for i in _apart(found) if longest else range(len(found)):
                    rows += [(file_id, e, aliases[i], found[i][0]) for e in entities[aliases[i]]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["file_id", "entity_id", "alias", "start"])

    return texts.select(F.col("file_id").cast("long"), "text").mapInArrow(run, "file_id long, entity_id long, alias string, start int")


def _without_overlaps(hits: DataFrame) -> DataFrame:
    """Of the occurrences in each file the leftmost and longest that do not overlap; a task holds one file's."""

    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        spans = [(at, at + len(alias)) for at, alias in zip(rows.column("start").to_pylist(), rows.column("alias").to_pylist(), strict=True)]
        return rows.take(pa.array(_apart(spans), pa.int64()))

    return hits.groupBy("file_id").applyInArrow(run, hits.schema)


def gazetteer_mentions(texts: DataFrame, names: DataFrame, longest: bool = True) -> DataFrame:
    """``file_id, entity_id, alias, start`` for each whole-word, case-sensitive occurrence of an alias in
    ``file_id, text``, ``start`` being its first character's place. Occurrences are read from left to right, the longest of those that begin at one place,
    and the next one begins after its end; an alias of several entities is reported for each (``searchable_aliases`` gives unique ones).
    Without ``longest``, all occurrences are reported, overlapping ones too.

    Aliases counted as few are sent to the tasks, which find them all in one pass over a text. More aliases meet the texts in an equi-join of their first one to three tokens; only where they meet is the whole
    alias compared. No pattern of all aliases and no pair of every text and alias is made.
    """
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("alias")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= LOOKUP_NAMES and size["bytes"] <= LOOKUP_BYTES:
        return _looked_up(texts, [tuple(r) for r in names.select("alias", F.col("entity_id").cast("long")).distinct().collect()], longest)
    words = lambda c: F.filter(F.split(c, _BETWEEN), lambda x: x != "")
    keyed = names.select("alias", "entity_id", words(F.col("alias")).alias("own")).withColumn("n", F.size("own")).filter("n > 0")
    keyed = keyed.select("alias", "entity_id", "n", F.array_join(F.slice("own", 1, 3), "").alias("head"), F.least("n", F.lit(3)).alias("k"))
    parts = texts.select("file_id", words(F.col("text")).alias("parts")).filter(F.size("parts") > 0)
    heads = parts.select(
        "file_id",
        F.expr(
            "inline(flatten(transform(sequence(0, size(parts) - 1), i -> transform(array(1, 2, 3), k -> struct(i as start, k as k, array_join(slice(parts, i + 1, k), '') as head)))))"
        ),
    )
    met = heads.join(keyed, ["head", "k"]).join(parts, "file_id")
    hits = met.filter(F.array_join(F.slice("parts", F.col("start") + 1, F.col("n")), "") == F.col("alias"))
    place = F.aggregate(F.slice("parts", F.lit(1), F.col("start")), F.lit(0), lambda n, x: n + F.length(x))
    hits = hits.select(F.col("file_id").cast("long"), F.col("entity_id").cast("long"), "alias", place.alias("start"))
    return _without_overlaps(hits) if longest else hits


# Fixed value: how sure a name found in a text is.
GAZETTEER_CONFIDENCE = 0.6


def text_mentions(hits: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions, resolved by method ``gazetteer``, of what a file's text names and no mention of the file has yet: one for each entity, under
    the first of its names found. Only files that are a document have them; they come after the file's other mentions."""
    own = mentions.groupBy("file_id").agg(F.max("pos").alias("last"), F.max("id").alias("last_id"), F.max((F.col("role") == "self") & F.col("entity_id").isNotNull()).alias("is_document")).filter("is_document")
    linked = mentions.filter("entity_id is not null").select("file_id", "entity_id").distinct()
    new = hits.groupBy("file_id", "entity_id").agg(F.min("alias").alias("surface")).join(linked, ["file_id", "entity_id"], "left_anti").join(own, "file_id")
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("surface", "entity_id"))
    rows = new.withColumn("nth", nth).join(entities.select(F.col("id").alias("entity_id"), "etype"), "entity_id")
    values = {"id": F.col("last_id") + F.col("nth"), "pos": F.col("last") + F.col("nth"), "role": F.lit("text_mention"), "confidence": F.lit(GAZETTEER_CONFIDENCE), "method": F.lit("gazetteer")}
    known = {"file_id", "etype", "surface", "entity_id"}
    return rows.select(*[(values[f.name] if f.name in values else F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in mentions.schema.fields])


def link_gazetteer(named: DataFrame, mentions: DataFrame) -> DataFrame:
    """MENTIONS facts from a file's own document to what ``text_mentions`` found in it."""
    own = mentions.filter("role = 'self' and entity_id is not null").select("file_id", F.col("entity_id").alias("src")).distinct()
    return named.select("file_id", F.col("entity_id").alias("dst")).join(own, "file_id").filter("src != dst").select("file_id", "src", F.lit("MENTIONS").alias("rel"), "dst")
