"""From a folder to a graph: files, mentions and facts, entities, relations; a written table after each stage."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import companies as c
from .operators import files as file_ops
from .operators import owner as owners
from .operators import relate, resolve, templates
from .sources import ingest
from .tables import Tables, partitions, ranked


@dataclass(frozen=True)
class Options:
    """What is known of a folder before it is read. An owner that is given goes before one that is found."""

    patterns: tuple[str, ...] = ()
    skip_directories: tuple[str, ...] = ()
    job_id: str | None = None
    owner: str | None = None
    types: dict[str, str] | None = None
    text_cap: int | None = None
    owner_domain: str | None = None
    generic_domains: tuple[str, ...] = t.GENERIC_DOMAINS


def extract_stage(files: DataFrame, tables: Tables, settings: templates.Settings) -> tuple[DataFrame, DataFrame]:
    """Mentions and facts of all files; copies are among them."""
    found = tables.save(templates.extract_files(files, settings), "extracted")
    mentions = templates.mention_rows(found)
    attached = templates.attachments(files, mentions)
    facts = templates.fact_rows(found)
    return mentions, facts.unionByName(attached.withColumn("id", F.col("file_id") * (1 << templates.FILE_BITS) + F.lit((1 << templates.FILE_BITS) - 1)).select(facts.columns))


def _surface_map(spelled: DataFrame) -> DataFrame:
    """``surface, company``: the company of each spelling that is no domain, by its most trusted reading."""
    return spelled.filter("not domain").groupBy("surface").agg(F.min("company").alias("company"))


def resolve_stage(mentions: DataFrame, facts: DataFrame, tables: Tables, owner: str | None = None, adjudicate: c.Adjudicator | None = None, generic: tuple[str, ...] = t.GENERIC_DOMAINS) -> tuple[DataFrame, DataFrame]:
    """Mentions with ``entity_id, method`` and their confidence, and the entities ``id, etype, name, key, attrs``."""
    spelled, named = c.companies(mentions, tables, owner, adjudicate, generic)
    named = tables.save(named, "companies")
    key = F.concat(F.lit("c"), F.col("company").cast("string"))
    of_company = mentions.filter("etype = 'company'").withColumns({"domain": F.col("attrs")["domain"].isNotNull(), "truncated": F.coalesce(F.col("attrs")["truncated"] == "1", F.lit(False))})
    decided = of_company.join(spelled, ["surface", "domain", "truncated"], "left").select("id", F.when(F.col("company").isNotNull(), key).alias("key"), F.coalesce("method", F.lit("generic_domain")).alias("method"), F.coalesce("score", F.lit(1.0)).alias("score"), "company")
    decided = tables.save(decided, "company-mentions")
    by_surface = _surface_map(spelled)

    # Projects: by job id; others by title, or the most similar one, within a customer, then by the file's folder, then
    # by a title that only one project has.
    project = mentions.filter("etype = 'project'").withColumn("customer", F.col("attrs")["customer"]).join(by_surface.withColumnRenamed("surface", "customer"), "customer", "left")
    project = project.select("id", "file_id", "role", "surface", "attrs", "company", F.col("attrs")["job_id"].alias("job"), t.title_key(F.coalesce(F.col("attrs")["title"], F.col("surface"))).alias("title"))
    known = resolve.projects(mentions).join(project.filter("job is not null").groupBy(F.col("job").alias("key")).agg(F.min_by("company", F.when(F.col("company").isNotNull(), F.col("id"))).alias("company"), F.max(F.when(F.col("role") == "folder", "1")).alias("folder")), "key", "left")
    known = tables.save(known.withColumn("title_key", t.title_key(F.coalesce("title", "key"))), "projects")
    in_company = known.filter("company is not null").groupBy(F.col("title_key").alias("title"), "company").agg(F.min("key").alias("by_company"), F.count("*").alias("n")).filter("n = 1").drop("n")
    alone = known.groupBy(F.col("title_key").alias("title")).agg(F.min("key").alias("by_title"), F.count("*").alias("n")).filter("n = 1").drop("n")
    open_titles = project.filter("job is null").select("title").join(known.select(F.col("title_key").alias("title")), "title", "left_anti")
    close = tables.save(resolve.similar_titles(open_titles, known.select(F.col("title_key").alias("title")), tables).select("title", "known"), "similar-titles")
    at_folder = project.filter("role = 'folder' and job is not null").groupBy("file_id").agg(F.min("job").alias("key")).join(known.select("key", "title_key", F.col("company").alias("folder_company")), "key")
    at_folder = at_folder.select("file_id", F.col("key").alias("folder_job"), F.col("title_key").alias("folder_title"), "folder_company")
    asked = project.join(close, "title", "left").withColumns({"own_title": F.col("title"), "title": F.coalesce("known", "title")}).join(at_folder, "file_id", "left")
    placed = asked.join(in_company, ["title", "company"], "left").join(alone, "title", "left")
    in_folder = F.when(F.col("folder_title") == F.col("title"), F.col("folder_job"))
    placed = placed.withColumn("by_folder", in_folder).withColumn("by_both", F.when(F.col("company") == F.col("folder_company"), in_folder)).withColumn("title", F.col("own_title"))
    titled = known.filter("folder = '1'").isEmpty()
    users = project.filter("job is null and title != ''").groupBy(F.col("title").alias("used_title"), F.col("company").alias("used_by")).agg(F.countDistinct("file_id").alias("users"))
    placed = placed.join(users, F.col("title").eqNullSafe(F.col("used_title")) & F.col("company").eqNullSafe(F.col("used_by")), "left")
    group = F.when(F.lit(titled) & (F.col("users") >= 2) & F.coalesce("by_folder", "by_title").isNull(), F.concat(F.lit("title:"), "title", F.lit("|"), F.coalesce(F.col("company").cast("string"), F.lit(""))))
    project_key = F.coalesce("job", "by_company", "by_both", "by_folder", "by_title", group)
    method = F.when(F.col("job").isNotNull(), "job_id").when(F.col("by_company").isNotNull(), "title+company").when(F.col("by_both").isNotNull(), "title+company+folder").when(F.col("by_folder").isNotNull(), "title+folder").when(F.col("by_title").isNotNull(), "unique_title").when(group.isNotNull(), "title_only").otherwise("unresolved")
    score = F.when(F.col("job").isNotNull(), F.when(F.col("role") == "folder", 1.0).otherwise(0.95)).when(F.coalesce("by_company", "by_both").isNotNull(), 0.9).when(F.coalesce("by_folder", "by_title").isNotNull(), 0.75).when(group.isNotNull(), 0.6).otherwise(0.0)
    placed = tables.save(placed.select("id", project_key.alias("key"), method.alias("method"), score.alias("score"), F.col("surface"), F.col("company")), "project-mentions")

    # People: their organisation is the company that they are said to work for.
    works = facts.filter("rel = 'WORKS_FOR'").select(F.col("src").alias("id"), F.col("dst").alias("company_mention"))
    employer = works.join(decided.select(F.col("id").alias("company_mention"), "company"), "company_mention").filter("company is not null").groupBy("id").agg(F.min("company").alias("employer"))
    person = mentions.filter("etype = 'person'").join(employer, "id", "left").withColumn("org", F.when(F.col("employer").isNotNull(), F.concat(F.lit("company "), F.col("employer").cast("string"))))
    person = person.withColumn("attrs", F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: k != "organisation"), F.map_filter(F.create_map(F.lit("organisation"), F.col("org")), lambda _, v: v.isNotNull())))
    owned = None if owner is None else named.filter("role = 'owner'").select("company").first()
    as_organisation = F.concat(F.lit("company "), F.col("company").cast("string"))
    folders = mentions.filter("etype = 'company' and role = 'folder'").select("id", "file_id").join(decided.filter("company is not null").select("id", as_organisation.alias("organisation")), "id")
    people = resolve.people(person.select(mentions.columns), folders, f"company {owned['company']}" if owned else None)
    trust = F.when(F.col("method") == "unique_name", 0.8).when(F.col("method") == "name+context", 0.7).otherwise(1.0)
    people = tables.save(people.withColumn("score", trust), "person-mentions")

    # Documents: by number; one that several counterparties use by number and counterparty.
    ends = facts.join(decided.filter("company is not null").select(F.col("id").alias("dst"), F.col("company").alias("dst_company")), "dst", "left").join(decided.filter("company is not null").select(F.col("id").alias("src"), F.col("company").alias("src_company")), "src", "left")
    stated = ends.select("id", "rel", F.when(F.col("rel") == "PARTY_TO", F.col("src_company")).otherwise(F.col("src")).alias("src"), F.when(F.col("rel") == "PARTY_TO", F.col("dst")).otherwise(F.col("dst_company")).alias("dst")).filter("src is not null and dst is not null")
    parties = resolve.counterparties(stated, owned["company"] if owned else None)
    documents = tables.save(resolve.documents(mentions, parties).withColumn("score", F.lit(1.0)), "document-mentions")
    products = mentions.filter("etype = 'product'").select("id", F.coalesce(F.col("attrs")["code"], "surface").alias("key"), F.lit("product_code").alias("method"), F.lit(1.0).alias("score"))

    columns = ["id", "key", "method", "score"]
    every = decided.select(columns).unionByName(placed.select(columns)).unionByName(people.select(columns)).unionByName(documents.select(columns)).unionByName(products)
    rows = tables.save(mentions.join(every, "id", "left"), "keyed-mentions")
    keys = rows.filter("key is not null").select("etype", "key").distinct()
    if owned:
        keys = keys.unionByName(rows.sparkSession.createDataFrame([("company", f"c{owned['company']}")], "etype string, key string")).distinct()
    ids = ranked(keys, tables, "entity-ids", F.col("etype"), F.col("key"))
    resolved = rows.join(ids.withColumnRenamed("id", "entity_id"), ["etype", "key"], "left").withColumn("confidence", F.round(F.col("confidence") * F.col("score"), 3))
    resolved = tables.save(resolved.select(*mentions.columns, "entity_id", "method"), "resolved")
    return resolved, _entities(resolved, ids, named, known, tables)


def _text_map(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[p for k, v in values.items() for p in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _entities(resolved: DataFrame, ids: DataFrame, named: DataFrame, known: DataFrame, tables: Tables) -> DataFrame:
    """Names and attributes of the entities, from their mentions."""
    used = resolved.filter("entity_id is not null")
    counted = used.groupBy("entity_id", "surface").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    common = counted.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("surface", F.struct("n", -F.col("first_id"))).alias("common"))
    base = ids.join(common, "id", "left")
    best = named.select(F.concat(F.lit("c"), F.col("company").cast("string")).alias("key"), F.col("name").alias("best"), F.col("key").alias("name_key"), "role", "domain")
    company = base.filter("etype = 'company'").join(best, "key", "left")
    project = base.filter("etype = 'project'").join(known.select("key", "title", "folder", "n_files"), "key", "left")
    document_names = [*("doc_type date total subtotal currency job_title subject revision valid_until expiry line_items unread".split())]
    merged = resolve.merged_attributes(used.filter("etype = 'document'"), document_names).withColumnRenamed("entity_id", "id")
    versions = used.filter("etype = 'document'").groupBy(F.col("entity_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set(F.col("attrs")["version"]))).alias("versions"), F.to_json(F.array_sort(F.collect_set(F.when(F.col("role") == "self", F.col("file_id"))))).alias("files"))
    document = base.filter("etype = 'document'").join(merged, "id", "left").join(versions, "id", "left")
    emails = used.filter("etype = 'person'").groupBy(F.col("entity_id").alias("id")).agg(*[F.to_json(F.array_sort(F.collect_set(F.col("attrs")[a]))).alias(a) for a in ("email", "phone", "job_title")])
    person = base.filter("etype = 'person'").join(emails, "id", "left")
    product_names = resolve.products(used).select("key", F.col("name").alias("described"))
    product = base.filter("etype = 'product'").join(product_names, "key", "left")
    parts = [
        company.select("id", "etype", F.coalesce("best", "common").alias("name"), F.coalesce("name_key", "key").alias("key"), _text_map(role=F.col("role"), domain=F.col("domain")).alias("attrs")),
        project.select("id", "etype", F.coalesce("title", "common", "key").alias("name"), "key", _text_map(job_id=F.when(~F.col("key").startswith("title:"), F.col("key")), folder=F.col("folder"), n_files=F.col("n_files")).alias("attrs")),
        document.select("id", "etype", F.coalesce("common", "key").alias("name"), "key", _text_map(**{a: F.col(a) for a in document_names}, versions=F.col("versions"), files=F.col("files"), conflicts=F.when(F.size("conflicts") > 0, F.to_json("conflicts"))).alias("attrs")),
        person.select("id", "etype", F.coalesce("common", "key").alias("name"), "key", _text_map(emails=F.col("email"), phones=F.col("phone"), job_titles=F.col("job_title")).alias("attrs")),
        product.select("id", "etype", F.coalesce("described", "common", "key").alias("name"), "key", _text_map(code=F.col("key")).alias("attrs")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return tables.save(out, "named-entities")


def relate_stage(files: DataFrame, mentions: DataFrame, facts: DataFrame, entities: DataFrame, tables: Tables, owner_key: str | None = None) -> None:
    """Write ``aliases, relations, relation_evidence, mentions, entities``: stated facts, names in texts, shortcuts; documents that
    nothing is linked to are dropped, those that are only referred to are marked as missing."""
    aliases = tables.save(relate.aliases(mentions), "aliases")
    stated = tables.save(relate.entity_facts(facts, mentions), "stated")
    names = relate.searchable_aliases(aliases, entities, owner_key)
    texts = files.filter("status = 'ok' and text is not null").select(F.col("id").alias("file_id"), "text")
    named = tables.save(relate.text_mentions(relate.gazetteer_mentions(texts, names), mentions, entities), "text-mentions")
    more = relate.link_gazetteer(named, mentions)
    mentions = mentions.unionByName(named)
    every = tables.save(stated.select("file_id", "src", "rel", "dst").unionByName(more.select("file_id", "src", "rel", "dst")), "all-facts")
    parts = partitions(tables.spark, every.count())
    edges = tables.save(relate.derive(relate.relations(every, parts), entities, every, parts), "edges")
    numbered = tables.save(ranked(edges, tables, "edge-ids", F.col("src"), F.col("dst"), F.col("rel")), "relations")
    tables.save(relate.evidence(every).join(numbered.select("src", "dst", "rel", F.col("id").alias("relation_id")), relate.EDGE).select("relation_id", "file_id"), "relation_evidence")
    orphans = relate.unlinked(entities, edges, "document").select("id")
    kept = entities.join(orphans, "id", "left_anti")
    missing = relate.missing_documents(kept, mentions).select("id", F.lit("1").alias("missing"))
    attrs = F.when(F.col("missing").isNotNull(), F.map_concat("attrs", F.map_from_arrays(F.array(F.lit("missing")), F.array("missing")))).otherwise(F.col("attrs"))
    tables.save(kept.join(missing, "id", "left").withColumn("attrs", attrs).drop("missing"), "entities")
    gone = mentions.join(orphans.withColumnRenamed("id", "entity_id").withColumn("gone", F.lit(True)), "entity_id", "left")
    pruned = gone.withColumn("method", F.when(F.col("gone"), "orphan").otherwise(F.col("method"))).withColumn("entity_id", F.when(F.col("gone").isNull(), F.col("entity_id")))
    tables.save(pruned.select(mentions.columns), "mentions")
    tables.save(aliases.join(orphans.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti"), "aliases-kept")


def build_from_files(files: DataFrame, out: str, options: Options | None = None, adjudicate: c.Adjudicator | None = None) -> Tables:
    """A graph's tables in the folder ``out`` from a files table: beside it first, and moved there when all are written."""
    options, spark, began = options or Options(), files.sparkSession, time.time()
    tables = Tables(spark, f"{out.rstrip('/')}.building-{uuid.uuid4().hex[:8]}")
    files = tables.save(files, "files")
    name, domain, reason = (options.owner, options.owner_domain, "given") if options.owner else owners.detect(files, options.generic_domains)
    settings = templates.Settings(types=templates.learned_types(files, options.types), job_id=options.job_id, owner=name)
    mentions, facts = extract_stage(files, tables, settings)
    facts = tables.save(facts, "facts")
    resolved, entities = resolve_stage(mentions, facts, tables, name, adjudicate, options.generic_domains)
    owner_key = None if name is None else (entities.filter("etype = 'company' and attrs['role'] = 'owner'").select("key").first() or [None])[0]
    relate_stage(files, resolved, facts, entities, tables, owner_key)
    meta = {"owner": name, "owner_domain": domain, "owner_reason": reason, "seconds": f"{time.time() - began:.1f}"}
    tables.save(spark.createDataFrame([(k, v) for k, v in meta.items()], "key string, value string"), "meta")
    return tables.install(out)


def build_graph(spark: SparkSession, root: str, out: str, options: Options | None = None, adjudicate: c.Adjudicator | None = None) -> Tables:
    """Read the folder ``root`` and write its graph to ``out``: tables files, mentions, facts, entities, aliases, relations, relation_evidence, meta."""
    options = options or Options()
    files = ingest.ingest(spark, root, list(options.patterns), list(options.skip_directories), options.text_cap)
    return build_from_files(file_ops.copy_text(files), out, options, adjudicate)


__all__ = ["Options", "build_from_files", "build_graph", "extract_stage", "relate_stage", "resolve_stage"]
