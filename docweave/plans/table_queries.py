"""Queries of single operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as t
from ..operators import extract, files, relate, resolve
from ..tables import Tables, ranked
from .star import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("new").alias("status"), "text", "source")


@query("SELECT doc_id AS id, nullif(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS duplicate_of FROM documents")
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.mark_duplicates(_document_files(spark, sf_dir)).select("id", "duplicate_of")


@query("""WITH f AS (SELECT doc_id AS id, sha256(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'new' END AS status, source FROM documents),
    d AS (SELECT *, nullif(min(id) OVER (PARTITION BY sha), id) AS duplicate_of FROM f)
    SELECT d.id, coalesce(o.status, d.status) AS status, coalesce(o.source, d.source) AS source FROM d LEFT JOIN f o ON o.id = d.duplicate_of""")
def copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.copy_text(files.mark_duplicates(_document_files(spark, sf_dir)), ("status", "source", "text")).select("id", "status", "source")


@query(r"""SELECT lower(d) AS domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)) AS d FROM documents) GROUP BY ALL""")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select(F.explode(t.email_domains(F.col("text"))).alias("domain"))
    return found.groupBy("domain").agg(F.count("*").alias("n"))


@query(r"""SELECT domain, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1))) AS domain FROM documents)
    WHERE domain NOT IN (SELECT unnest(string_split('{generic}', ' ')))
    GROUP BY domain ORDER BY n_docs DESC, domain LIMIT 1""".replace("{generic}", " ".join(t.GENERIC_DOMAINS)))
def owner_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(t.email_domains(F.col("text"))).alias("domain")).distinct()
    found = found.filter(~t.is_generic_domain(F.col("domain"))).groupBy("domain").agg(F.count("*").alias("n_docs"))
    return found.orderBy(F.desc("n_docs"), "domain").limit(1)


@query("SELECT d.doc_id AS file_id, b.item_id AS entity_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    names = read(spark, sf_dir, "benchmark").select(F.col("text").alias("alias"), F.col("item_id").alias("entity_id"))
    return relate.gazetteer_mentions(texts, names, longest=False).select("file_id", "entity_id").distinct()


@query("SELECT event_type, sum(CAST(props ->> '$.k' AS BIGINT)) AS total, count(props ->> '$.k') AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


@query("SELECT event_type || ':' || CAST(user_id % 3 AS VARCHAR) AS kind, count(*) AS n FROM events GROUP BY ALL")
def stats_by_type_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.concat_ws(":", "event_type", F.col("user_id") % 3).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def page_host_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages")
def references_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target"))


def _order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mentions of their customer, with price and priority as attributes."""
    attrs = F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), attrs.alias("attrs"))


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS conflict_values
    FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.merged_attributes(_order_mentions(spark, sf_dir), ["priority"], ("priority",)).withColumn("v", F.col("conflicts")["priority"]).filter("v is not null")
    return found.select(F.col("entity_id").alias("o_custkey"), F.size("v").cast("long").alias("n_values"), F.array_join("v", "|").alias("conflict_values"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS total, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL")
def first_value_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.merged_attributes(_order_mentions(spark, sf_dir), ["total", "priority"], ("priority",))
    return found.select(F.col("entity_id").alias("o_custkey"), F.col("total").cast("double").alias("total"), "priority")


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY ALL)
    SELECT p_brand, p_name || ' ' || p_brand AS name, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY c.n DESC, first_id) = 1""")
def product_modal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("code"), F.col("p_brand"), F.lit("description"), F.col("p_name"))
    mentions = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("product").alias("etype"), F.col("p_name").alias("surface"), attrs.alias("attrs"))
    return resolve.products(mentions).select(F.col("key").alias("p_brand"), "name", "n")


@query(r"""WITH k AS (SELECT trim(regexp_replace(lower(unnest([text, role || ' turn ' || turn])), '[^a-z0-9]+', ' ', 'g')) AS title, conv_id FROM conversations)
    SELECT title, count(DISTINCT conv_id) AS n_files FROM k WHERE title <> '' GROUP BY title HAVING count(DISTINCT conv_id) >= 2""")
def title_groups_min_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in a turn, whole, and who speaks in which turn, as titles of the conversations: those of two or more."""
    attrs, spoken = F.lit(None).cast("map<string,string>"), F.explode(F.array("text", F.concat_ws(" ", F.initcap("role"), F.lit("turn"), "turn")))
    mentions = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.lit("project").alias("etype"), spoken.alias("surface"), attrs.alias("attrs"))
    return resolve.title_only_projects(mentions).select("title", "n_files")


@query("""WITH k AS (SELECT trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS title, page_id FROM pages)
    SELECT title, count(DISTINCT page_id) AS n_files FROM k WHERE title <> '' GROUP BY title HAVING count(DISTINCT page_id) >= 2""")
def page_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that several pages have."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    attrs = F.create_map(F.lit("title"), title)
    mentions = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("project").alias("etype"), title.alias("surface"), attrs.alias("attrs"))
    return resolve.title_only_projects(mentions).select("title", "n_files")


@query("""SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations""")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), Tables(spark), "ids", F.col("conv_id"), F.col("turn"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def collapse_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.collapse_spaces(F.col("text")).alias("flat"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z]+', ' ', 'g')) AS key FROM supplier")
def person_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", t.person_key(F.col("s_name")).alias("key"))


@query("""SELECT c_custkey, 'The ' || replace(c_name, '#', ' & Söhne ') || CASE c_custkey % 3 WHEN 0 THEN ' Co. Ltd' WHEN 1 THEN ' GmbH' ELSE '' END AS name,
    lower(replace(c_name, '#', ' soehne ')) AS key FROM customer""")
def company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name, with an article, an umlaut and legal suffixes, as a key."""
    suffix = F.when(F.col("c_custkey") % 3 == 0, " Co. Ltd").when(F.col("c_custkey") % 3 == 1, " GmbH").otherwise("")
    name = F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" & Söhne ")), suffix)
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), t.company_key(name).alias("key"))


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS amount, CASE c_nationkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency FROM customer")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's balance, written as three countries write it, read back."""
    plain = F.format_number(F.abs("c_acctbal"), 2)
    comma = F.translate(plain, ",.", ".,")
    text = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("Total £"), plain)).when(F.col("c_nationkey") % 3 == 1, F.concat(comma, F.lit(" €"))).otherwise(F.concat(F.lit("USD "), plain))
    return read(spark, sf_dir, "customer").select("c_custkey", t.money(text).alias("amount"), t.currency(text).alias("currency"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CASE o_orderkey % 4 WHEN 0 THEN 'INV-' WHEN 1 THEN 'HR-' ELSE 'QUO-12-' END || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS number FROM orders")
def doc_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's number after a label, in four ways of writing; a number without a label is none."""
    digits, way = F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.col("o_orderkey") % 4
    text = F.when(way == 0, F.concat(F.lit("Re Invoice No: INV-"), digits, F.lit(" of today"))).when(way == 1, F.concat(F.lit("invoice # HR-"), digits)).when(way == 2, F.concat(F.lit("Invoice QUO-12-"), digits)).otherwise(F.concat(F.lit("INV-"), digits))
    return read(spark, sf_dir, "orders").select("o_orderkey", extract.own_number(text, "Invoice").alias("number"))


def _benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word") >= 4).distinct()


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark), l AS (SELECT word FROM w WHERE length(word) >= 4)
    SELECT a.word AS a, b.word AS b, CAST(1 AS BIGINT) AS d FROM l a JOIN l b ON a.word[:3] = b.word[:3] AND a.word < b.word WHERE damerau_levenshtein(a.word, b.word) = 1""")
def osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all items that begin alike and are one letter apart, a swap of neighbours being one too."""
    distance = F.pandas_udf(lambda a, b: a.combine(b, names.edit_distance), "long")
    words = _benchmark_words(spark, sf_dir).withColumn("start", F.substring("word", 1, 3))
    pairs = words.withColumnRenamed("word", "a").join(words.withColumnRenamed("word", "b"), "start").filter("a < b")
    return pairs.select("a", "b", distance("a", "b").alias("d")).filter("d = 1")


def lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all items that begin alike, and how alike they are; its test works every row out by hand."""
    words = _benchmark_words(spark, sf_dir).withColumn("start", F.substring("word", 1, 3))
    pairs = words.withColumnRenamed("word", "a").join(words.withColumnRenamed("word", "b"), "start").filter("a < b")
    return pairs.select("a", "b", names.lcs_ratio("a", "b").alias("r"))


def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of all pages without their middle letter, and the known title that is most like each; its test compares all with all."""
    title = t.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    known = read(spark, sf_dir, "pages").select(title.alias("title")).filter("title != ''").distinct()
    half = F.floor(F.length("title") / 2).cast("int")
    asked = known.select(F.concat(F.substring("title", F.lit(1), half), F.substring("title", half + 2, F.length("title"))).alias("title")).filter("title != ''").distinct()
    return resolve.similar_titles(asked, known)


QUERIES["lcs_ratio"], QUERIES["similar_titles"] = lcs_ratio, similar_titles
