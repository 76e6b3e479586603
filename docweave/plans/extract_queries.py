"""Extraction and company resolution over the driver's tables: rows laid out as files, and names in many spellings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..operators import companies, resolve, templates
from ..operators import files as ops
from ..tables import Tables
from .star import read

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = templates.Settings()
FILE = "id long, path string, parent_id long, sha256 string, kind string, status string, text string"


def _as_files(rows: DataFrame, number: Column, path: Column, kind: Column | str, text: Column, patterns: Sequence[str] = ()) -> DataFrame:
    none, kind = F.lit(None), kind if isinstance(kind, Column) else F.lit(kind)
    status = F.when(text.isNull() & kind.isin("pdf", "png", "jpg"), "needs_ocr").otherwise("ok")
    made = rows.select(number.alias("id"), path.alias("path"), none.cast("long").alias("parent_id"), F.sha2(path, 256).alias("sha256"), kind.alias("kind"), status.alias("status"), text.alias("text"))
    return ops.with_context(made, list(patterns))


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an invoice to its source, for the attention of a reader of its language, its whole text below."""
    docs = read(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("INVOICE\nNo: INV-"), number, F.lit("\nDate: 4 Feb 2031\nJob: Review "), F.col("lang"), F.lit("\nQuote Ref: QUO-9"), number, F.lit("\nBILL TO:\n"), F.col("source"), F.lit(" Trading Ltd\nAttn: Ada "),
        F.upper(F.substring("lang", 1, 1)), F.substring("lang", 2, 99), F.lit("\nDescription\nTOTAL: "), F.col("n_chars").cast("string"), F.lit(".50 EUR\n\n"), F.col("text"),
    )
    return _as_files(docs, F.col("doc_id"), F.concat(F.lit("in/doc"), number, F.lit(".txt")), "text", text)


#: A second file of each document, in one of these forms by its number: path, kind, text ({n} is the number), and the facts that it states.
FORMS = [
    ("Customers/Acme {n} Corporation/JOB-2023-0003 Shrink Wrap Retrofit/Invoices/INV-8034_Acme {n} Corporation.pdf", "pdf", "Meridian Packaging Systems Ltd\nINVOICE\nNo: INV-8034\nDate: 11 Mar 2024\nJob: Shrink Wrap Retrofit\nQuote Ref: QUO-9999\nBILL TO:\nACME {n} Corp\n240 Priory Lane\nAttn: Thomas Bianchi\nDescription Qty Unit Unit Price Line Total\nCase Sealer CS-110 1 unit £3,344.00 £3,344.00\nSubtotal: £3,344.00\nTOTAL: £3,344.00\n",
     [("Acme {n} Corporation", "HAS_PROJECT", "Shrink Wrap Retrofit"), ("INV-8034", "ISSUED_TO", "ACME {n} Corp"), ("Thomas Bianchi", "WORKS_FOR", "ACME {n} Corp"), ("INV-8034", "ATTENTION_OF", "Thomas Bianchi"), ("Shrink Wrap Retrofit", "HAS_DOCUMENT", "INV-8034"),
      ("INV-8034", "REFERENCES", "QUO-9999"), ("INV-8034", "LISTS_PRODUCT", "Case Sealer CS-110"), ("INV-8034", "ISSUED_TO", "Acme {n} Corporation"), ("Shrink Wrap Retrofit", "HAS_DOCUMENT", "INV-8034")]),
    ("Admin/Mail/re_{n}.eml", "eml", 'From: Sam Jones <sam.jones@gmail.com>\nTo: Thomas Bianchi <thomas.bianchi@acme{n}.com>, "Lee, Ann" <ann.lee@acme{n}.com>\nSubject: RE: Wrap Line {n} — schedule update\n\nHi Thomas, the invoice INV-8034 is attached.\n',
     [("Wrap Line {n}", "HAS_DOCUMENT", "RE: Wrap Line {n} — schedule update"), ("Sam Jones", "WORKS_FOR", "gmail.com"), ("Sam Jones", "SENT", "RE: Wrap Line {n} — schedule update"), ("Thomas Bianchi", "WORKS_FOR", "acme{n}.com"), ("Thomas Bianchi", "RECEIVED", "RE: Wrap Line {n} — schedule update"), ("RE: Wrap Line {n} — schedule update", "REFERENCES", "INV-8034")]),
    ("Customers/Acme {n} Corporation/Scans/INV-8099_Acme {n} Corporation.png", "png", None, [("INV-8099", "ISSUED_TO", "Acme {n} Corporation"), ("INV-8099", "FILED_UNDER", "Acme {n} Corporation")]),
    ("Engineering/{n}/GB-40_Datasheet.pdf", "pdf", None, [("GB-40_Datasheet", "DESCRIBES", "GB-40")]),
    ("Admin/Notes {n}/QUO-5238.txt", "text", "Follow-up on QUO-5238 and DN-6041.", [("QUO-5238", "REFERENCES", "DN-6041")]),
    ("a/{n}.vcf", "vcf", "BEGIN:VCARD\nFN:Ann Lee\nORG:Acme {n} Ltd\nEMAIL:Ann@acme.com\nTEL:1", [("Ann Lee", "WORKS_FOR", "Acme {n} Ltd"), ("Contact card: Ann Lee", "DESCRIBES", "Ann Lee")]),
    ("a/{n}.ics", "ics", "SUMMARY:Site visit – Wrap Line (Acme {n} Ltd)\nUID:{n}", [("Site visit – Wrap Line (Acme {n} Ltd)", "ADDRESSED_TO", "Acme {n} Ltd"), ("Wrap Line", "HAS_DOCUMENT", "Site visit – Wrap Line (Acme {n} Ltd)")]),
    ("a/d{n}.pdf", "pdf", "Drawing No: DWG-{n}\nTitle: Frame {n}\nRev: B\nCustomer: Acme {n} Ltd\nJob: Wrap Line\nDrawn By: Ann Lee",
     [("Frame {n}", "ISSUED_TO", "Acme {n} Ltd"), ("Wrap Line", "HAS_DOCUMENT", "Frame {n}"), ("Ann Lee", "WORKS_FOR", "{o}"), ("Ann Lee", "AUTHORED", "Frame {n}")]),
    ("a/k{n}.pdf", "pdf", "Certificate No: CAL-{n}\nTechnician: Bob Ray\nResult: Pass", [("Bob Ray", "WORKS_FOR", "{o}"), ("Bob Ray", "AUTHORED", "CAL-{n}")]),
    ("a/s{n}.pdf", "pdf", "CS-110 · Datasheet\nDoc No: DS{n}", [("CS-110 Datasheet (DS{n})", "DESCRIBES", "CS-110")]),
    ("a/m{n}.pdf", "pdf", "CS-110-2\nOperating Manual {n}\n1 Jan 2020", [("CS-110-2 Operating Manual {n}", "DESCRIBES", "CS-110")]),
    ("a/t{n}.pdf", "pdf", "SAFETY AT WORK\nThis is to certify that\nAnn Lee\nTraining Provider: Safe {n} Ltd\nExpiry: 1 Jan 2030", [("Ann Lee", "HOLDS", "Safety At Work – Ann Lee"), ("Safety At Work – Ann Lee", "ISSUED_BY", "Safe {n} Ltd")]),
    ("a/i{n}.pdf", "pdf", "Body\nISO 9001\nWe certify that\nAcme {n} Ltd\nCertificate No: ISO-9001\nCertification Body: Cert {n} Co", [("Acme {n} Ltd", "HOLDS", "ISO 9001 certificate (ISO-9001)"), ("ISO 9001 certificate (ISO-9001)", "ISSUED_BY", "Cert {n} Co")]),
    ("a/Letter_{n}.docx", "docx", "Meridian\n3 Mar 2024\nAcme {n} Ltd\nLane 1\nRe: News · Wrap Line\nDear Ann,\nText.\nYours sincerely,\nBob Ray\nManager, Meridian",
     [("LETTER-{n}", "ADDRESSED_TO", "Acme {n} Ltd"), ("Wrap Line", "HAS_DOCUMENT", "LETTER-{n}"), ("Bob Ray", "WORKS_FOR", "{o}"), ("Bob Ray", "AUTHORED", "LETTER-{n}")]),
    ("a/Contract_X.docx", "docx", "Supply Contract {n}\nBetween Acme {n} Ltd and Best Ltd\nRelating to: Wrap Line", [("Acme {n} Ltd", "PARTY_TO", "Supply Contract {n} (X)"), ("Best Ltd", "PARTY_TO", "Supply Contract {n} (X)"), ("Wrap Line", "HAS_DOCUMENT", "Supply Contract {n} (X)")]),
    ("a/Q{n}_News.docx", "docx", "Internal Report\nDate: 1 Jan 2024 Author: Ann Lee", [("Ann Lee", "WORKS_FOR", "{o}"), ("Ann Lee", "AUTHORED", "Q{n} News")]),
    ("a/v.docx", "docx", "Visit {n}\nPrepared by Ann Lee on 1 Jan 2024", [("Ann Lee", "WORKS_FOR", "{o}"), ("Ann Lee", "AUTHORED", "Visit {n}")]),
    ("a/n.txt", "text", "Week {n}\nAttendees: Ann Lee, Bob Ray and Cy Dee", [("Ann Lee", "ATTENDED", "Week {n}"), ("Bob Ray", "ATTENDED", "Week {n}"), ("Cy Dee", "ATTENDED", "Week {n}")]),
    ("a/price_{n}.xlsx", "xlsx", "Item | Price\nCase Sealer CS-110 | 5\nnone | 6", [("price {n}", "LISTS_PRODUCT", "Case Sealer CS-110")]),
    ("a/o.pdf", "pdf", "INVOICE\nNo: INV-{n}\nBILL TO\nAcme {n} Ltd\nDescription\nSealer CS-110\n2\nunit\n£5.00\n£10.00\nTOTAL:\n£10.00", [("INV-{n}", "ISSUED_TO", "Acme {n} Ltd"), ("INV-{n}", "LISTS_PRODUCT", "Sealer CS-110")]),
    ("a/shot{n}.png", "png", "JOB-2023-0003 open\nJOB-2023-0004 done", [("JOB-2023-0003", "HAS_DOCUMENT", "shot{n}"), ("JOB-2023-0004", "HAS_DOCUMENT", "shot{n}")] * 2),
    ("a/x{n}.txt", "text", "We met Best Tools Ltd today.\nKind regards,\nAnn Lee\nSales, Harbor Robotics Inc", [("Ann Lee", "WORKS_FOR", "Harbor Robotics Inc"), ("x{n}", "MENTIONS", "Ann Lee"), ("x{n}", "MENTIONS", "Best Tools Ltd"), ("x{n}", "MENTIONS", "Harbor Robotics Inc")]),
]
OWNER = "Meridian Packaging Systems Ltd"
PATTERNS = [r"Customers/{company}/{job_id:JOB-\d{4}-\d{4}} {title}/**", "Customers/{company}/**"]


def _in_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the form that its number falls to, numbered from -1 down."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    cells = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("path", "kind", "text"), form)]) for form in FORMS])
    rows = docs.select("doc_id", F.get(cells, F.pmod("doc_id", F.lit(len(FORMS))).cast("int")).alias("form"))
    numbered = lambda c: F.replace(F.col(f"form.{c}"), F.lit("{n}"), F.col("doc_id").cast("string"))
    return _as_files(rows, -1 - F.col("doc_id"), numbered("path"), F.col("form.kind"), numbered("text"), PATTERNS)


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS f({columns})"


_FORM_FACTS = _values("form, src, rel, dst", [(i, *fact) for i, form in enumerate(FORMS) for fact in form[3]])
_PARTS = "doc_id AS file_id, 'INV-' || doc_id AS doc, source || ' Trading Ltd' AS company, 'Ada ' || upper(lang[1]) || lang[2:] AS person, 'Review ' || lang AS job, 'QUO-9' || doc_id AS quote"


def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts between spellings of every document as an invoice and as a file of one further form; each row carries its mentions, so no table of mentions is made first."""
    files = _invoices(spark, sf_dir).unionByName(_in_forms(spark, sf_dir))
    facts = templates.named_facts(templates.extract_files(files, templates.Settings(job_id=r"JOB-\d{4}-\d{4}", owner=OWNER)))
    return facts.select("file_id", F.col("src.surface").alias("src"), "rel", F.col("dst.surface").alias("dst"))


def extract_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.mention_rows(templates.extract_files(_invoices(spark, sf_dir), SETTINGS))
    total = F.col("attrs")["total"].cast("double")
    return rows.select("file_id", F.col("pos").cast("long").alias("pos"), "etype", "surface", "role", "confidence", total.alias("total"))


def mail_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a mail with a signature block: headers are read as headers, the body as plain text."""
    turns = read(spark, sf_dir, "conversations").withColumn("n", F.concat_ws("-", "conv_id", "turn"))
    text = F.concat(
        F.lit("From: Ada Turner <ada@c"), F.col("conv_id").cast("string"), F.lit(".example>\nTo: Bo Reed <bo@desk.example>\nSubject: Note "), F.col("n"), F.lit(" of Header Goods Ltd\n\n"), F.col("text"),
        F.lit("\nKind regards,\nNora Vane\nsecond floor\nBuyer, Harrow Mills Ltd\nnora@harrow.example\n"),
    )
    files = _as_files(turns, F.col("conv_id") * 10_000 + F.col("turn"), F.concat(F.lit("mail/"), F.col("n"), F.lit(".eml")), "eml", text)
    facts = templates.named_facts(templates.extract_files(files, SETTINGS))
    title = lambda end: F.col(f"{end}.attrs")["job_title"]
    return facts.select("file_id", F.col("src.surface").alias("src"), "rel", F.col("dst.surface").alias("dst"), F.coalesce(title("src"), title("dst")).alias("job_title"))


def _spelled(name: Column, number: Column) -> Column:
    """A name of two words in one of six spellings: with legal suffixes, in capitals, in one word, with an article, two letters swapped."""
    first, second = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    swapped = F.concat(F.substring(second, 1, 1), F.substring(second, 3, 1), F.substring(second, 2, 1), F.substring(second, 4, 99))
    spellings = [F.concat(F.initcap(name), F.lit(" Ltd")), F.concat(F.upper(name), F.lit(" GmbH")), F.concat(first, second), F.concat(F.lit("The "), name, F.lit(" Co.")), F.when(F.length(second) >= 5, F.concat_ws(" ", first, swapped)).otherwise(name), F.initcap(name)]
    out = spellings[-1]
    for k, s in enumerate(spellings[:-1]):
        out = F.when(number % 6 == k, s).otherwise(out)
    return out


_SPELLED = """CASE p_partkey % 6 WHEN 0 THEN {i} || ' Ltd' WHEN 1 THEN upper(p_name) || ' GmbH' WHEN 2 THEN a || b WHEN 3 THEN 'The ' || p_name || ' Co.'
    WHEN 4 THEN CASE WHEN length(b) >= 5 THEN a || ' ' || b[1] || b[3] || b[2] || b[4:] ELSE p_name END ELSE {i} END""".format(i="upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:]")


def company_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The makers of all parts under their spellings: which spellings are one company, by the key that most of them speak for."""
    parts = read(spark, sf_dir, "part")
    mentions = parts.select(F.col("p_partkey").alias("id"), F.lit("company").alias("etype"), _spelled(F.col("p_name"), F.col("p_partkey")).alias("surface"), F.lit("bill_to").alias("role"), F.lit(None).cast("map<string,string>").alias("attrs"))
    spelled, _ = companies.companies(mentions, Tables(spark))
    names_of = parts.select(_spelled(F.col("p_name"), F.col("p_partkey")).alias("surface"), "p_name").distinct()
    least = spelled.join(names_of, "surface").withColumn("p_name", F.min("p_name").over(Window.partitionBy("company")))
    return least.select("surface", "p_name").distinct()


def company_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's maker in its spelling against its plain name."""
    rows = read(spark, sf_dir, "part").select(_spelled(F.col("p_name"), F.col("p_partkey")).alias("mention"), F.col("p_name").alias("candidate")).distinct()
    return rows.withColumn("m", names.company_match("mention", "candidate", F.lit(False))).select("mention", "candidate", "m.score", "m.method")


def people_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a person of one of two organisations, two of one name; then by initial in a file of its organisation's folder."""
    letters = F.initcap(F.translate(F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0"), "0123456789", "bcdfghjklm"))
    org = F.concat(F.lit("Org "), F.when(F.col("c_custkey") % 2 == 0, "Even").otherwise("Odd"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", letters.alias("last"), org.alias("org"))
    full = rows.select((F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").alias("file_id"), F.concat(F.lit("Ada "), "last").alias("surface"), F.create_map(F.lit("organisation"), F.col("org")).alias("attrs"))
    short = rows.select((F.col("c_custkey") * 2 + 1).alias("id"), F.col("c_custkey").alias("file_id"), F.concat(F.lit("A. "), "last").alias("surface"), F.create_map().cast("map<string,string>").alias("attrs"))
    mentions = full.unionByName(short).withColumn("etype", F.lit("person"))
    return resolve.people(mentions, rows.select(F.col("c_custkey").alias("file_id"), F.col("org").alias("organisation"))).select("id", "key", "method")


QUERIES: dict[str, Query] = {f.__name__: f for f in (extract_facts, extract_mentions, mail_facts, company_resolution, company_match, people_in_context)}
SQL: dict[str, str] = {
    "extract_facts": f"""WITH d AS (SELECT {_PARTS} FROM documents)
        SELECT file_id, doc AS src, 'ISSUED_TO' AS rel, company AS dst FROM d UNION ALL SELECT file_id, person, 'WORKS_FOR', company FROM d UNION ALL SELECT file_id, doc, 'ATTENTION_OF', person FROM d
        UNION ALL SELECT file_id, job, 'HAS_DOCUMENT', doc FROM d UNION ALL SELECT file_id, doc, 'REFERENCES', quote FROM d
        UNION ALL SELECT -1 - doc_id, replace(replace(src, '{{n}}', doc_id::VARCHAR), '{{o}}', '{OWNER}'), rel, replace(replace(dst, '{{n}}', doc_id::VARCHAR), '{{o}}', '{OWNER}') FROM documents JOIN {_FORM_FACTS} ON form = doc_id % {len(FORMS)}""",
    "extract_mentions": f"""WITH d AS (SELECT {_PARTS}, n_chars FROM documents), none AS (SELECT NULL::DOUBLE AS total)
        SELECT file_id, 0::BIGINT AS pos, 'document' AS etype, doc AS surface, 'self' AS role, 1.0::DOUBLE AS confidence, n_chars + 0.5::DOUBLE AS total FROM d
        UNION ALL SELECT file_id, 1, 'company', company, 'bill_to', 1.0, NULL FROM d UNION ALL SELECT file_id, 2, 'person', person, 'attn', 1.0, NULL FROM d
        UNION ALL SELECT file_id, 3, 'project', job, 'doc_job_field', 0.9, NULL FROM d UNION ALL SELECT file_id, 4, 'document', quote, 'reference', 1.0, NULL FROM d""",
    "mail_facts": """WITH c AS (SELECT conv_id * 10000 + turn AS file_id, 'Note ' || conv_id || '-' || turn || ' of Header Goods Ltd' AS doc, 'c' || conv_id || '.example' AS domain FROM conversations)
        SELECT file_id, 'Ada Turner' AS src, 'WORKS_FOR' AS rel, domain AS dst, NULL::VARCHAR AS job_title FROM c UNION ALL SELECT file_id, 'Ada Turner', 'SENT', doc, NULL FROM c
        UNION ALL SELECT file_id, 'Bo Reed', 'WORKS_FOR', 'desk.example', NULL FROM c UNION ALL SELECT file_id, 'Bo Reed', 'RECEIVED', doc, NULL FROM c
        UNION ALL SELECT file_id, 'Nora Vane', 'WORKS_FOR', 'Harrow Mills Ltd', 'Buyer' FROM c UNION ALL SELECT file_id, doc, 'MENTIONS', 'Nora Vane', 'Buyer' FROM c
        UNION ALL SELECT file_id, doc, 'MENTIONS', 'Harrow Mills Ltd', NULL FROM c""",
    "company_resolution": f"WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT DISTINCT {_SPELLED} AS surface, p_name FROM p",
    "company_match": f"""WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), s AS (SELECT DISTINCT {_SPELLED} AS mention, p_name AS candidate, a, b FROM p)
        SELECT mention, candidate, CAST(CASE WHEN mention = a || b THEN 0.97 WHEN lower(mention) <> mention OR mention = candidate THEN 1.0 ELSE 0.925 END AS DOUBLE) AS score,
               CASE WHEN mention = a || b THEN 'spacing' WHEN lower(mention) <> mention OR mention = candidate THEN 'normalized' ELSE 'typo' END AS method FROM s""",
    "people_in_context": """WITH c AS (SELECT c_custkey, translate(lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0'), '0123456789', 'bcdfghjklm') AS last, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS org,
            count(*) OVER (PARTITION BY c_custkey // 2) AS n FROM customer)
        SELECT c_custkey * 2 AS id, 'ada ' || last || '|org ' || org AS key, 'name+organisation' AS method FROM c
        UNION ALL SELECT c_custkey * 2 + 1, 'ada ' || last || '|org ' || org, CASE WHEN n = 1 THEN 'unique_name' ELSE 'name+context' END FROM c""",
}
