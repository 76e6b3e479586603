"""Whose files these are: the letterhead of their documents, the commonest mail domain, the name that goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from .templates import addresses

# Files that must share a first line, and their share; mails and share of a domain; files that name its company.
MIN_FILES, MIN_SHARE, MIN_MAILS, MIN_MAIL_SHARE, MIN_NAMING = 5, 0.1, 5, 0.3, 2


def letterhead(files: DataFrame) -> DataFrame:
    """``name, n, total``: the commonest first line of PDF texts that ends in a legal suffix, if enough files have it; else no row."""
    rows = files.filter("kind = 'pdf' and text is not null").select(t.first_line(F.col("text")).alias("name"), "id")
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.filter(t.has_legal_suffix(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = counted.orderBy(F.desc("n"), "first_id").limit(1)
    return best.join(F.broadcast(total)).filter((F.col("n") >= MIN_FILES) & (F.col("n") >= F.col("total") * MIN_SHARE)).select("name", "n", "total")


def mail_domain(files: DataFrame, generic: tuple[str, ...] = t.GENERIC_DOMAINS) -> DataFrame:
    """``domain, n, sent, share``: the company domain in the headers of most mails; of several the one that sent more, then the first by name."""
    head = F.substring_index("text", "\n\n", 1)
    mails = files.filter("kind = 'eml' and text is not null").select("id", F.regexp_extract(head, r"(?m)^From: (.*)$", 1).alias("sender"), F.array_join(F.regexp_extract_all(head, F.lit(r"(?m)^(?:From|To|Cc): (.*)$"), 1), ", ").alias("every"))
    domains = lambda c: F.transform(addresses(F.col(c)), lambda a: F.substring_index(a["email"], "@", -1))
    rows = mails.select("id", domains("sender").alias("sent"), F.explode(F.array_distinct(domains("every"))).alias("domain"))
    counted = rows.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.size(F.filter("sent", lambda d: d == F.col("domain")))).alias("sent"))
    total = mails.agg(F.count("*").alias("total"))
    best = counted.filter(~t.is_generic_domain(F.col("domain"), generic)).orderBy(F.desc("n"), F.desc("sent"), "domain").limit(1).join(F.broadcast(total))
    return best.filter((F.col("n") >= MIN_MAILS) & (F.col("n") >= F.col("total") * MIN_MAIL_SHARE)).select("domain", "n", "sent", (F.col("n") / F.col("total")).alias("share"))


def named_for(files: DataFrame, domain: str) -> str | None:
    """The organisation that most files name, at least two, of those that a domain can stand for."""
    named = files.filter("text is not null").select("id", F.explode(t.company_names(F.col("text"))).alias("name")).groupBy("name").agg(F.countDistinct("id").alias("n"))
    fits = F.pandas_udf(lambda names: names.map(lambda name: n.match_domain(domain, name) is not None).astype("bool"), "boolean")
    best = named.filter(F.col("n") >= MIN_NAMING).filter(fits("name")).orderBy(F.desc("n"), "name").first()
    return best["name"] if best else None


def detect(files: DataFrame, generic: tuple[str, ...] = t.GENERIC_DOMAINS) -> tuple[str | None, str | None, str]:
    """Name, mail domain and the reason. A letterhead goes before a domain; a domain that doesn't fit it is left out."""
    head, mails = letterhead(files).first(), mail_domain(files, generic).first()
    domain = mails["domain"] if mails else None
    if head:
        fits = domain is not None and n.match_domain(domain, head["name"]) is not None
        return head["name"], domain if fits else None, f"letterhead of {head['n']} of {head['total']} PDFs"
    if domain:
        return named_for(files, domain) or domain, domain, f"domain in {mails['share']:.0%} of mails"
    return None, None, "no letterhead and no mail domain is common enough"
