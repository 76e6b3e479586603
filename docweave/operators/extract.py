"""Mentions that label and number patterns find, as column expressions over a file's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Document types by the prefix of their numbers, and prefixes that name no document.
TYPE_OF_PREFIX = {
    "INV": "invoice", "QUO": "quote", "PO": "purchase_order", "DN": "delivery_note", "DWG": "drawing", "CAL": "calibration_cert", "SPEC": "specification", "DS": "datasheet", "ISO": "iso_certificate",
}
NOT_REFERENCED = ("SPEC", "DS", "ISO")
NO_DOCUMENT = ("JOB", "SN")

NUMBER = r"(?<![\p{L}\p{N}-])([A-Z]{2,5}-\d{3,6})(?![\p{L}\p{N}-])"
CODE = r"(?<![\p{L}\p{N}-])([A-Z]{2,4}-\d{2,4})(?![\p{L}\p{N}-])"


def prefix_of(number: Column) -> Column:
    return F.substring_index(number, "-", 1)


def type_of(number: Column, types: dict[str, str] = TYPE_OF_PREFIX) -> Column:
    """The document type that a number's prefix names, or null."""
    out = F.lit(None).cast("string")
    for prefix, name in types.items():
        out = F.when(prefix_of(number) == prefix, name).otherwise(out)
    return out


def references(text: Column, types: dict[str, str] = TYPE_OF_PREFIX) -> Column:
    """Distinct document numbers in a text whose prefix is known, in order; specifications and standards are not references."""
    known = [p for p in types if p not in NOT_REFERENCED]
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda n: prefix_of(n).isin(*known)))


def product_codes(text: Column, types: dict[str, str] = TYPE_OF_PREFIX) -> Column:
    """Distinct product codes: short numbers whose prefix names no document."""
    other = [*types, *NO_DOCUMENT]
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(CODE), 1), lambda n: ~prefix_of(n).isin(*other)))


#: Labels that teach the type of the number after them.
LABELS = {
    "invoice": "Invoice", "quote": "Quote|Quotation", "purchase_order": "Purchase Order|PO", "delivery_note": "Delivery Note", "credit_note": "Credit Note", "order": "Order", "contract": "Contract",
    "drawing": "Drawing", "specification": "Specification", "datasheet": "Datasheet",
}


def labelled(label: str) -> str:
    """The pattern of a number that follows a label such as ``Invoice``, with or without ``No`` and a colon."""
    return rf"(?<![\p{{L}}\p{{N}}])(?i:{label})(?:\s+(?i:no|number|nr)\.?|\s*#)?\s*[:#]?\s*([A-Z]{{2,5}}(?:-\d{{2,}})+)"


def own_number(text: Column, label: str) -> Column:
    """The first number that a label is followed by; null where there is none."""
    return t.filled(F.regexp_extract(text, labelled(label), 1))


#: Templates that a labelled number or line recognises: document type, the label of its number, and labels of people's roles.
TEMPLATES = {
    "invoice": ("Invoice", {}),
    "quote": ("Quote|Quotation", {}),
    "purchase_order": ("Purchase Order|PO", {}),
    "delivery_note": ("Delivery Note", {}),
    "drawing": ("Drawing", {"AUTHORED": "Drawn by"}),
    "calibration_cert": ("Certificate", {"AUTHORED": "Technician"}),
    "report": (None, {"AUTHORED": "Author"}),
    "meeting_notes": (None, {"ATTENDED": "Attendees"}),
}


def _people(text: Column, rel: str, label: str) -> Column:
    """The names in a labelled line, each with the relation that the label states."""
    names = F.transform(F.split(F.coalesce(t.field(text, label), F.lit("")), r"\s*[,;]\s*"), t.clean_person)
    return F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(F.lit(rel).alias("rel"), n.alias("name")))


def documents(files: DataFrame) -> DataFrame:
    """``file_id, doc_type, number, people``: each file's own document by the first template that fits its text.

    ``people`` are (relation, name) of labelled people. A file that no template fits is of type ``other``.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.lit(None).cast("struct<doc_type:string,number:string,people:array<struct<rel:string,name:string>>>")
    for doc_type, (label, roles) in reversed(TEMPLATES.items()):
        number = own_number(text, f"(?:{label})") if label else F.lit(None).cast("string")
        people = [_people(text, rel, role) for rel, role in roles.items()]
        listed = F.flatten(F.array(*people)) if people else F.array().cast("array<struct<rel:string,name:string>>")
        fits = number.isNotNull() if label else F.size(listed) > 0
        fits = fits & type_of(number).eqNullSafe(F.lit(doc_type)) if doc_type in ("drawing", "calibration_cert") else fits
        found = F.when(fits, F.struct(F.lit(doc_type).alias("doc_type"), number.alias("number"), listed.alias("people"))).otherwise(found)
    rows = files.select(F.col("id").alias("file_id"), found.alias("d"))
    none = F.array().cast("array<struct<rel:string,name:string>>")
    return rows.select("file_id", F.coalesce("d.doc_type", F.lit("other")).alias("doc_type"), "d.number", F.coalesce("d.people", none).alias("people"))


def document_references(files: DataFrame) -> DataFrame:
    """``file_id, number, doc_type``: numbers that a file's text refers to, other than its own document's."""
    own = documents(files).select("file_id", F.col("number").alias("own"))
    found = files.select(F.col("id").alias("file_id"), F.explode(references(F.coalesce("text", F.lit("")))).alias("number"))
    return found.join(own, "file_id").filter(~F.col("number").eqNullSafe(F.col("own"))).select("file_id", "number", type_of(F.col("number")).alias("doc_type"))
