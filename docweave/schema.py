"""Vocabularies and table schemas of the document graph."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies that stored tables use.
ENTITY_TYPES = ("company", "person", "project", "document", "product")
STATED_RELATIONS = (
    "ISSUED_TO", "ADDRESSED_TO", "ATTENTION_OF", "WORKS_FOR", "HAS_PROJECT", "HAS_DOCUMENT", "FILED_UNDER", "LISTS_PRODUCT", "DESCRIBES",
    "REFERENCES", "AUTHORED", "SENT", "RECEIVED", "ATTENDED", "PARTY_TO", "HOLDS", "ISSUED_BY", "ATTACHED_TO", "MENTIONS",
)
DERIVED_RELATIONS = ("INVOLVED_IN", "USES_PRODUCT", "PURCHASED_OR_QUOTED")
FILE_STATUSES = ("new", "ok", "empty", "corrupt", "skipped", "needs_ocr", "container")
#: Trust in a company mention by its role, the most trusted first; roles that are not listed rank 99.
COMPANY_RANK = {
    role: rank
    for rank, role in enumerate(
        "folder implied_owner bill_to contract_party drawing_customer letter_recipient vcard_org calendar_summary certified_company "
        "screenshot_row certification_body training_provider filename email_domain llm free_text".split()
    )
}
#: Order in which neighbours of each type are drawn; others come last.
TYPE_RANK = {"project": 0, "company": 1, "product": 2, "person": 3}

ENTITIES = T.StructType(
    [T.StructField("id", T.LongType(), False), *[T.StructField(c, T.StringType()) for c in ("etype", "name", "key")], T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]
)
MENTIONS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("id", "file_id")],
        T.StructField("pos", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("etype", "surface", "role")],
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("entity_id", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
FACTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("rel", T.StringType()), T.StructField("dst", T.LongType())])
RELATIONS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("src", "dst")], T.StructField("rel", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("derived", T.IntegerType())])
