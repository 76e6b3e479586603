"""Mentions and facts of files, template by template."""

import pytest

from docweave.operators import files as ops
from docweave.operators import templates

COLUMNS = "id long, path string, parent_id long, sha256 string, kind string, status string, text string"
PATTERNS = [r"Customers/{company}/{job_id:JOB-\d{4}-\d{4}} {title}/**", "Customers/{company}/**"]
SETTINGS = templates.Settings(job_id=r"JOB-\d{4}-\d{4}", owner="Farrow Handling Ltd")
JOB = "Customers/Brightwell Orchards/JOB-2031-0007 Cold Store Extension/Invoices/"
INVOICE = """Farrow Handling Ltd
INVOICE
No: INV-4417
Date: 4 Feb 2031
Job: Cold Store Extension
Quote Ref: QUO-3105
BILL TO:
BRIGHTWELL Orch.
8 Quay Street
Dunmere
Attn: Oskar Lindqvist
Description Qty Unit Unit Price Line Total
Pallet Lift PL-240 1 unit £1,950.00 £1,950.00
Subtotal: £1,950.00
TOTAL: £1,950.00
"""
MAIL = """From: Ida Moreno <ida.moreno@gmail.com>
To: Oskar Lindqvist <oskar.lindqvist@brightwell.com>, "Lee, Ann" <ann.lee@brightwell.com>
Subject: RE: Cold Store Extension — schedule update

Hi Oskar, the invoice INV-4417 is attached.
"""


def table(spark, *rows):
    made = [(n, path, None, f"{n:064d}", kind, "needs_ocr" if text is None else "ok", text) for n, (path, kind, text) in enumerate(rows, 1)]
    return ops.with_context(spark.createDataFrame(made, COLUMNS), PATTERNS)


def read(spark, *rows, settings=SETTINGS):
    found = templates.extract_files(table(spark, *rows), settings).cache()
    mentions = {r.id: r for r in templates.mention_rows(found).collect()}
    facts = [(mentions[r.src].surface, r.rel, mentions[r.dst].surface) for r in templates.fact_rows(found).orderBy("id").collect()]
    return [mentions[i] for i in sorted(mentions)], facts


def test_invoice_in_a_job_folder(spark):
    mentions, facts = read(spark, (JOB + "INV-4417_Brightwell Orchards.pdf", "pdf", INVOICE))
    assert [(m.etype, m.surface, m.role) for m in mentions] == [
        ("company", "Brightwell Orchards", "folder"), ("project", "Cold Store Extension", "folder"), ("document", "INV-4417", "self"), ("company", "BRIGHTWELL Orch.", "bill_to"),
        ("person", "Oskar Lindqvist", "attn"), ("project", "Cold Store Extension", "doc_job_field"), ("document", "QUO-3105", "reference"), ("product", "Pallet Lift PL-240", "line_item"),
        ("company", "Brightwell Orchards", "filename"),
    ]
    assert facts == [
        ("Brightwell Orchards", "HAS_PROJECT", "Cold Store Extension"), ("INV-4417", "ISSUED_TO", "BRIGHTWELL Orch."), ("Oskar Lindqvist", "WORKS_FOR", "BRIGHTWELL Orch."), ("INV-4417", "ATTENTION_OF", "Oskar Lindqvist"),
        ("Cold Store Extension", "HAS_DOCUMENT", "INV-4417"), ("INV-4417", "REFERENCES", "QUO-3105"), ("INV-4417", "LISTS_PRODUCT", "Pallet Lift PL-240"), ("INV-4417", "ISSUED_TO", "Brightwell Orchards"),
        ("Cold Store Extension", "HAS_DOCUMENT", "INV-4417"),
    ]
    doc = mentions[2].attrs
    assert (doc["doc_type"], doc["key"], doc["total"], doc["currency"], doc["date"]) == ("invoice", "INV-4417", "1950.0", "GBP", "4 Feb 2031")
    assert mentions[1].attrs["job_id"] == "JOB-2031-0007" and mentions[3].attrs["address"] == "8 Quay Street, Dunmere"
    assert mentions[8].confidence == 0.7 and mentions[8].attrs["truncated"] == "1" and mentions[7].attrs["code"] == "PL-240"


def test_mail(spark):
    mentions, facts = read(spark, ("Admin/Mail/re_works.eml", "eml", MAIL))
    assert ("Ida Moreno", "SENT", "RE: Cold Store Extension — schedule update") in facts and ("Oskar Lindqvist", "WORKS_FOR", "brightwell.com") in facts
    assert [f[0] for f in facts if f[1] == "RECEIVED"] == ["Oskar Lindqvist"] or len([f for f in facts if f[1] == "RECEIVED"]) == 2
    assert ("Cold Store Extension", "HAS_DOCUMENT", "RE: Cold Store Extension — schedule update") in facts
    assert any(f[1] == "REFERENCES" and f[2] == "INV-4417" for f in facts)
    assert next(m for m in mentions if m.surface == "Oskar Lindqvist").attrs["email"] == "oskar.lindqvist@brightwell.com"
    assert next(m for m in mentions if m.role == "self").attrs["key"] == "email:re_works"


CASES = [
    (("Customers/Brightwell Orchards/Scans/INV-5120_Brightwell Orchards.png", "png", None), "invoice", [("INV-5120", "ISSUED_TO", "Brightwell Orchards"), ("INV-5120", "FILED_UNDER", "Brightwell Orchards")]),
    (("Engineering/Datasheets/RT-65_Datasheet.pdf", "pdf", None), "other", [("RT-65_Datasheet", "DESCRIBES", "RT-65")]),
    (("Admin/Notes/QUO-6071.txt", "text", "Follow-up on QUO-6071 and DN-2217."), "quote", [("QUO-6071", "REFERENCES", "DN-2217")]),
    (("a/c.vcf", "vcf", "BEGIN:VCARD\nFN:Ann Lee\nORG:Acme Ltd\nEMAIL:Ann@acme.com\nTEL:1"), "contact_card", [("Ann Lee", "WORKS_FOR", "Acme Ltd"), ("Contact card: Ann Lee", "DESCRIBES", "Ann Lee")]),
    (("a/e.ics", "ics", "SUMMARY:Site visit – Wrap Line (Acme Ltd)\nUID:7"), "meeting", [("Site visit – Wrap Line (Acme Ltd)", "ADDRESSED_TO", "Acme Ltd"), ("Wrap Line", "HAS_DOCUMENT", "Site visit – Wrap Line (Acme Ltd)")]),
    (("a/d.pdf", "pdf", "Drawing No: DWG-3302\nTitle: Frame\nRev: B\nCustomer: Acme Ltd\nJob: Wrap Line\nDrawn By: Ann Lee"), "drawing", [("Frame", "ISSUED_TO", "Acme Ltd"), ("Ann Lee", "AUTHORED", "Frame"), ("Ann Lee", "WORKS_FOR", "Farrow Handling Ltd")]),
    (("a/k.pdf", "pdf", "Certificate No: CAL-12\nTechnician: Bob Ray\nResult: Pass"), "calibration_cert", [("Bob Ray", "AUTHORED", "CAL-12")]),
    (("a/s.pdf", "pdf", "PL-240 · Datasheet\nDoc No: DS-1"), "datasheet", [("PL-240 Datasheet (DS-1)", "DESCRIBES", "PL-240")]),
    (("a/m.pdf", "pdf", "PL-240-2\nOperating Manual\n1 Jan 2020"), "manual", [("PL-240-2 Operating Manual", "DESCRIBES", "PL-240")]),
    (("a/t.pdf", "pdf", "SAFETY AT WORK\nThis is to certify that\nAnn Lee\nTraining Provider: Safe Ltd\nExpiry: 1 Jan 2030"), "training_certificate", [("Ann Lee", "HOLDS", "Safety At Work – Ann Lee"), ("Safety At Work – Ann Lee", "ISSUED_BY", "Safe Ltd")]),
    (("a/i.pdf", "pdf", "Body\nISO 9001\nWe certify that\nAcme Ltd\nCertificate No: ISO-9001\nCertification Body: Cert Co"), "iso_certificate", [("Acme Ltd", "HOLDS", "ISO 9001 certificate (ISO-9001)")]),
    (("a/Letter_17.docx", "docx", "Farrow\n3 Mar 2024\nAcme Ltd\nLane 1\nRe: News · Wrap Line\nDear Ann,\nText.\nYours sincerely,\nBob Ray\nManager, Farrow"), "letter", [("LETTER-17", "ADDRESSED_TO", "Acme Ltd"), ("Wrap Line", "HAS_DOCUMENT", "LETTER-17"), ("Bob Ray", "AUTHORED", "LETTER-17")]),
    (("a/Contract_X.docx", "docx", "Supply Contract\nBetween Acme Ltd and Best Ltd\nRelating to: Wrap Line"), "contract", [("Acme Ltd", "PARTY_TO", "Supply Contract (X)"), ("Best Ltd", "PARTY_TO", "Supply Contract (X)"), ("Wrap Line", "HAS_DOCUMENT", "Supply Contract (X)")]),
    (("a/Q1_News.docx", "docx", "Internal Report\nDate: 1 Jan 2024 Author: Ann Lee"), "report", [("Ann Lee", "AUTHORED", "Q1 News")]),
    (("a/v.docx", "docx", "Visit\nPrepared by Ann Lee on 1 Jan 2024"), "report", [("Ann Lee", "AUTHORED", "Visit")]),
    (("a/n.txt", "text", "Weekly\nAttendees: Ann Lee, Bob Ray and Cy Dee"), "meeting_notes", [("Ann Lee", "ATTENDED", "Weekly"), ("Bob Ray", "ATTENDED", "Weekly"), ("Cy Dee", "ATTENDED", "Weekly")]),
    (("a/price_2024.xlsx", "xlsx", "Item | Price\nPallet Lift PL-240 | 5\nnone | 6"), "price_list", [("price 2024", "LISTS_PRODUCT", "Pallet Lift PL-240")]),
    (("a/o.pdf", "pdf", "INVOICE\nNo: INV-1\nBILL TO\nAcme Ltd\nDescription\nSealer PL-240\n2\nunit\n£5.00\n£10.00\nTOTAL:\n£10.00"), "invoice", [("INV-1", "LISTS_PRODUCT", "Sealer PL-240"), ("INV-1", "ISSUED_TO", "Acme Ltd")]),
    (("a/shot.png", "png", "JOB-2031-0007 open\nJOB-2031-0008 done"), "screenshot", [("JOB-2031-0007", "HAS_DOCUMENT", "shot")]),
    (("a/x.txt", "text", "We met Best Tools Ltd today.\nKind regards,\nAnn Lee\nSales, Harbor Robotics Inc"), "other", [("x", "MENTIONS", "Best Tools Ltd"), ("Ann Lee", "WORKS_FOR", "Harbor Robotics Inc")]),
]


def test_each_template(spark):
    found = templates.extract_files(table(spark, *[c[0] for c in CASES]), SETTINGS).cache()
    mentions = {r.id: r for r in templates.mention_rows(found).collect()}
    facts = [(r.file_id, mentions[r.src].surface, r.rel, mentions[r.dst].surface) for r in templates.fact_rows(found).collect()]
    for n, ((path, _, _), doc_type, wanted) in enumerate(CASES, 1):
        own = [m for m in mentions.values() if m.file_id == n and m.role == "self"]
        assert [m.attrs["doc_type"] for m in own] == [doc_type], path
        assert {(n, *w) for w in wanted} <= set(facts), (path, [f for f in facts if f[0] == n])


def test_blank_files_and_odd_text(spark):
    rows = [("a/empty.txt", "text", "   "), ("a/meme.png", "png", "|\nWHEN THE PLC\n"), ("a/z.zip", "zip", None), ("b", "text", ","), ("", "text", "Re:\nDear "), ("a/l.eml", "eml", "From: , ,<>\n")]
    mentions, _ = read(spark, *rows)
    assert {m.file_id for m in mentions if m.role == "self"} == {2, 4, 5, 6}


def test_learned_types(spark):
    rows = table(spark, ("a", "text", "Invoice No: HR-1042 and Job No: JOB-12"), ("b", "text", "Quote: HR-9 Invoice INV-1"))
    assert templates.learned_types(rows)["HR"] == "invoice" and "JOB" not in templates.learned_types(rows)


def test_attachments(spark):
    made = [(1, "m.eml", None, "a" * 64, "eml", "ok", MAIL), (2, "m.eml::n.txt", 1, "b" * 64, "text", "ok", "hello")]
    files = ops.with_context(spark.createDataFrame(made, COLUMNS), [])
    mentions = templates.mention_rows(templates.extract_files(files))
    assert [(r.file_id, r.rel) for r in templates.attachments(files, mentions).collect()] == [(2, "ATTACHED_TO")]


@pytest.mark.parametrize(("text", "names"), [("Please contact Harbor Robotics Inc. today", ["Harbor Robotics Inc."]), ("The Best & Tools Ltd and Acme", ["Best & Tools Ltd"]), ("nothing here", [])])
def test_company_names(spark, text, names):
    from pyspark.sql import functions as F

    from docweave.functions import text as t

    assert spark.range(1).select(t.company_names(F.lit(text)).alias("n")).first().n == names


@pytest.mark.parametrize(("text", "names"), [("De. Co.", []), ("We left Arrr. Co que", []), ("Ask Amazon.com Inc or J. Hall Ltd.", ["Ask Amazon.com Inc", "Hall Ltd."])])
def test_company_names_end_with_the_sentence(spark, text, names):
    from pyspark.sql import functions as F

    from docweave.functions import text as t

    assert spark.range(1).select(t.company_names(F.lit(text)).alias("n")).first().n == names


def test_a_branch_passes_over_a_text_once(spark):
    from pyspark.sql import functions as F

    from docweave.functions import text as t

    text = F.col("text")
    for made in (t.money(text), t.currency(text), t.field(text, "No"), templates._clean(t.field(text, "No"))):
        rows = spark.createDataFrame([("No: 1",)], "text string").select(F.when(text != "", made).alias("v"))
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_lines_are_trimmed(spark):
    from pyspark.sql import functions as F

    from docweave.functions import text as t

    texts = [" a \r\n\n \x00b\rc \n\u00a0\n", "", None, "\n \n", "x", "a  b\n" + " " * 50_000 + "c"]
    got = spark.createDataFrame([(v,) for v in texts], "text string").select(t.lines(F.col("text")).alias("v")).collect()
    assert [r.v for r in got] == [["a", "b\rc", "\u00a0"], [], None, [], ["x"], ["a  b", "c"]]


def test_equal_mentions_share_their_attributes(spark):
    mail = "From: Ida Moreno <ida@one.com>\nTo: Ann Lee <ann@one.com>, Ann Lee <lee@two.com>\nSubject: Hello\n\nHi"
    mentions, facts = read(spark, ("a/m.eml", "eml", mail))
    ann = [m for m in mentions if m.surface == "Ann Lee"]
    assert len(ann) == 1 and ann[0].attrs["email"] == "lee@two.com" and ann[0].attrs["organisation"] == "two.com"
    assert {f for f in facts if f[1] == "WORKS_FOR"} == {("Ida Moreno", "WORKS_FOR", "one.com"), ("Ann Lee", "WORKS_FOR", "one.com"), ("Ann Lee", "WORKS_FOR", "two.com")}


def test_mail_headers_are_no_free_text(spark):
    mail = """From: Ida Moreno <ida@one.com>
To: Ann Lee <ann@one.com>
Subject: Offer of Harbor Robotics Ltd, see QUO-123

See Invoice No: HR-1042 from Best Tools Ltd and DN-2217.
Kind regards,
Cy Dee
first floor
Buyer, Dunmere Mills Ltd
cy@dunmere.com, INV-1
"""
    mentions, facts = read(spark, ("a/m.eml", "eml", mail))
    assert {m.surface for m in mentions if m.role == "free_text"} == {"Best Tools Ltd", "Dunmere Mills Ltd", "Cy Dee", "HR-1042"}
    cy = next(m for m in mentions if m.surface == "Cy Dee")
    assert (cy.attrs["email"], cy.attrs["job_title"], cy.attrs["organisation"]) == ("cy@dunmere.com", "Buyer", "Dunmere Mills Ltd")
    assert next(m for m in mentions if m.surface == "HR-1042").attrs["doc_type"] == "invoice"
    assert {m.surface for m in mentions if m.role == "reference"} == {"QUO-123", "DN-2217"}
    text = "Notes\nFrom: Bob Ray <bob@x.com>\nTo: sue.poe@y.com\nnothing more"
    plain, facts = read(spark, ("a/n.txt", "text", text))
    assert {(m.surface, m.attrs["email"]) for m in plain if m.role == "free_text"} == {("Bob Ray", "bob@x.com"), ("Sue Poe", "sue.poe@y.com")}


def test_long_addresses_and_too_many_mentions(spark, monkeypatch):
    lines = "\n".join(f"line {i}" for i in range(80))
    mentions, _ = read(spark, ("a/i.pdf", "pdf", f"INVOICE\nNo: INV-4417\nBILL TO\nAcme Ltd\n{lines}\nAttn: Ann Lee"))
    assert next(m for m in mentions if m.role == "bill_to").attrs["address"].endswith("line 79")
    monkeypatch.setattr(templates, "FILE_BITS", 2)
    with pytest.raises(Exception, match="mentions or facts"):
        read(spark, ("a/i.txt", "text", "INV-4417, INV-4418, INV-4419, INV-4420, INV-4421, INV-4422"))
