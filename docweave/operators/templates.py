"""What files say: templates that recognise a file's document and the companies, people, projects and products it names.

A template is a column expression over a row of the files table; the first that fits gives the document. Its links
are the further mentions, each with the relation to the document. All of a file's mentions and facts
are put together within its row, so extraction shuffles nothing, and ids are (file, place) in one number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import extract as x

LINK = "struct<etype:string,surface:string,role:string,rel:string,out:boolean,attrs:map<string,string>,org:string,org_role:string,confidence:double>"
FOUND = f"struct<doc_type:string,key:string,title:string,attrs:map<string,string>,links:array<{LINK}>>"
MENTION = "struct<etype:string,surface:string,role:string,attrs:map<string,string>,confidence:double>"
#: Mentions of one file that its ids have room for, as a power of two.
FILE_BITS = 20

# Dates, headings of business documents, and closing words of letters.
DATE = r"\d{1,2} [A-Z][a-z]{2} \d{4}"
HEADINGS = {"INVOICE": "invoice", "QUOTATION": "quote", "PURCHASE ORDER": "purchase_order", "DELIVERY NOTE": "delivery_note"}
SIGN_OFF = "(?i)^(?:Yours faithfully|Yours sincerely|Kind regards|Best regards|Warm regards|Regards|Many thanks|Thanks|Thank you|Best|Cheers|Sincerely|Mit freundlichen Grüßen|Viele Grüße|Beste Grüße|Cordialement|Saludos|Met vriendelijke groet)[,.!]?$"
_AMOUNT = r"(?:[£€$]|GBP|EUR|USD)?\s?(\d[\d.,]*)(?:\s?(?:[£€$]|GBP|EUR|USD))?"
_ITEM = rf"(?m)^(?!(?i:description))(\S.*?)\s+(\d+)\s+([a-z]+)\s+{_AMOUNT}\s+{_AMOUNT}[ \t]*$"
_VERSION = r"(?i)^(?:v|rev|version|copy|draft|final)?[ _.-]*\w?\d*$"


@dataclass(frozen=True)
class Settings:
    """What a dataset fixes: the types of number prefixes, the pattern of job ids, and the owner's name."""

    types: dict[str, str] = field(default_factory=lambda: dict(x.TYPE_OF_PREFIX))
    job_id: str | None = None
    owner: str | None = None


def _map(**attrs: Column | str | None) -> Column:
    parts = [p for k, v in attrs.items() if v is not None for p in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull()) if parts else F.lit(None).cast("map<string,string>")


def _clean(surface: Column) -> Column:
    """A spelling without blanks, commas, semicolons and colons around it; null if nothing is left."""
    return t.filled(F.btrim(t.collapse_spaces(surface), F.lit(" ,;:")))


def link(etype: str, surface: Column, role: str, rel: str | None, out: bool = True, org: Column | None = None, org_role: str | None = None, confidence: float = 1.0, **attrs: Column | str | None) -> Column:
    """A mention and its relation from the document (``out``) or to it; ``org`` is the company that a person works for."""
    named = t.clean_person(surface) if etype == "person" else _clean(surface)
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(etype), named, F.lit(role), F.lit(rel), F.lit(out), _map(**attrs), none if org is None else _clean(org), F.lit(org_role), F.lit(confidence)
    ).cast(LINK)


def found(doc_type: Column | str, key: Column, title: Column, links: Sequence[Column] = (), more: Sequence[Column] = (), **attrs: Column | str | None) -> Column:
    """A recognised document; ``more`` are arrays of links."""
    every = F.concat(F.array(*links).cast(f"array<{LINK}>"), *more)
    return F.struct(doc_type if isinstance(doc_type, Column) else F.lit(doc_type), key, F.coalesce(title, key), _map(**attrs), F.filter(every, lambda k: k["surface"].isNotNull())).cast(FOUND)


def _none(text: Column) -> Column:
    return t.filled(F.btrim(text, F.lit(t.BLANK)))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return _none(F.regexp_extract(text, pattern, group))


def addresses(header: Column) -> Column:
    """``name, email`` of the addresses in a mail header; an address without a name is named after its local part."""
    entries = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r'((?:"[^"]*"|[^,"])+)'), 1)

    def named(email: Column, shown: Column) -> Column:
        local = F.initcap(F.regexp_replace(F.substring_index(email, "@", 1), r"[._+-]+", " "))
        return F.struct(F.when(shown.contains("@"), local).otherwise(F.coalesce(shown, local)).alias("name"), email.alias("email"))

    def one(entry: Column) -> Column:
        email = F.lower(F.regexp_extract(entry, r"([\w.+%-]+@[\w-]+(?:\.[\w-]+)+)", 1))
        shown = _none(F.regexp_replace(F.regexp_replace(entry, r"<[^>]*>", ""), '"', ""))
        return t.let(F.struct(email.alias("email"), shown.alias("shown")), lambda v: named(v["email"], v["shown"]))

    return F.filter(F.transform(entries, one), lambda a: a["email"] != "")


def _people(header: Column, role: str, rel: str) -> Column:
    """Links to the people in a mail header, who work for their address's domain."""
    return F.transform(
        addresses(header),
        lambda a: link("person", a["name"], role, rel, False, org=F.substring_index(a["email"], "@", -1), org_role="email_domain", email=a["email"]),
    )


def sign_offs(lines: Column) -> Column:
    """``name, next`` for each closing line: the line after it, and the one after that."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.coalesce(F.try_element_at(lines, i), F.lit("")).rlike(SIGN_OFF))
    return F.transform(places, lambda i: F.struct(F.try_element_at(lines, i + 1).alias("name"), F.try_element_at(lines, i + 2).alias("next")))


def file_number(stem: Column, types: dict[str, str]) -> tuple[Column, Column]:
    """The document number that a file's name begins with, and the rest of the name unless it says only a version."""
    number = _first(stem, r"^([A-Z]{2,5}-\d{3,6})(?![\d-])")
    number = F.when(x.type_of(number, types).isNotNull() & ~x.prefix_of(number).isin(*x.NOT_REFERENCED), number)
    rest = _first(stem, r"^[A-Z]{2,5}-\d{3,6}[_ ]+(.+)$")
    return number, F.when(number.isNotNull() & ~rest.rlike(_VERSION), F.replace(rest, F.lit("_"), F.lit(" ")))


def _after(lines: Column, starts: str) -> Column:
    """The lines after the first that matches; none if none does."""
    found = F.array_position(F.transform(lines, lambda s: s.rlike(starts)), True).cast("int")
    return t.let(found, lambda at: F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>")))


def _until(lines: Column, stops: str) -> Column:
    """The lines before the first that matches."""
    found = lambda some: F.array_position(F.transform(some, lambda s: s.rlike(stops)), True).cast("int")
    return t.let(lines, lambda some: t.let(found(some), lambda at: F.when(at > 0, F.slice(some, 1, at - 1)).otherwise(some)))


def _at(lines: Column, place: int) -> Column:
    return F.try_element_at(lines, F.lit(place))


def _job(title: Column, confidence: float = 0.9, role: str = "doc_job_field", customer: Column | None = None) -> Column:
    return link("project", title, role, "HAS_DOCUMENT", False, confidence=confidence, title=title, customer=customer)


def mail(s: Settings) -> Column:
    text = F.col("text")
    head = F.substring_index(text, "\n\n", 1)
    body = F.substring(text, F.length(head) + 3, F.length(text))
    header = lambda name: _first(head, rf"(?m)^{name}: (.*)$")
    subject = F.coalesce(header("Subject"), F.lit(""))
    title = F.coalesce(
        _first(subject, r"(?i)^(?:RE|Fwd|FW):\s*(.+?)\s+(?:—|-)\s+schedule update"), _first(subject, r"(?i)^(?:RE|Fwd|FW):\s*(.+?) site visit$"),
        _first(body, r"(?:concerning|regarding|schedule for|relating to)\s+([A-Z][\w&\- ]+?)[,.]"),
    )
    people = [_people(header(h), f"email_{h.lower()}", "SENT" if h == "From" else "RECEIVED") for h in ("From", "To", "Cc")]
    named = found("email", F.concat(F.lit("email:"), F.col("stem")), F.coalesce(_none(subject), F.col("stem")), [_job(title, 0.8, "email_subject", F.col("folder_company"))], people, date=header("Date"), subject=_none(subject))
    return F.when(F.col("kind") == "eml", named)


def contact_card(s: Settings) -> Column:
    text = F.col("text")
    name, org, email = (t.field(text, label, ".+?") for label in ("FN", "ORG", "EMAIL"))
    person = link("person", name, "vcard", "DESCRIBES", org=org, org_role="vcard_org", email=F.lower(email), phone=t.field(text, "TEL", ".+?"))
    return F.when(F.col("kind") == "vcf", found("contact_card", F.concat(F.lit("vcard:"), F.lower(F.coalesce(email, name, F.lit("")))), F.concat(F.lit("Contact card: "), name), [person]))


def meeting(s: Settings) -> Column:
    text = F.col("text")
    summary, visit = F.coalesce(t.field(text, "SUMMARY", ".+?"), F.lit("")), r"^Site visit\s+\W\s+(.+?)\s+\((.+)\)$"
    company = _first(summary, visit, 2)
    links = [link("company", company, "calendar_summary", "ADDRESSED_TO"), _job(_first(summary, visit), 0.9, "calendar_summary", company)]
    key = F.concat(F.lit("event:"), F.coalesce(t.field(text, "UID", ".+?"), F.col("stem")))
    return F.when(F.col("kind") == "ics", found("meeting", key, _none(summary), links, date=t.field(text, "DTSTART", ".+?")))


def business(s: Settings) -> Column:
    """Invoices, quotations, purchase orders and delivery notes: known by a heading in the first lines or by their number."""
    kind = lambda line: F.coalesce(*[F.when((line == h) | line.endswith(f" {h}"), F.lit(k)) for h, k in HEADINGS.items()])
    heading = _at(F.filter(F.transform(F.slice(F.col("lines"), 1, 15), kind), lambda k: k.isNotNull()), 1)
    text = F.replace(F.col("text"), F.lit(" | "), F.lit(" "))

    def known(v: Column) -> Column:
        head = F.struct(v["heading"].alias("heading"), v["text"].alias("text"), F.when(v["heading"].isNotNull() | x.type_of(v["number"], s.types).isin(*HEADINGS.values()), v["number"]).alias("number"))
        return t.let(head, lambda h: F.when(h["heading"].isNotNull() | h["number"].isNotNull(), _business(s, h["heading"], h["number"], h["text"])))

    return t.let(t.let(text, lambda v: F.struct(heading.alias("heading"), v.alias("text"), t.field(v, "No", r"[A-Z]{2,5}-\d+").alias("number"))), known)


def _business(s: Settings, heading: Column, number: Column, text: Column) -> Column:
    """What a business document with this heading or number says; each pattern passes over its text once."""
    in_name, _ = file_number(F.col("stem"), s.types)
    block = _until(_after(F.col("lines"), "(?i)^BILL TO"), "(?i)^(?:attn|description)")
    total = lambda label: _none(F.regexp_extract(text, rf"(?im)^[ \t]*({label}[ \t]*:?\s*{_AMOUNT})[ \t]*$", 1))
    parts = {
        "key": F.coalesce(number, in_name), "block": block, "job": t.field(text, "Job", ".+?"), "quote": t.field(text, "Quote Ref", r"[A-Z]{2,5}-\d+"), "total": total("TOTAL"),
        "described": F.regexp_extract_all(text, F.lit(_ITEM), 1),
    }

    def said(v: Column) -> Column:
        key, job, quote, described = v["key"], v["job"], v["quote"], v["described"]
        company, address = _at(v["block"], 1), _none(F.array_join(F.slice(v["block"], 2, F.greatest(F.size(v["block"]), F.lit(1))), ", "))
        code = lambda d: F.try_element_at(x.product_codes(d, s.types), F.lit(1))
        item = lambda d, c: F.when(c.isNotNull(), link("product", d, "line_item", "LISTS_PRODUCT", code=c, description=_none(F.replace(d, c, F.lit("")))))
        items = F.transform(described, lambda d: t.let(code(d), lambda c: item(d, c)))
        columns = F.struct(*[F.regexp_extract_all(text, F.lit(_ITEM), k).alias(n) for k, n in enumerate(("desc", "qty", "unit", "price", "total"), 1)])
        rows = t.let(columns, lambda c: F.transform(c["desc"], lambda _, i: F.struct(*[F.get(c[n], i).alias(n) for n in ("desc", "qty", "unit", "price", "total")])))
        links = [
            link("company", company, "bill_to", "ISSUED_TO", address=address), link("person", t.field(text, "Attn", ".+?"), "attn", "ATTENTION_OF", org=company, org_role="bill_to"),
            _job(job, customer=F.coalesce(company, F.col("folder_company"))), link("document", quote, "reference", "REFERENCES", key=quote, doc_type="quote"),
        ]
        return found(
            F.coalesce(heading, x.type_of(key, s.types)), key, key, links, [F.filter(items, lambda i: i.isNotNull())], date=t.field(text, "Date", DATE), job_title=job, total=t.money(v["total"]), subtotal=t.money(total("Subtotal")),
            currency=F.coalesce(t.currency(v["total"]), t.currency(_first(text, _ITEM, 0))), line_items=F.when(F.size(described) > 0, F.to_json(rows)),
        )

    return t.let(F.struct(*[c.alias(n) for n, c in parts.items()]), said)


def drawing(s: Settings) -> Column:
    text = F.col("text")
    number, customer = t.field(text, "Drawing No", r"DWG-\d+"), t.field(text, "Customer", ".+?")
    links = [link("company", customer, "drawing_customer", "ISSUED_TO"), _job(t.field(text, "Job", ".+?"), customer=F.coalesce(customer, F.col("folder_company"))), _staff(s, t.field(text, "Drawn By", ".+?"), "drawn_by")]
    return F.when(number.isNotNull(), found("drawing", number, t.field(text, "Title", ".+?"), links, revision=t.field(text, "Rev", ".+?")))


def _staff(s: Settings, name: Column, role: str) -> Column:
    """Someone who wrote a document of the owner's."""
    return link("person", name, role, "AUTHORED", False, org=F.lit(s.owner) if s.owner else None, org_role="implied_owner")


def calibration(s: Settings) -> Column:
    text = F.col("text")
    number = t.field(text, "Certificate No", r"CAL-\d+")
    attrs = {k: t.field(text, label, ".+?") for k, label in (("instrument", "Instrument"), ("serial", "Serial No"), ("date", "Calibration Date"), ("result", "Result"))}
    return F.when(number.isNotNull(), found("calibration_cert", number, number, [_staff(s, t.field(text, "Technician", ".+?"), "technician")], **attrs))


def specification(s: Settings) -> Column:
    text, head = F.col("text"), r"(?m)^([A-Z]{2,4}-\d{2,4}) · (Technical Specification|Datasheet)"
    code, number = _first(text, head), _first(text, r"Doc No:\s*(\S+)")
    kind = F.when(_first(text, head, 2) == "Datasheet", "datasheet").otherwise("specification")
    title = F.concat(code, F.lit(" "), _first(text, head, 2), F.coalesce(F.concat(F.lit(" ("), number, F.lit(")")), F.lit("")))
    return F.when(code.isNotNull(), found(kind, number, title, [link("product", code, "spec_title", "DESCRIBES", code=code)]))


def manual(s: Settings) -> Column:
    first, second = _at(F.col("lines"), 1), _at(F.col("lines"), 2)
    code = _first(first, r"^([A-Z]{2,4}-\d{2,4})(?:-\d+)?$")
    named = found("manual", F.concat(F.lit("manual:"), first), F.concat_ws(" ", first, second), [link("product", code, "manual_title", "DESCRIBES", code=code)], date=_first(F.col("text"), f"({DATE})"))
    return F.when(code.isNotNull() & second.contains("Manual"), named)


def certificate(s: Settings) -> Column:
    text, lines = F.col("text"), F.col("lines")
    subject = _at(_after(lines, "certif.*that"), 1)
    iso = t.field(text, "Certificate No", r"ISO-\d+")
    body = link("company", t.field(text, "Certification Body", ".+?"), "certification_body", "ISSUED_BY")
    first = found("iso_certificate", iso, F.concat(_at(lines, 2), F.lit(" certificate ("), iso, F.lit(")")), [link("company", subject, "certified_company", "HOLDS", False), body], valid_until=t.field(text, "Valid until", ".+?"))
    number = _first(F.col("stem"), r"(\d+)")
    holder = link("person", subject, "certificate_holder", "HOLDS", False, org=F.when(F.col("area") == "HR", F.lit(s.owner)) if s.owner else None, org_role="implied_owner")
    provider = link("company", t.field(text, "Training Provider", ".+?"), "training_provider", "ISSUED_BY")
    second = found("training_certificate", F.concat(F.lit("CERT-"), number), F.concat(F.initcap(_at(lines, 1)), F.lit(" – "), subject), [holder, provider], expiry=_first(text, rf"Expiry:\s*({DATE})"))
    return F.when(text.rlike("certif(?:y|ies) that"), F.when(iso.isNotNull(), first).otherwise(second))


def contract(s: Settings) -> Column:
    text, parties = F.col("text"), r"(?m)^Between (.+?) and (.+)$"
    one, two, base = _first(text, parties), _first(text, parties, 2), t.base_stem(F.col("stem"))
    key = F.concat(F.lit("contract:"), F.coalesce(F.col("folder_job"), F.col("path")), F.lit(":"), base)
    title = F.concat(_at(F.col("lines"), 1), F.lit(" ("), F.replace(F.replace(base, F.lit("Contract_"), F.lit("")), F.lit("_"), F.lit(" ")), F.lit(")"))
    links = [link("company", c, "contract_party", "PARTY_TO", False) for c in (one, two)]
    return F.when(one.isNotNull(), found("contract", key, title, [*links, _job(t.field(text, "Relating to", ".+?"), customer=F.col("folder_company"))]))


def report(s: Settings) -> Column:
    text, dated = F.col("text"), rf"Date:\s*({DATE})\s+Author:\s*(.+)"
    author = _first(text, dated, 2)
    named = found("report", F.concat(F.lit("report:"), F.col("stem")), F.replace(F.col("stem"), F.lit("_"), F.lit(" ")), [_staff(s, author, "report_author")], date=_first(text, dated))
    return F.when(author.isNotNull() & text.contains("Internal Report"), named)


def service_report(s: Settings) -> Column:
    text, made = F.col("text"), rf"Prepared by (.+?) on ({DATE})"
    author = _first(text, made)
    return F.when(author.isNotNull(), found("report", F.lit(None).cast("string"), _at(F.col("lines"), 1), [_staff(s, author, "report_author")], date=_first(text, made, 2)))


def letter(s: Settings) -> Column:
    text, lines = F.col("text"), F.col("lines")
    place = lambda some, pattern: F.array_position(F.transform(some, lambda v: v.rlike(pattern)), True).cast("int")
    dated, opening = place(F.slice(lines, 1, 12), f"^{DATE}$"), place(lines, "^(?:Re:|Dear )")
    block = F.slice(lines, dated + 1, F.greatest(opening - dated - 1, F.lit(0)))
    opener = F.try_element_at(lines, F.greatest(opening, F.lit(1)))
    subject = _first(opener, r"^Re:(.*)$")
    number = F.when(F.lower(F.col("stem")).startswith("letter"), _first(F.col("stem"), r"(\d+)"))
    key = F.concat(F.lit("LETTER-"), number)
    job = F.coalesce(_first(subject, "^[^·]*·(.*)$"), _first(text, r"(?:regarding|progress with|schedule for|concerning)\s+([A-Z][\w&\- ]+?)[,.]"))
    recipient = link("company", _at(block, 1), "letter_recipient", "ADDRESSED_TO", address=_none(F.array_join(F.slice(block, 2, F.greatest(F.size(block), F.lit(1))), ", ")))
    employer = (lambda o: F.when(o["next"].contains(s.owner.split(" ")[0]), F.lit(s.owner))) if s.owner else (lambda o: F.lit(None).cast("string"))
    signed = F.transform(sign_offs(lines), lambda o: link("person", o["name"], "signatory", "AUTHORED", False, org=employer(o), org_role="implied_owner", job_title=_none(F.substring_index(o["next"], ",", 1))))
    named = found("letter", key, F.coalesce(key, F.col("stem")), [recipient, _job(job, customer=F.col("folder_company"))], [signed], date=F.try_element_at(lines, F.greatest(dated, F.lit(1))), subject=subject)
    return F.when((dated > 0) & (opening > dated) & (F.size(sign_offs(lines)) > 0), named)


def meeting_notes(s: Settings) -> Column:
    attendees = t.field(F.col("text"), "Attendees", ".+?")
    people = F.transform(F.split(F.coalesce(attendees, F.lit("")), r",|\band\b"), lambda n: link("person", n, "attendee", "ATTENDED", False))
    return F.when(attendees.isNotNull(), found("meeting_notes", F.lit(None).cast("string"), _at(F.col("lines"), 1), more=[people]))


def item_list(s: Settings) -> Column:
    cell = lambda line: F.split(line, r"\s*[|,]\s*")[0]
    code = lambda line: F.try_element_at(x.product_codes(cell(line), s.types), F.lit(1))
    items = F.transform(F.filter(F.col("lines"), lambda v: code(v).isNotNull()), lambda v: link("product", cell(v), "line_item", "LISTS_PRODUCT", code=code(v), description=_none(F.replace(cell(v), code(v), F.lit("")))))
    kind = F.when(F.lower(F.col("path")).contains("price"), "price_list").otherwise("item_list")
    return F.when(F.lower(cell(_at(F.col("lines"), 1))).isin("item", "description"), found(kind, F.lit(None).cast("string"), F.replace(F.col("stem"), F.lit("_"), F.lit(" ")), more=[items]))


def screenshot(s: Settings) -> Column:
    """A table of jobs that was read off a picture: lines with a job id."""
    if not s.job_id:
        return F.lit(None).cast(FOUND)
    rows = F.filter(F.col("lines"), lambda v: v.rlike(s.job_id))
    jobs = F.transform(rows, lambda v: link("project", F.regexp_extract(v, s.job_id, 0), "screenshot_row", "HAS_DOCUMENT", False, job_id=F.regexp_extract(v, s.job_id, 0)))
    return F.when(F.col("kind").isin("png", "jpg") & (F.size(rows) > 0), found("screenshot", F.lit(None).cast("string"), F.col("stem"), more=[jobs]))


#: In the order in which they are tried; a list of one's own can be given to ``extract_files``.
TEMPLATES = (mail, contact_card, meeting, business, drawing, calibration, specification, manual, certificate, letter, contract, report, service_report, meeting_notes, item_list, screenshot)


def by_name(s: Settings) -> Column:
    """The document of a file that no template fits, by its name; a file without text that was read has none."""
    number, _ = file_number(F.col("stem"), s.types)
    named = found(F.coalesce(x.type_of(number, s.types), F.lit("other")), number, F.coalesce(number, F.col("stem")), unread=F.when(F.col("blank"), "1"))
    return F.when(~F.col("blank") | (F.col("status") == "needs_ocr"), named)


def free_text(s: Settings, text: Column, lines: Column) -> Column:
    """Links that plain text gives: people in address lines and signature blocks, companies with a legal suffix, labelled numbers.

    A signature block is a closing line, a name, and up to three lines, of which the first with a company says organisation and job title.
    """
    mail = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
    heads = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^(?:From|To|Cc):[ \t]*(.+)$"), 1), ", ")
    written = F.transform(addresses(heads), lambda a: link("person", a["name"], "free_text", "MENTIONS", confidence=0.6, email=a["email"]))

    def signature(place: Column) -> Column:
        block = F.slice(lines, place + 2, F.lit(3))
        stated = F.try_element_at(F.filter(block, lambda v: F.size(t.company_names(v)) > 0), F.lit(1))
        title = F.when(F.instr(stated, ",") > 1, _none(F.substring_index(stated, ",", 1)))
        email = _first(F.array_join(block, "\n"), f"({mail})")
        return link("person", F.try_element_at(lines, place + 1), "free_text", "MENTIONS", confidence=0.6, org=_at(t.company_names(F.coalesce(stated, F.lit(""))), 1), org_role="free_text", email=F.lower(email), job_title=title)

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.coalesce(F.try_element_at(lines, i), F.lit("")).rlike(SIGN_OFF))
    named = F.transform(t.company_names(text), lambda n: link("company", n, "free_text", "MENTIONS", confidence=0.6))
    if s.owner:
        named = F.filter(named, lambda k: F.lower(k["surface"]) != s.owner.lower())
    of_kind = lambda kind, label: F.transform(F.regexp_extract_all(text, F.lit(x.labelled(label)), 1), lambda n: F.struct(n.alias("number"), F.lit(kind).alias("kind")))
    numbers = F.array_distinct(F.flatten(F.array(*[of_kind(*item) for item in x.LABELS.items()])))
    labelled = F.transform(numbers, lambda n: link("document", n["number"], "free_text", "MENTIONS", confidence=0.6, key=n["number"], doc_type=n["kind"]))
    return F.concat(written, F.transform(places, signature), named, labelled)


def learned_types(files: DataFrame, types: dict[str, str] | None = None) -> dict[str, str]:
    """Types of number prefixes, the known ones and those that labels such as "Invoice No: HR-1042" teach: the first label
    in file order wins. The driver gets one row for each unknown prefix."""
    types = dict(x.TYPE_OF_PREFIX if types is None else types)
    text = F.coalesce("text", F.lit(""))
    rows = None
    for doc_type, label in x.LABELS.items():
        numbers = files.select("id", F.explode(F.regexp_extract_all(text, F.lit(x.labelled(label)), 1)).alias("number")).select("id", x.prefix_of(F.col("number")).alias("prefix"), F.lit(doc_type).alias("doc_type"))
        rows = numbers if rows is None else rows.unionByName(numbers)
    new = rows.filter(~F.col("prefix").isin(*types, *x.NO_DOCUMENT)).groupBy("prefix").agg(F.min_by("doc_type", F.struct("id", "doc_type")).alias("doc_type"))
    return types | {r["prefix"]: r["doc_type"] for r in new.collect()}


def _key(etype: Column | str, surface: Column, role: Column | str) -> Column:
    return F.concat_ws("\u0001", *[c if isinstance(c, Column) else F.lit(c) for c in (etype, surface, role)])


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns, each evaluated once: as the output of a generator they are not put in place of their names."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _mention(etype: str, surface: Column, role: str, attrs: Column, confidence: float = 1.0) -> Column:
    return F.struct(F.lit(etype), surface, F.lit(role), attrs, F.lit(confidence)).cast(MENTION)


def extract_files(files: DataFrame, settings: Settings | None = None, templates: Sequence = TEMPLATES) -> DataFrame:
    """``file_id, mentions, facts`` of each file: mentions in order, each spelling in a role once, and facts between their places.

    First the folder's company and project, then the file's document, the template's mentions, what the file's
    name says, what the text refers to, and what plain text names.
    """
    s = settings or Settings()
    rows = files.filter("status != 'skipped' and kind != 'zip'").select(
        F.col("id").alias("file_id"), "path", "kind", "status", "area", "folder_company", "folder_job", "folder_job_id", "folder_job_title", F.coalesce("text", F.lit("")).alias("text"), F.substring("sha256", 1, 16).alias("sha")
    )
    rows = _once(rows, lines=t.lines(F.col("text")), stem=t.stem(F.col("path")), blank=F.trim("text") == "")
    rows = _once(rows, template=F.when(~F.col("blank"), F.coalesce(*[make(s) for make in templates])))
    rows = _once(rows, doc=F.coalesce("template", by_name(s)), known=F.col("template").isNotNull())
    rows = _once(rows, key=F.coalesce("doc.key", F.concat(F.lit("file:"), F.col("sha"))))
    key = F.col("key")
    _, company = file_number(F.col("stem"), s.types)
    code = F.try_element_at(x.product_codes(F.col("stem"), s.types), F.lit(1))
    named = [link("company", company, "filename", "ISSUED_TO", confidence=0.7, truncated="1"), link("product", code, "filename", "DESCRIBES", confidence=0.8, code=code)]
    # Of a mail only subject and body are read as text: its headers are the template's.
    is_mail = F.coalesce(F.col("doc.doc_type") == "email", F.lit(False))
    at_body = F.instr("text", "\n\n")
    body = F.when(at_body > 0, F.expr("substr(text, instr(text, '\\n\\n') + 2)")).otherwise("")
    rows = _once(rows, is_mail=is_mail, is_plain=~F.col("known") | F.coalesce(F.col("doc.doc_type").isin("letter", "meeting_notes", "email"), F.lit(False)))
    said = F.when(F.col("is_mail"), F.concat_ws("\n", F.col("doc.attrs")["subject"], body)).otherwise(F.col("text"))
    # Of a mail the body alone, of other files the text; for files that are not read as plain text nothing is prepared.
    plain_text = F.when(F.col("is_plain") & F.col("is_mail"), body).when(F.col("is_plain"), F.col("text")).otherwise("")
    rows = _once(rows, said=said, plain_text=plain_text)
    rows = _once(rows, plain_lines=F.when(F.col("is_mail"), t.lines(F.col("plain_text"))).otherwise(F.col("lines")))
    refs = F.transform(F.filter(x.references(F.col("said"), s.types), lambda n: n != key), lambda n: link("document", n, "reference", "REFERENCES", confidence=0.9, key=n, doc_type=x.type_of(n, s.types)))
    jobs = F.transform(F.array_distinct(F.regexp_extract_all("said", F.lit(s.job_id), 0)), lambda j: link("project", j, "reference", "HAS_DOCUMENT", False, confidence=0.9, job_id=j)) if s.job_id else F.array().cast(f"array<{LINK}>")
    plain = F.when(F.col("is_plain"), F.filter(free_text(s, F.col("plain_text"), F.col("plain_lines")), lambda k: ~((k["etype"] == "document") & (k["surface"] == key)))).otherwise(F.array().cast(f"array<{LINK}>"))
    none = F.array().cast(f"array<{LINK}>")
    rows = _once(rows, stated=F.filter(F.concat(F.coalesce("doc.links", none), F.array(*named), refs, jobs), lambda k: k["surface"].isNotNull()), plain=plain)
    linked = F.transform("stated", lambda k: F.struct(k["etype"], F.lower(k["surface"])))
    rows = _once(rows, links=F.concat("stated", F.filter("plain", lambda k: k["surface"].isNotNull() & ~F.array_contains(linked, F.struct(k["etype"], F.lower(k["surface"]))))))
    project = F.coalesce("folder_job_title", "folder_job", "folder_job_id")
    version = F.when(t.base_stem(F.col("stem")) != F.col("stem"), F.col("stem"))
    attrs = F.map_concat(_map(key=key, doc_type=F.coalesce("doc.doc_type", F.lit("other")), version=version), F.map_filter(F.coalesce("doc.attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("key", "doc_type", "version")))
    known = F.col("doc").isNotNull()
    title = F.coalesce(_clean(F.col("doc.title")), key)
    own = [
        F.when(F.col("folder_company").isNotNull(), _mention("company", F.col("folder_company"), "folder", _map(role="customer"))),
        F.when(project.isNotNull(), _mention("project", project, "folder", _map(job_id=F.col("folder_job_id"), title=F.col("folder_job_title"), customer=F.col("folder_company"), folder="1"))),
        F.when(known, _mention("document", title, "self", attrs)),
    ]
    org_domain = lambda k: F.when(k["org_role"] == "email_domain", _map(domain=k["org"]))
    further = F.flatten(F.transform("links", lambda k: F.array(
        F.when(k["org"].isNotNull(), F.struct(F.lit("company"), k["org"], k["org_role"], org_domain(k), F.when(k["org_role"] == "implied_owner", 0.8).when(k["org_role"] == "email_domain", 0.9).otherwise(k["confidence"])).cast(MENTION)),
        F.struct(k["etype"], k["surface"], k["role"], F.when(k["org"].isNotNull(), F.map_concat(F.coalesce(k["attrs"], F.create_map().cast("map<string,string>")), F.map_from_arrays(F.array(F.lit("organisation")), F.array(k["org"])))).otherwise(k["attrs"]), k["confidence"]).cast(MENTION),
    )))
    rows = _once(rows, all=F.filter(F.concat(F.array(*own), further), lambda m: m.isNotNull()), title=title)
    rows = _once(rows, keys=F.transform("all", lambda m: _key(m["etype"], m["surface"], m["role"])))
    rows = _once(rows, places=F.array_distinct("keys"))
    title = F.col("title")
    doc, folder, job = _key("document", title, "self"), _key("company", F.col("folder_company"), "folder"), _key("project", project, "folder")
    edge = "struct<src:string,rel:string,dst:string>"
    make = lambda src, rel, dst: F.struct(src, rel, dst).cast(edge)
    between = F.flatten(F.transform("links", lambda k: F.array(
        F.when(k["org"].isNotNull(), make(_key(k["etype"], k["surface"], k["role"]), F.lit("WORKS_FOR"), _key("company", k["org"], k["org_role"]))),
        F.when(known, F.when(k["out"], make(doc, k["rel"], _key(k["etype"], k["surface"], k["role"]))).otherwise(make(_key(k["etype"], k["surface"], k["role"]), k["rel"], doc))),
    )))
    filed = F.when(known, F.when(project.isNotNull(), make(job, F.lit("HAS_DOCUMENT"), doc)).when(F.col("folder_company").isNotNull(), make(doc, F.lit("FILED_UNDER"), folder)))
    owns = F.when(project.isNotNull() & F.col("folder_company").isNotNull(), make(folder, F.lit("HAS_PROJECT"), job))
    rows = _once(rows, edges=F.array_distinct(F.filter(F.concat(F.array(owns), between, F.array(filed)), lambda e: e.isNotNull() & e["rel"].isNotNull())))
    at = lambda c: F.array_position("places", c) - 1
    empty = F.create_map().cast("map<string,string>")

    def merged(place: Column) -> Column:
        """The mentions of one place as one, with all their attributes; of different values of one attribute the last stays."""
        same = F.filter("all", lambda _, i: F.get("keys", i) == place)
        attrs = F.aggregate(same, empty, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.coalesce(F.map_contains_key(m["attrs"], k), F.lit(False))), F.coalesce(m["attrs"], empty)))
        return F.get(same, 0).withField("attrs", F.when(F.exists(same, lambda m: m["attrs"].isNotNull()), attrs))

    return rows.select(
        "file_id",
        F.transform("places", merged).alias("mentions"),
        F.transform("edges", lambda e: F.struct(at(e["src"]).alias("src"), e["rel"].alias("rel"), at(e["dst"]).alias("dst"))).alias("facts"),
    )


def _place(column: str) -> Column:
    """A place within a file; more than ids have room for end the job, as they would run into the next file's."""
    return F.when(F.col(column) < (1 << FILE_BITS) - 1, F.col(column)).otherwise(F.raise_error(F.lit(f"a file has more than 2^{FILE_BITS} mentions or facts")).cast("int"))


def mention_rows(extracted: DataFrame) -> DataFrame:
    """``id, file_id, pos, etype, surface, role, attrs, confidence``; ids ascend with file and place."""
    rows = extracted.select("file_id", F.posexplode("mentions").alias("pos", "m"))
    return rows.select((F.col("file_id") * (1 << FILE_BITS) + _place("pos")).alias("id"), "file_id", "pos", "m.*")


def fact_rows(extracted: DataFrame) -> DataFrame:
    """``id, file_id, src, rel, dst`` between mentions; a fact from a mention to itself is none."""
    rows = extracted.select("file_id", F.posexplode("facts").alias("pos", "f")).filter("f.src >= 0 and f.dst >= 0 and f.src != f.dst")
    base = F.col("file_id") * (1 << FILE_BITS)
    return rows.select((base + _place("pos")).alias("id"), "file_id", (base + F.col("f.src")).alias("src"), "f.rel", (base + F.col("f.dst")).alias("dst"))


def named_facts(extracted: DataFrame) -> DataFrame:
    """``file_id, src, rel, dst`` with the mentions themselves as ends, looked up within each file's row."""
    rows = extracted.select("file_id", F.col("mentions").alias("m"), F.posexplode("facts").alias("pos", "f")).filter("f.src >= 0 and f.dst >= 0 and f.src != f.dst")
    return rows.filter(_place("pos") >= 0).select("file_id", F.get("m", F.col("f.src")).alias("src"), "f.rel", F.get("m", F.col("f.dst")).alias("dst"))


def attachments(files: DataFrame, mentions: DataFrame) -> DataFrame:
    """``file_id, src, rel, dst``: a member's own document is ATTACHED_TO its container's."""
    own = mentions.filter("role = 'self'").select("file_id", F.col("id").alias("own"))
    inner = files.filter("parent_id is not null").select(F.col("id").alias("file_id"), "parent_id").join(own, "file_id")
    return inner.join(own.toDF("parent_id", "dst"), "parent_id").select("file_id", F.col("own").alias("src"), F.lit("ATTACHED_TO").alias("rel"), "dst")
