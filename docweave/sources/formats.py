"""Kinds of file by content, members of containers, and the text of each kind; standard library only."""

from __future__ import annotations

import codecs
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

CODE = frozenset("py js ts java c h cpp cs go rs rb php sh bat ps1 sql css".split())
OCR_KINDS = frozenset(["pdf", "png", "jpg"])
IGNORED_KINDS = frozenset(["code", "media", "binary"])
#: Characters of a text that the reference keeps (Config.MAX_STORED_TEXT_CHARS); here whole texts are kept unless a cap is given.
TEXT_CAP = 60_000
#: Control characters that texts do not hold; tabs, line and page ends, backspace, escape and DOS's end of file are left out.
_CONTROL = re.compile(rb"[\x00-\x06\x0e-\x19\x1c-\x1f]")
_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9-]*:[ \t]")
_MAIL = re.compile(rb"(?im)^(?:From|MIME-Version|Content-Type):")


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1].rsplit("::", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def _zip_kind(data: bytes) -> str:
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return "corrupt"
    if not names:
        return "corrupt"
    for prefix, kind in (("word/", "docx"), ("xl/", "xlsx")):
        if any(n.startswith(prefix) for n in names):
            return kind
    return "zip"


def _is_text(data: bytes) -> bool:
    """UTF-8 in its first bytes (a character may go on beyond them), or Latin-1: no control characters and
    not filled with 0xFF bytes, which are rare as the letter that they stand for."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data[:4096], final=False)
        return True
    except UnicodeDecodeError:
        return not _CONTROL.search(data) and data.count(b"\xff") * 10 <= len(data)


def sniff(data: bytes, path: str) -> str:
    """A file's kind by its content; the name matters only for source code."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK"):
        return _zip_kind(data)
    if data.startswith(b"\x89PNG"):
        return "png"
    if data.startswith(b"\xff\xd8"):
        return "jpg"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith((b"ID3", b"RIFF")) or data[4:8] == b"ftyp" or (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        return "media"
    if extension(path) in CODE or "/.git/" in f"/{path}":
        return "code"
    if not _is_text(data):
        return "binary"
    head = data.lstrip()[:64].upper()
    if head.startswith(b"BEGIN:VCARD"):
        return "vcf"
    if head.startswith(b"BEGIN:VCALENDAR"):
        return "ics"
    lines = data[:4096].split(b"\n")
    if len(lines) >= 2 and all(_HEADER.match(x) for x in lines[:2]) and _MAIL.search(data[:4096].split(b"\n\n")[0]):
        return "eml"
    return "text"


def _member_name(item: zipfile.ZipInfo) -> str:
    """A member's name: UTF-8 where it is that, flagged or not, else the archive's own code page."""
    if item.flag_bits & 0x800:
        return item.filename
    try:
        return item.filename.encode("cp437").decode("utf-8")
    except UnicodeError:
        return item.filename


def members(data: bytes, kind: str, path: str) -> Iterator[tuple[str, bytes | Exception]]:
    """Paths and bytes of what a container holds: files of an archive, attachments of an e-mail. A member that can't be read, being
    damaged, encrypted or malformed, comes with the error in place of its bytes; the others still come."""
    if kind == "zip":
        archive = zipfile.ZipFile(io.BytesIO(data))
        for item in archive.infolist():
            name = _member_name(item)
            if not item.is_dir() and "__MACOSX" not in name:
                try:
                    yield f"{path}::{name}", archive.read(item)
                except Exception as error:  # noqa: BLE001 as many kinds as there are ways to break an archive
                    yield f"{path}::{name}", error
    elif kind == "eml":
        for n, part in enumerate(email.message_from_bytes(data, policy=email.policy.default).walk()):
            try:
                name = part.get_filename()
                attached = not part.is_multipart() and (name or part.get_content_disposition() == "attachment")
                body = part.get_payload(decode=True) if attached else None
            except Exception as error:  # noqa: BLE001 headers of any form
                yield f"{path}::part-{n}", error
                continue
            if body:
                yield f"{path}::{name or 'attachment.bin'}", body


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _mail_text(data: bytes) -> str:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]]
    body = message.get_body(preferencelist=("plain",))
    return "\n".join(head) + "\n\n" + (body.get_content() if body else "")


def _rtf_text(data: bytes) -> str:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), data.decode("latin-1"))
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"\\par[d]?\b ?", "\n", text))).strip()


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _words(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == "t")


def _docx_text(data: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))[0]
    out = [_words(p) for p in body if _local(p) == "p"]
    for row in (r for t in body if _local(t) == "tbl" for r in t if _local(r) == "tr"):
        out.append(" | ".join(_words(c) for c in row if _local(c) == "tc"))
    return "\n".join(x for x in out if x.strip())


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    value = next((x.text or "" for x in cell if _local(x) == "v"), "")
    kind = cell.get("t")
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return _words(cell)
    if kind == "b":
        return "True" if value == "1" else "False"
    return value.removesuffix(".0")


def _xlsx_text(data: bytes) -> str:
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = archive.namelist()
    shared = [_words(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [x.get("name", "") for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for title, name in zip(titles, sheets, strict=False):
        out.append(f"# sheet: {title}")
        for row in (r for r in ElementTree.fromstring(archive.read(name)).iter() if _local(r) == "row"):
            cells = [_cell(c, shared) for c in row if _local(c) == "c"]
            if any(c.strip() for c in cells):
                out.append(" | ".join(cells))
    return "\n".join(out)


READERS = {"text": decode, "vcf": decode, "ics": decode, "eml": _mail_text, "rtf": _rtf_text, "docx": _docx_text, "xlsx": _xlsx_text}


def read(data: bytes, kind: str, cap: int | None = None) -> tuple[str, str | None, str | None]:
    """Status, text and error of a file's content; the text is whole, or its first ``cap`` characters (the reference: ``TEXT_CAP``)."""
    if kind == "zip":
        return "container", None, None
    if kind in IGNORED_KINDS:
        return "skipped", None, None
    if kind in OCR_KINDS:
        return "needs_ocr", None, None
    if kind not in READERS:
        return "empty", None, None
    try:
        text = READERS[kind](data)[:cap]
    except Exception as error:  # noqa: BLE001 a file that no reader understands is a result, not a failure of the job
        return "corrupt", None, str(error)[:500]
    return ("ok" if text.strip() else "empty"), text, None
