"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming removes: U+0000 to U+0020.
BLANK = "".join(map(chr, range(0x21)))


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is evaluated once; what a branch of a condition names several times is evaluated as often otherwise."""
    return F.get(F.transform(F.array(value), lambda v: make(v)), F.lit(0))


def filled(text: Column) -> Column:
    """A text, null if it is empty."""
    return F.get(F.filter(F.array(text), lambda v: v != ""), F.lit(0))


def lines(text: Column) -> Column:
    """A text's lines, trimmed, without blank ones."""
    return F.filter(F.split(F.btrim(text, F.lit(BLANK)), r"(?<![\x00-\x20])[\x00-\x20]*\n[\x00-\x20]*"), lambda x: x != "")


def first_line(text: Column) -> Column:
    return F.try_element_at(lines(text), F.lit(1))


def collapse_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(BLANK))


def _accented() -> tuple[str, str]:
    """Letters of the Latin blocks up to U+024F and U+1E00 to U+1EFF that are a plain letter with marks, and those letters; then marks alone."""
    letters = [chr(c) for c in (*range(0x100, 0x250), *range(0x1E00, 0x1F00))]
    parts = [(x, "".join(y for y in unicodedata.normalize("NFD", x) if not unicodedata.category(y).startswith("M"))) for x in letters]
    plain = [(x, y) for x, y in parts if len(y) == 1 and x != y]
    return "".join(x for x, _ in plain) + "".join(map(chr, range(0x300, 0x370))), "".join(y for _, y in plain)


_EXTENDED = _accented()


def plain_letters(text: Column) -> Column:
    """German umlauts spelled out, then accents dropped."""
    out = text
    for marked, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        out = F.replace(out, F.lit(marked), F.lit(plain))
    out = F.translate(out, *_EXTENDED)
    return F.translate(out, "àáâãåçèéêëìíîïñòóôõùúûýÿÀÁÂÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÙÚÛÝ", "aaaaaceeeeiiiinoooouuuyyAAAAACEEEEIIIINOOOOUUUY")


# Words that company names are compared without.
STOP_WORDS = ("and", "the", "of")
LEGAL_SUFFIXES = (
    "ltd", "lt", "limited", "inc", "incorporated", "co", "corp", "corporation", "plc", "llc", "llp", "lp", "company", "gmbh", "ag", "kg", "ug", "sa", "sarl", "sas", "bv", "nv", "srl", "spa",
    "oy", "pty", "pte", "bhd", "kk", "sro", "kft",
)
GENERIC_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.uk", "ymail.com", "icloud.com", "me.com", "mac.com", "aol.com", "proton.me",
    "protonmail.com", "gmx.de", "gmx.net", "gmx.com", "web.de", "t-online.de", "mail.com", "zoho.com", "yandex.ru", "btinternet.com", "orange.fr", "free.fr", "libero.it", "qq.com", "163.com",
)


def company_words(name: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Lower-case words of a company's name, without stop words and trailing legal suffixes; one word always stays."""
    plain = F.regexp_replace(F.replace(F.lower(plain_letters(name)), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]", " ")
    words = F.filter(F.split(plain, " +"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    kept = F.aggregate(
        F.reverse(words),
        F.array().cast("array<string>"),
        lambda acc, w: F.when((F.size(acc) == 0) & w.isin(*suffixes), acc).otherwise(F.concat(acc, F.array(w))),
        lambda acc: F.reverse(acc),
    )
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 1))


def company_key(name: Column) -> Column:
    return F.array_join(company_words(name), " ")


def has_legal_suffix(name: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Whether any word of a name is a legal suffix."""
    words = F.split(F.regexp_replace(F.lower(plain_letters(name)), "[^a-z0-9]+", " "), " ")
    return F.coalesce(F.exists(words, lambda w: w.isin(*suffixes)), F.lit(False))


def person_key(name: Column) -> Column:
    """A person's name for comparison: plain lower-case letters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(plain_letters(name)), "[^a-z]+", " "))


def person_key_folded(name: Column) -> Column:
    """The key with spelled-out umlauts folded to the bare vowel."""
    return F.replace(F.replace(F.replace(person_key(name), F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u"))


def person_initial_form(name: Column) -> Column:
    """First initial and last word of a person's key."""
    parts = F.split(person_key(name), " ")
    return F.concat_ws(" ", F.substring(parts[0], 1, 1), F.element_at(parts, -1))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


HONORIFIC = r"^(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau)\.?\s+"


def clean_person(raw: Column) -> Column:
    """A name of two to four capitalised words, without its honorific; null for anything else."""
    name = collapse_spaces(F.regexp_replace(raw, HONORIFIC, ""))
    return let(name, lambda v: F.when(v.rlike(r"^\p{Lu}[\p{L}'’.-]*(?: \p{Lu}[\p{L}'’.-]*){1,3}$"), v))


def stem(path: Column) -> Column:
    """A file's name without folders, archive path and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/:]*)$", 1), r"(?<=.)\.[^.]*$", "")


def base_stem(name: Column) -> Column:
    """A stem without what marks a version or copy."""
    return F.regexp_replace(name, r"(?i)[ _-]*(?:\(\d+\)|v\d+|rev[ _]?[a-z0-9]|final|copy|draft)$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def field(text: Column, label: str, value: str = r"[^\n]+?") -> Column:
    """What follows ``label``, with or without a colon, at the start of a line, or ``label:`` within one; null where nothing does.
    The value reaches to the line's end."""
    return filled(F.regexp_extract(text, rf"(?im)(?:^[ \t]*{label}\b[ \t]*:?|(?<=\s){label}[ \t]*:)[ \t]*({value})[ \t\r]*$", 1))


#: Legal suffixes as texts write them after a company's name.
_SUFFIX = "|".join(s.upper() + "|" + s.capitalize() for s in LEGAL_SUFFIXES if s not in ("company", "spa", "sa", "ag", "co")) + "|AG|SA|Co|GmbH|SpA|Sarl|PLC|LLP|LLC"
#: A word of a name; a stop after it ends a sentence, and the name with it.
_WORD = r"\p{Lu}(?:[\p{L}\p{N}'’-]|\.(?=[\p{L}\p{N}]))*"
_NAME = rf"(?<![\p{{L}}\p{{N}}])((?:{_WORD}[ ](?:(?:&|and|of|the)[ ])?){{1,5}}(?:{_SUFFIX})\.?)(?![\p{{L}}\p{{N}}])"
_LEAD = r"^(?:(?:The|And|Our|At|In|For|With|From|To|By|Of|Dear|Between|This|That|We|As|On|If)\s+)+(?=\S+\s)"


def company_names(text: Column) -> Column:
    """Distinct names in running text that end in a legal suffix, without words that only begin a sentence."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_NAME), 1), lambda n: F.regexp_replace(n, _LEAD, ""))
    return F.array_distinct(F.filter(F.transform(names, collapse_spaces), lambda n: n.contains(" ") & ~n.rlike("(?i)limited to")))


def money(text: Column) -> Column:
    """The first amount of a text as a double: both ``1,234.50`` and ``1.234,50`` are read."""
    raw = F.regexp_extract(text, r"\d[\d.,]*", 0)

    def read(raw: Column) -> Column:
        comma = raw.rlike(r"^\d{1,3}(?:\.\d{3})*,\d{1,2}$") | raw.rlike(r"^\d+,\d{1,2}$")
        number = F.when(comma, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
        return F.when(~comma & raw.rlike(r"^\d{1,3}(?:\.\d{3}){2,}$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(number)

    return let(F.regexp_replace(raw, r"[.,]+$", ""), read).try_cast("double")


def currency(text: Column) -> Column:
    """GBP, EUR or USD by the first sign or code of a text; null where there is none."""
    sign = F.upper(F.regexp_extract(text, r"(?i)(£|€|\$|\bGBP\b|\bEUR\b|\bUSD\b)", 1))
    return let(sign, lambda s: F.when(s.isin("£", "GBP"), "GBP").when(s.isin("€", "EUR"), "EUR").when(s.isin("$", "USD"), "USD"))


def email_domains(text: Column) -> Column:
    """Domains of the e-mail addresses in a text, in lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1), F.lower)


def is_generic_domain(domain: Column, generic: tuple[str, ...] = GENERIC_DOMAINS) -> Column:
    return F.lower(domain).isin(*generic)
