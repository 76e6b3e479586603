"""Scores of how well two spellings name one company, as Arrow-batched functions over distinct pairs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEGAL_SUFFIXES, STOP_WORDS

# Scores of the rules, and the bounds from which a match is accepted.
SPACING, ACRONYM, DOMAIN = 0.97, 0.85, 0.92
ABBREVIATION, EXPANSION, ONE_TYPO, TWO_TYPOS = 0.9, 0.85, 0.85, 0.75
MISSING_WORD = 0.08
ACCEPT, UNSURE = 0.80, 0.65

Match = tuple[float, frozenset[str]]
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"})


def plain(text: str) -> str:
    """Umlauts spelled out, all other accents dropped."""
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_UMLAUTS)) if not unicodedata.category(c).startswith("M"))


@lru_cache(1 << 16)
def company_words(name: str, with_suffixes: bool = False) -> tuple[str, ...]:
    """Lower-case words without stop words and, unless asked for, trailing legal suffixes; one word always stays."""
    words = [w for w in re.sub("[^a-z0-9 ]", " ", plain(name).lower().replace("&", " and ")).split() if w not in STOP_WORDS]
    while not with_suffixes and len(words) > 1 and words[-1] in LEGAL_SUFFIXES:
        words.pop()
    return tuple(words)


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        older, old = old, new
    return old[-1]


def ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; 100 for two empty texts."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def match_word(mention: str, candidate: str, cut: bool = False) -> tuple[float, str] | None:
    """How one word stands for another; a word that was cut off may be any prefix."""
    if mention == candidate:
        return 1.0, ""
    if (cut or len(mention) >= 3) and candidate.startswith(mention):
        return ABBREVIATION, "abbreviation"
    if len(candidate) >= 4 and mention.startswith(candidate):
        return EXPANSION, "expansion"
    shorter = min(len(mention), len(candidate))
    if shorter >= 5 and abs(len(mention) - len(candidate)) <= 2:
        distance = edit_distance(mention, candidate)
        if distance <= 1:
            return ONE_TYPO, "typo"
        if distance == 2 and shorter >= 8:
            return TWO_TYPOS, "typo"
    return None


def align(mention: tuple[str, ...], candidate: tuple[str, ...], truncated: bool) -> Match | None:
    """The best way to read the mention's words as the candidate's, filled in from the ends of both.

    A cell holds the score of the words from there on. Leftover words of either side cost a penalty each;
    the mention's only where the candidate has two words or more.
    """
    rows, columns = len(mention), len(candidate)
    best: dict[tuple[int, int], Match | None] = {}
    for j in range(columns + 1):
        best[rows, j] = (1 - MISSING_WORD * (columns - j), frozenset(["truncation"] * (j < columns)))
    for i in range(rows):
        best[i, columns] = (1 - MISSING_WORD * (rows - i), frozenset(["truncation"])) if columns >= 2 else None
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            found: Match | None = None
            for di, dj in ((1, 1), (2, 1), (1, 2)):
                if i + di > rows or j + dj > columns or (rest := best[i + di, j + dj]) is None:
                    continue
                word = match_word("".join(mention[i : i + di]), "".join(candidate[j : j + dj]), truncated and i + di == rows)
                joined = di + dj > 2
                if word is None or (joined and word[1] not in ("", "typo")):
                    continue
                left = rows - i - di
                score = (word[0] + rest[0] * left) / (left + 1) if left else word[0] * rest[0]
                rule = word[1] or ("spacing" if joined else "")
                if found is None or score > found[0]:
                    found = (score, rest[1] | {rule} if rule else rest[1])
            best[i, j] = found
    return best[0, 0]


def match_company(mention: str, candidate: str, truncated: bool = False) -> Match | None:
    """Score and rules by which a mention names a candidate, or None."""
    a, b = company_words(mention), company_words(candidate)
    if not a or not b:
        return None
    if a == b:
        return 1.0, frozenset(["normalized"])
    if "".join(a) == "".join(b):
        return SPACING, frozenset(["spacing"])
    if len(a) == 1 and 2 <= len(a[0]) <= 5 and len(b) >= 2 and a[0] == "".join(w[0] for w in b):
        return ACRONYM, frozenset(["acronym"])
    if a[0][0] != b[0][0] or (found := align(a, b, truncated)) is None:
        return None
    return int(found[0] * 1000 + 0.5) / 1000, found[1] or frozenset(["normalized"])


def match_domain(domain: str, candidate: str) -> Match | None:
    """An e-mail domain's first label as the candidate's first word and then prefixes, of two letters or more, of the next
    words; legal words may be passed over."""
    label = re.sub("[^a-z0-9]", "", domain.lower().split(".")[0])
    words = company_words(candidate, True)
    if not label or not words or not label.startswith(words[0]):
        return None
    reached = {len(words[0])}
    for word in words[1:]:
        on = {at + n for at in reached for n in range(2, len(word) + 1) if label.startswith(word[:n], at)}
        done = {len(label)} & reached
        reached = on | done | (reached if word in LEGAL_SUFFIXES else set())
    return (DOMAIN, frozenset(["email_domain"])) if len(label) in reached else None


def supports_name(spelling: str, name: str) -> float:
    """How far a spelling speaks for a name; a longer one never does for a shorter name."""
    found = match_company(spelling, name)
    if found is None or ("truncation" in found[1] and len(company_words(spelling)) > len(company_words(name))):
        return 0.0
    return found[0]


def _match_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for mentions, candidates, truncated in batches:
        rows = [match_company(m, c, bool(t)) if m is not None and c is not None else None for m, c, t in zip(mentions, candidates, truncated, strict=True)]
        yield pd.DataFrame({"score": [r[0] if r else None for r in rows], "method": ["+".join(sorted(r[1])) if r else None for r in rows]})


def company_match(mention: Column | str, candidate: Column | str, truncated: Column | str) -> Column:
    """``score, method`` of a mention and a candidate."""
    return F.pandas_udf(_match_batches, "score double, method string")(mention, candidate, truncated)


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    """``ratio`` of two columns."""
    return F.pandas_udf(lambda x, y: x.combine(y, ratio), "double")(a, b)
