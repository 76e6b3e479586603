"""Company names: the index against all pairs, decisions in waves against one after another, merging against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import names
from docweave.operators import companies, name_index
from docweave.tables import Tables

SYLLABLES = ["bar", "lin", "ton", "mor", "ves", "hal", "dun", "cor", "ster", "wick", "an", "o"]
SUFFIXES = ["Ltd", "Inc", "GmbH", "", "", "Co"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))


def variant(name, rng):
    """A name with a typo, a cut, an abbreviation, words joined or split, a word more or less."""
    parts = name.split()
    how, at = rng.randrange(8), rng.randrange(len(parts))
    w = parts[at]
    if how == 0 and len(w) > 4:
        k = rng.randrange(1, len(w) - 1)
        parts[at] = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
    elif how == 1 and len(w) > 5:
        parts[at] = w[: rng.randint(3, len(w) - 1)] + "."
    elif how == 2 and len(parts) > 1:
        parts[:2] = ["".join(parts[:2])]
    elif how == 3 and len(w) > 6:
        parts[at : at + 1] = [w[:3], w[3:]]
    elif how == 4:
        parts.append(word(rng).title())
    elif how == 5 and len(parts) > 2:
        parts.pop(at)
    elif how == 6:
        return "".join(p[0] for p in parts).upper() if len(parts) > 1 else name
    else:
        k = rng.randrange(len(w))
        parts[at] = w[:k] + rng.choice("aeiou") + w[k + 1 :]
    return " ".join(parts)


def invented_names(n, seed, vocabulary=60):
    rng = random.Random(seed)
    words = [word(rng).title() for _ in range(vocabulary)]
    out = []
    while len(out) < n:
        if out and rng.random() < 0.55:
            out.append(variant(rng.choice(out), rng))
        else:
            out.append(" ".join(rng.sample(words, rng.randint(1, 3)) + ([s] if (s := rng.choice(SUFFIXES)) else [])))
    return [x for x in out if names.company_words(x)]


def norm(name):
    return " ".join(names.company_words(name))


@pytest.mark.parametrize("few", [20, 0])
def test_no_match_is_lost(spark, monkeypatch, few):
    monkeypatch.setattr(name_index, "FEW", few)
    asked = sorted({(norm(x), cut) for k, x in enumerate(invented_names(260, 1, 30)) for cut in ({False, k % 4 == 0})} | {("h", True), ("ba", True), ("barl", True), ("lin t", True), ("", False), ("日", False)})
    known = sorted({norm(x) for x in invented_names(200, 1, 30)} | {norm(x) for x in invented_names(60, 2, 30)} | {"bar lin", "barlin", "ltd", ""})
    tables = Tables(spark)
    got = name_index.company_scores(spark.createDataFrame(asked, "name string, cut boolean"), spark.createDataFrame([(k,) for k in known], "known string"), tables, "n")
    want = {(a, cut, b): found for a, cut in asked for b in known if (found := names.match_company(a, b, cut)) is not None}
    assert {(r.name, r.cut, r.known): (r.score, r.method) for r in got.collect()} == {k: (v[0], "+".join(sorted(v[1]))) for k, v in want.items()} and len(want) > 1000


def test_scored_pairs_follow_the_names(spark):
    """Random names of a small vocabulary: pairs that are scored grow with the names and are few more than those that match."""
    rng = random.Random(5)
    first, second = [word(rng) for _ in range(40)], ["".join(rng.choice("bcdfghlmnprstv") + rng.choice("aeiou") for _ in range(5)) for _ in range(4000)]
    counts = []
    for n in (1000, 4000):
        rows = sorted({f"{rng.choice(first)} {x} {rng.choice(second)}" for x in second[:n]})
        mentions = spark.createDataFrame([(r, False) for r in rows], "name string, cut boolean")
        counts.append(name_index.candidates(mentions, spark.createDataFrame([(r,) for r in rows], "known string"), Tables(spark), "n").count())
    assert counts[0] < 4 * 1000 and counts[1] < 6 * counts[0]


def test_domains(spark):
    rng = random.Random(6)
    known = sorted({" ".join(names.company_words(x, True)) for x in invented_names(200, 3, 25)} | {"acme com", "acme", "a ltd holding", "acme co ltd works"})
    domains = {"acme.de", "a-cme.com", "acmeworks.com", "acmelt.com", "é.com", "x"} | {"".join(w[: rng.randint(2, len(w))] if k else w for k, w in enumerate(x.split())) + ".com" for x in known}
    got = name_index.domain_scores(spark.createDataFrame([(d,) for d in domains], "domain string"), spark.createDataFrame([(k,) for k in known], "full string"))
    want = {(d, k) for d in domains for k in known if names.match_domain(d, k)}
    assert {(r.domain, r.full) for r in got.collect()} == want and len(want) > 150


MENTIONS = "id long, file_id long, etype string, surface string, role string, attrs map<string,string>"


def mention_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for k, name in enumerate(invented_names(n, seed, 25)):
        role = rng.choice(["bill_to", "line", "free_text", "filename", "bill_to"]) if k % 20 else "folder"
        attrs = {"truncated": "1"} if role == "filename" and rng.random() < 0.6 else {}
        if role == "bill_to" and rng.random() < 0.15:
            parts = [w.lower() for w in names.company_words(name)]
            name, role = "".join(parts[:2]) + rng.choice([".com", ".de"]), "email_domain"
            attrs = {"domain": name}
        if role == "free_text" and rng.random() < 0.4:
            name = "Contact " + name
        rows += [(len(rows) + j, k, "company", name, role, attrs) for j in range(rng.randint(1, 3))]
    return rows


def one_after_another(spelled, adjudicate=False):
    """place -> (place of its company, score, method) by a loop over the spellings in their order."""
    known, out = [], {}
    for r in sorted(spelled, key=lambda r: r.place):
        def tried(surface, cut):
            found = []
            for head in known:
                m = names.match_domain(surface.lower(), head.surface.lower() if head.domain else head.surface) if r.domain else names.match_company(surface, head.surface, cut)
                if m and (not r.anchor or m[0] == 1.0):
                    found.append((m[0], -head.place, "+".join(sorted(m[1]))))
            return max(found, default=None, key=lambda x: x[:2])
        best = tried(r.surface, r.truncated) if names.company_words(r.surface) else None
        if best and best[0] >= names.ACCEPT:
            out[r.place] = (-best[1], best[0], best[2])
        elif best and best[0] >= names.UNSURE and adjudicate:
            out[r.place] = (-best[1], best[0], "adjudicated:" + best[2])
        else:
            rest = r.surface.split(None, 1)[1:] if r.plain and not (best and best[0] >= names.UNSURE) else []
            shorter = tried(rest[0], False) if rest else None
            if shorter and shorter[0] >= names.ACCEPT:
                out[r.place] = (-shorter[1], shorter[0] * 0.9, "leading_word+" + shorter[2])
            else:
                out[r.place] = (r.place, 1.0, "exact" if r.anchor else "new")
                known.append(r)
    return out


@pytest.mark.parametrize("adjudicate", [None, lambda pairs: pairs])
def test_waves_are_one_after_another(spark, monkeypatch, adjudicate):
    monkeypatch.setattr(companies, "merge_to_fixpoint", lambda rows, *_: rows)
    mentions = spark.createDataFrame(mention_rows(250, 11), MENTIONS)
    tables = Tables(spark)
    companies.companies(mentions, tables, adjudicate=adjudicate)
    got = {r.place: (r.company, round(r.score, 6), r.method) for r in tables.read("company-rows").collect()}
    want = one_after_another(companies.spellings(mentions, Tables(spark)).collect(), adjudicate is not None)
    assert got == {k: (c, round(s, 6), m) for k, (c, s, m) in want.items()}
    assert {m.split("+")[0].split(":")[0] for _, _, m in got.values()} >= {"new", "leading_word", "email_domain", "exact"}


def merged_plainly(rows):
    """Groups of places after merging companies with matching names, naming them anew, and again."""
    company = {r.place: r.company for r in rows}

    def named():
        groups = {}
        for r in rows:
            groups.setdefault(company[r.place], []).append(r)
        out = {}
        for c, own in groups.items():
            keyed = {}
            for r in own:
                if not r.domain and r.role != "filename" and r.name:
                    keyed.setdefault(r.name, []).append(r)
            votes = {k: (sum(r.n for r in v), max(v, key=lambda r: (r.n, -r.place)).surface) for k, v in keyed.items()}
            support = lambda k: round(sum(n * names.supports_name(o, k) for o, (n, _) in votes.items()), 9)  # noqa: E731, B023
            voted = max(((support(k), n, s) for k, (n, s) in votes.items()), default=None)
            anchors = [r for r in own if r.anchor]
            first = min(own, key=lambda r: r.place)
            name = min(anchors, key=lambda r: r.place).surface if anchors else voted[2] if voted else first.surface
            out[c] = (name, bool(anchors), all(r.domain for r in own), sum(r.n for r in own))
        return out

    while True:
        known = named()
        score = {}
        for a, (x, anchor_a, domain_a, _) in known.items():
            for b, (y, anchor_b, domain_b, _) in known.items():
                if a == b or (anchor_a and anchor_b) or domain_b:
                    continue
                m = names.match_domain(x.lower(), y) if domain_a else names.match_company(x, y)
                if m and m[0] >= names.ACCEPT:
                    score[a, b] = score[b, a] = max(m[0], score.get((a, b), 0))
        if not score:
            return company
        group = {c: c for c in known}
        while True:
            low = {c: min([group[c], *(group[b] for a, b in score if a == c and not known[a][1] and not known[b][1])]) for c in known}
            if low == group:
                break
            group = low
        target = {}
        for g in set(group.values()):
            own = [c for c in known if group[c] == g]
            anchors = [(s, -b) for (a, b), s in score.items() if a in own and known[b][1] and not known[a][1]]
            largest = max(own, key=lambda c: (not known[c][2], known[c][3], -c))
            for c in own:
                target[c] = c if known[c][1] else -max(anchors)[1] if anchors else largest
        company = {p: target[c] for p, c in company.items()}


def test_merging_is_a_plain_loop(spark):
    mentions = spark.createDataFrame(mention_rows(250, 12), MENTIONS)
    tables = Tables(spark)
    found, named = companies.companies(mentions, tables)
    rows = tables.read("company-rows").collect()
    want = merged_plainly(rows)
    got = {(r.surface, r.domain, r.truncated): r.company for r in found.collect()}
    assert got == {(r.surface, r.domain, r.truncated): want[r.place] for r in rows}
    assert len(set(want.values())) < len({r.company for r in rows}) and tables.read("merge-pairs1") is not None
    assert sorted(r.company for r in named.collect()) == sorted(set(want.values()))


def test_a_new_name_opens_a_merge(spark):
    # "Kestral Foods" comes first and names the company; only its right name, which wins by votes, matches the domain.
    spelled = [("Kestral Foods", "bill_to", 1), ("Kestrel Foods", "line", 6), ("kestrelfoods.com", "email_domain", 1)]
    rows = []
    for surface, role, n in spelled:
        rows += [(len(rows) + k, 1, "company", surface, role, {"domain": surface} if "." in surface else {}) for k in range(n)]
    found, named = companies.companies(spark.createDataFrame(rows, MENTIONS), Tables(spark))
    assert len({r.company for r in found.collect()}) == 1 and [r.name for r in named.collect()] == ["Kestrel Foods"]
    assert named.first().domain == "kestrelfoods.com"


def test_empty_and_nameless(spark):
    found, named = companies.companies(spark.createDataFrame([], MENTIONS), Tables(spark))
    assert found.count() == 0 and named.count() == 0
    rows = [(1, 1, "company", "---", "bill_to", {}), (2, 1, "company", "日本", "bill_to", {}), (3, 1, "company", "---", "line", {})]
    found, _ = companies.companies(spark.createDataFrame(rows, MENTIONS), Tables(spark))
    assert {r.surface: r.method for r in found.collect()} == {"---": "new", "日本": "new"} and found.select("company").distinct().count() == 2


def test_connected(spark):
    rng = random.Random(4)
    links = [(i + 1, i) for i in range(60)] + [(max(p), min(p)) for p in ((rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)) if p[0] != p[1]]
    got = {r.node: r.group for r in companies.connected(spark.createDataFrame(links, "node long, parent long"), Tables(spark), "c").collect()}
    want = {x: x for e in links for x in e}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
