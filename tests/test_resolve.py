import random

import pytest
from pyspark.sql import functions as F

from docweave import build
from docweave.functions import names
from docweave.operators import extract, resolve
from docweave.tables import Tables

MENTIONS = "id long, file_id long, etype string, surface string, role string, attrs map<string,string>, entity_id long"


def mentions(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], MENTIONS)


def test_numbers(spark):
    text = "INVOICE\nInvoice No: INV-8034\nQuote Ref QUO-9999, see PO-123456 and ISO-9001, CS-110 twice CS-110, JOB-2023, X-1"
    row = spark.range(1).select(extract.references(F.lit(text)).alias("r"), extract.product_codes(F.lit(text)).alias("p"), extract.own_number(F.lit(text), "Invoice").alias("n")).first()
    assert row.r == ["INV-8034", "QUO-9999", "PO-123456"] and row.p == ["CS-110"] and row.n == "INV-8034"


def test_documents(spark):
    texts = ["Invoice No: INV-1234\nQuote QUO-777", "Drawing No: DWG-22\nDrawn by: Ann Lee", "Attendees: Ann Lee, Bob Ray; x", "hello", None]
    files = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = extract.documents(files).orderBy("file_id").collect()
    assert [(r.doc_type, r.number) for r in got] == [("invoice", "INV-1234"), ("drawing", "DWG-22"), ("meeting_notes", None), ("other", None), ("other", None)]
    assert [(p.rel, p.name) for p in got[2].people] == [("ATTENDED", "Ann Lee"), ("ATTENDED", "Bob Ray")]
    assert [(r.file_id, r.number) for r in extract.document_references(files).collect()] == [(0, "QUO-777")]


def test_products_and_projects(spark):
    rows = mentions(
        spark,
        (1, "product", "CS-110", "line", {"code": "CS-110", "description": "Case Sealer"}, None),
        (1, "product", "CS-110", "line", {"code": "CS-110", "description": "Sealer"}, None),
        (2, "product", "CS-110", "line", {"code": "CS-110", "description": "Sealer"}, None),
        (2, "project", "x", "line", {"job_id": "J1", "title": "Other"}, None),
        (3, "project", "x", "folder", {"job_id": "J1", "title": "Wrap"}, None),
    )
    assert [(r.key, r.name, r.n) for r in resolve.products(rows).collect()] == [("CS-110", "Sealer CS-110", 3)]
    assert [(r.key, r.title, r.n_files) for r in resolve.projects(rows).collect()] == [("J1", "Wrap", 2)]


def test_reused_numbers(spark):
    rows = mentions(spark, *[(n, "document", s, "self", None, None) for n, s in enumerate(["A-1", "A-1", "A-1", "B-1"])])
    parties = spark.createDataFrame([(1, 10), (2, 20)], "document long, company long")
    got = {r.id: (r.key, r.method) for r in resolve.documents(rows, parties).collect()}
    assert got == {1: ("A-1@10", "doc_number+counterparty"), 2: ("A-1@20", "doc_number+counterparty"), 3: (None, "ambiguous_number"), 4: ("B-1", "doc_number")}


def test_people(spark):
    rows = mentions(
        spark,
        (1, "person", "José Müller", "a", {"email": "J@x.com", "organisation": "X Ltd"}, None),
        (2, "person", "Jose Mueller", "a", {"organisation": "X"}, None),
        (3, "person", "J. Müller", "a", None, None),
        (4, "person", "Ann Lee", "a", None, None),
    )
    got = {r.id: (r.key, r.method) for r in resolve.people(rows).collect()}
    assert got[1] == ("j@x.com", "email") and got[2] == ("j@x.com", "name+organisation") and got[3] == ("j@x.com", "unique_name") and got[4] == ("ann lee|?", "new_unattributed")


def test_merged_attributes(spark):
    rows = mentions(spark, (1, "document", "a", "self", {"total": "5", "date": "x"}, 7), (2, "document", "a", "self", {"total": "6", "date": "x"}, 7))
    row = resolve.merged_attributes(rows, ["total", "date"]).first()
    assert (row.total, row.date, row.conflicts) == ("5", "x", {"total": ["5", "6"]})


def test_another_type_replaces_other(spark):
    rows = mentions(spark, (1, "document", "a", "self", {"doc_type": "other"}, 7), (2, "document", "a", "self", {"doc_type": "quote"}, 7), (3, "document", "a", "self", {"doc_type": "invoice"}, 7), (4, "document", "b", "self", {"doc_type": "other"}, 8))
    assert {r.entity_id: r.doc_type for r in resolve.merged_attributes(rows, ["doc_type"]).collect()} == {7: "quote", 8: "other"}


def test_people_in_context(spark):
    rows = mentions(
        spark,
        (1, "person", "Rachel Bianchi", "a", {"organisation": "X"}, None),
        (2, "person", "Rachel Bianchi", "a", {"organisation": "Y"}, None),
        (3, "person", "Rachel Bianchi", "a", {"organisation": "Own"}, None),
        (4, "person", "Rachel Bianchi", "a", None, None),  # in a folder of Y
        (5, "person", "R. Bianchi", "a", None, None),  # in no folder: the owner's
        (6, "person", "Robert Bianchi", "a", None, None),  # a full name is no initial
        (7, "person", "Ann Lee", "a", {"organisation": "X"}, None),
        (8, "person", "A. Lee", "a", None, None),
        (4, "person", None, "a", None, None),
    )
    folders = spark.createDataFrame([(4, "Y Ltd"), (8, "Y Ltd")], "file_id long, organisation string")
    got = {r.id: (r.key, r.method) for r in resolve.people(rows, folders, "Own").collect()}
    assert got[4] == ("rachel bianchi|y", "name+context") and got[5] == ("rachel bianchi|own", "name+context")
    assert got[6] == ("robert bianchi|?", "new_unattributed") and got[8] == ("ann lee|x", "unique_name") and got[9][1] == "new_unattributed"
    assert len(got) == 9
    alone = {r.id: r.method for r in resolve.people(rows).collect()}
    assert alone[4] == alone[5] == "new_unattributed"


def test_similar_titles(spark):
    draw = random.Random(3)
    known = ["".join(draw.choice("abc ") for _ in range(draw.randint(1, 40))).strip() or "a" for _ in range(60)] + ["shrink wrap retrofit", "shrink wrap retrofits"]
    titles = ["a", "ab", "shrnk wrap retrofit", "shrink wrap retrofitt", "nothing like it", ""]
    for k in known:
        letters = list(k)
        for _ in range(draw.randint(0, 1 + len(k) // 8)):
            at = draw.randrange(len(letters) + 1)
            letters[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "a"])
        titles.append("".join(letters))
    want = {}
    for x in filter(None, titles):
        best = max(((names.ratio(x, k), k) for k in known), default=(0, ""))
        if best[0] >= 90:
            want[x] = (best[1], best[0])
    of = lambda values: spark.createDataFrame([(v,) for v in values], "title string")
    assert {r.title: (r.known, r.ratio) for r in resolve.similar_titles(of([*titles, None]), of([*known, None, ""])).collect()} == want and len(want) > 30
    assert resolve.similar_titles(of(titles), of([])).isEmpty()


def test_few_titles_are_scored(spark):
    """Titles of a small vocabulary: few pairs more than those that are similar."""
    draw = random.Random(8)
    words = ["wrap", "line", "cell", "room", "press", "frame", "guard", "drive", "clean", "upper", "north", "belt"]
    made = lambda n: sorted({" ".join(draw.choice(words) for _ in range(draw.randint(2, 7))) for _ in range(n)})
    titles, known = made(300), made(300)
    of = lambda values: spark.createDataFrame([(v,) for v in values], "title string")
    pairs = {(r.title, r.known) for r in resolve.title_pairs(of(titles), of(known)).collect()}
    assert {(a, b) for a in titles for b in known if names.ratio(a, b) >= 90} <= pairs and len(pairs) < 0.005 * len(titles) * len(known)


def _plain_best(titles, known):
    """Each title's most similar known one, worked out pair by pair."""
    best = {x: max((names.ratio(x, k), k) for k in known) for x in titles}
    return {x: (k, r) for x, (r, k) in best.items() if r >= 90}


def test_one_letter_apart_is_found_without_pairs(spark, monkeypatch):
    """Hundreds of titles made of few syllables and without a letter each: no title has to be held against the others."""
    draw = random.Random(5)
    made = lambda: " ".join("".join(draw.choice(["th", "er", "tion", "an", "ou"]) for _ in range(draw.randint(1, 4))) for _ in range(7))[:60].strip()
    known = sorted({made() for _ in range(400)} | {"abcde", "abcdef", "abcdeg", "line 12", "line 123", "line 124", "line 1"})
    titles = sorted({k[: len(k) // 2] + k[len(k) // 2 + 1 :] for k in known if len(k) > 9} | {"abcde", "abcdex", "line 12", "line 1234", "line", "line 12x"})

    def never(*_, **__):
        raise AssertionError("titles are compared pair by pair")

    monkeypatch.setattr(resolve, "title_pairs", never)
    of = lambda values: spark.createDataFrame([(v,) for v in values], "title string")
    rows = {r.title: (r.known, r.ratio) for r in resolve.similar_titles(of(titles), of(known)).collect()}
    # Longer before shorter, the greatest of several alike; "abcdex" is ten elevenths of "abcde", "line" too short for any.
    assert rows["line 1234"] == ("line 124", names.ratio("line 1234", "line 124")) and rows["abcde"] == ("abcde", 100.0) and rows["abcdex"][0] == "abcde" and "line" not in rows
    assert len(rows) > 390 and all(ratio == names.ratio(title, k) >= 90 for title, (k, ratio) in rows.items())
    some = draw.sample(sorted(rows), 25)
    assert {x: rows[x] for x in some} == _plain_best(some, known)


@pytest.mark.parametrize("letters", [resolve.LETTERS, 300])
def test_titles_several_letters_apart(spark, monkeypatch, letters):
    """In one block for all lengths that are close, and in many; also titles of more letters than a machine word has bits."""
    monkeypatch.setattr(resolve, "LETTERS", letters)
    draw = random.Random(9)
    known = ["".join(draw.choice("abcdeé漢 ") for _ in range(draw.choice([9, 10, 20, 63, 64, 65, 130]))) for _ in range(50)]
    titles = []
    for k in known:
        kept, gone = list(k), draw.randint(0, len(k) // 5)
        for _ in range(gone):
            at = draw.randrange(len(kept))
            kept[at : at + 1] = draw.choice(["", "x"])
        titles.append("".join(kept))
    of = lambda values: spark.createDataFrame([(v,) for v in values], "title string")
    want = _plain_best(set(titles), known)
    assert {r.title: (r.known, r.ratio) for r in resolve.similar_titles(of(titles), of(known)).collect()} == want and len(want) > 25
    pairs = {(r.title, r.known): r.ratio for r in resolve.title_pairs(of(titles), of(known)).collect()}
    assert pairs == {(a, b): names.ratio(a, b) for a in titles for b in known if names.ratio(a, b) >= 90}
    best = {(r.title, r.known): r.ratio for r in resolve.title_pairs(of(titles), of(known), best=True).collect()}
    assert best.items() <= pairs.items() and {(a, k) for a, (k, _) in want.items()} <= best.keys()


def test_projects_by_title_and_folder(spark):
    project = lambda file, title, role, **attrs: (file, "project", title, role, {"title": title} | attrs)
    rows = [
        *[(n, "company", f"{c} Robotics Ltd", "folder", {}) for n, c in ((1, "Acme"), (2, "Borel"), (3, "Acme"), (4, "Acme"))],
        project(1, "Clean Room Cell", "folder", job_id="J1", customer="Acme Robotics Ltd"),
        project(2, "Clean Room Cell", "folder", job_id="J2", customer="Borel Robotics Ltd"),
        project(3, "Clean Room Cell", "folder", job_id="J3", customer="Acme Robotics Ltd"),
        project(4, "Conveyor Upgrade", "folder", job_id="J4", customer="Acme Robotics Ltd"),
        project(2, "Clean Room Cel", "field", customer="Borel Robotics Ltd"),
        project(3, "Clean Room Cell", "field", customer="Acme Robotics Ltd"),
        project(3, "Clean Room Cell", "field"),
        project(9, "Conveyer Upgrade", "field"),
        project(9, "Clean Room Cell", "field"),
    ]
    made = spark.createDataFrame([(n, *r[:4], r[4], 1.0) for n, r in enumerate(rows, 1)], "id long, file_id long, etype string, surface string, role string, attrs map<string,string>, confidence double")
    facts = spark.createDataFrame([], "id long, file_id long, src long, rel string, dst long")
    resolved, _ = build.resolve_stage(made, facts, Tables(spark))
    got = {r.id: (r.method, r.confidence) for r in resolved.collect() if r.etype == "project" and r.role == "field"}
    assert got == {9: ("title+company", 0.9), 10: ("title+company+folder", 0.9), 11: ("title+folder", 0.75), 12: ("unique_title", 0.75), 13: ("unresolved", 0.0)}
