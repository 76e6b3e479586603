"""Four files become a graph."""

import pytest
from pyspark.sql import functions as F

from docweave import build
from docweave.graph_api import Graph
from docweave.operators import companies, owner
from docweave.operators import files as ops
from docweave.tables import Tables, ranked, roots

from .test_templates import COLUMNS, INVOICE, JOB, MAIL, PATTERNS

FILES = [(JOB + "INV-4417_Brightwell Orchards.pdf", "pdf", INVOICE), (JOB + "INV-4417_v2.pdf", "pdf", INVOICE), ("Admin/Mail/re_schedule.eml", "eml", MAIL), ("Admin/Notes/random_note.txt", "text", "Nothing to see here.")]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    made = [(n, path, None, f"{n:064d}", kind, "ok", text) for n, (path, kind, text) in enumerate(FILES, 1)]
    files = ops.with_context(spark.createDataFrame(made, COLUMNS), PATTERNS)
    out = str(tmp_path_factory.mktemp("graph") / "g")
    return build.build_from_files(files, out, build.Options(job_id=r"JOB-\d{4}-\d{4}", owner="Farrow Handling Ltd"))


def test_entities(graph):
    rows = {(r.etype, r.name): r for r in graph.read("entities").collect()}
    assert sorted(n for e, n in rows if e == "company") == ["Brightwell Orchards", "Farrow Handling Ltd"]
    assert [n for e, n in rows if e == "project"] == ["Cold Store Extension"] and [n for e, n in rows if e == "product"] == ["Pallet Lift PL-240"]
    assert sum(n == "Oskar Lindqvist" for e, n in rows if e == "person") == 1
    invoice = rows["document", "INV-4417"].attrs
    assert invoice["versions"] == '["INV-4417_v2"]' and len(invoice["files"].split(",")) == 2 and invoice["doc_type"] == "invoice"
    assert rows["document", "QUO-3105"].attrs["missing"] == "1" and not [n for e, n in rows if n == "random_note"]
    assert rows["company", "Brightwell Orchards"].attrs == {"role": "customer", "domain": "brightwell.com"}


def test_mentions(graph):
    rows = graph.read("mentions").collect()
    acme = graph.read("entities").filter("name = 'Brightwell Orchards'").first().id
    assert {r.surface for r in rows if r.entity_id == acme} == {"Brightwell Orchards", "BRIGHTWELL Orch.", "brightwell.com"}
    assert {r.method for r in rows if r.etype == "project"} == {"job_id", "title+company", "unique_title"}
    assert {r.method for r in rows if r.surface == "brightwell.com"} == {"email_domain"} and {r.method for r in rows if r.surface == "gmail.com"} == {"generic_domain"}
    assert [r.method for r in rows if r.surface == "random_note"] == ["orphan"]


def test_relations(graph):
    names = {r.id: r.name for r in graph.read("entities").collect()}
    rows = {(names[r.src], r.rel, names[r.dst]): r for r in graph.read("relations").collect()}
    issued = rows["INV-4417", "ISSUED_TO", "Brightwell Orchards"]
    assert issued.weight == 2 and graph.read("relation_evidence").filter(F.col("relation_id") == issued.id).count() == 2
    involved = [r for k, r in rows.items() if k[1] == "INVOLVED_IN"]
    assert involved and all(r.derived == 1 for r in involved) and ("Brightwell Orchards", "PURCHASED_OR_QUOTED", "Pallet Lift PL-240") in rows
    assert graph.read("relation_evidence").filter(F.col("relation_id").isin([r.id for r in involved])).count() == 0


def test_companies(spark):
    known = ["Castlemead Logistics", "Blenheim Foods Group", "Redwood Timber & Joinery", "Falcon Aerospace Components", "Acme", "Castle Ltd", "---", "日本"]
    spelled = [("Castlemead Log.", 0), ("Blenhiem Foods", 1), ("Redwood Timber", 2), ("Falcon Aero Components", 3), ("Acme Robotics", 4), ("Castle Limited", 5), ("Red Wood Timber and Joinery", 2), ("castlemeadlogistics.com", 0), ("FAC", 3)]
    rows = [(n, n, "company", x, "folder", {}) for n, x in enumerate(known)]
    rows += [(100 + n, n, "company", x, "email_domain" if "." in x and " " not in x else "bill_to", {"domain": x} if x.endswith(".com") else {}) for n, (x, _) in enumerate(spelled)]
    mentions = spark.createDataFrame(rows, "id long, file_id long, etype string, surface string, role string, attrs map<string,string>")
    found, named = companies.companies(mentions, Tables(spark))
    of = {r.surface: r.company for r in found.collect()}
    name = {r.company: r.name for r in named.collect()}
    for x, at in spelled:
        assert name[of[x]] == (known[at] if at is not None else x), x
    assert len({of[k] for k in known}) == len(known)


def test_leading_words_and_adjudication(spark):
    rows = [(1, 1, "company", "Harbor Robotics Inc", "bill_to", None), (2, 1, "company", "Contact Harbor Robotics Inc", "free_text", None), (3, 2, "company", "Whitmorton", "bill_to", None), (4, 2, "company", "Whitmartan", "bill_to", None)]
    mentions = spark.createDataFrame(rows, "id long, file_id long, etype string, surface string, role string, attrs map<string,string>")
    of = {r.surface: r for r in companies.companies(mentions, Tables(spark))[0].collect()}
    assert of["Contact Harbor Robotics Inc"].company == of["Harbor Robotics Inc"].company and of["Contact Harbor Robotics Inc"].method.startswith("leading_word+")
    assert of["Whitmartan"].company != of["Whitmorton"].company
    agreed = {r.surface: r for r in companies.companies(mentions, Tables(spark), adjudicate=lambda pairs: pairs)[0].collect()}
    assert agreed["Whitmartan"].company == agreed["Whitmorton"].company and agreed["Whitmartan"].method.startswith("adjudicated:")


def test_owner(spark):
    rows = [(n, "pdf", "Meridian Packaging Systems Ltd\nINVOICE") for n in range(6)] + [(10 + n, "eml", f"From: a@meridian{'packaging' if n < 5 else 'x'}.com\nTo: b@gmail.com\n\nhi") for n in range(7)]
    files = spark.createDataFrame(rows, "id long, kind string, text string")
    assert owner.detect(files)[:2] == ("Meridian Packaging Systems Ltd", "meridianpackaging.com")
    assert owner.detect(files.filter("kind = 'eml'"))[:2] == ("meridianpackaging.com",) * 2 and owner.detect(files.limit(0))[0] is None


def test_ranks_and_roots(spark):
    rows = spark.createDataFrame([(i * 7 % 50, None if i == 3 else str(i)) for i in range(50)], "a long, b string").repartition(5)
    got = ranked(rows, Tables(spark), "r", F.col("a"))
    assert [(r.a, r.id) for r in got.orderBy("a").collect()] == [(i, i + 1) for i in range(50)]
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(101, 100)], "node long, parent long")
    assert {r.node: r.root for r in roots(chain, Tables(spark), "c").collect()} == {**dict.fromkeys(range(1, 40), 0), 101: 100}


def test_api(spark, graph):
    api = Graph(spark, graph.root)
    ids = {r.name: r.id for r in api.entities.collect()}
    acme, invoice = ids["Brightwell Orchards"], ids["INV-4417"]
    stats = {(r.part, r.kind): r.n for r in api.stats().collect()}
    assert stats["entities", "company"] == 2 and stats["files", "ok"] == 4 and stats["methods", "document:orphan"] == 1
    page = api.search(text="brightwell").collect()
    assert [r.name for r in page][:1] == ["Brightwell Orchards"] and page[0].subtitle == "customer" and page[0].total == len(page)
    card = api.entity(acme)
    assert {r.alias for r in card["aliases"].collect()} == {"Brightwell Orchards", "BRIGHTWELL Orch.", "brightwell.com"} and card["sources"].count() >= 3
    drawn = api.neighbourhood(acme, limit=3)
    assert drawn["nodes"].count() == 3 and drawn["hidden"].count() > 0 and api.neighbourhood()["nodes"].count() == 2
    issued = api.edges.filter((F.col("src") == invoice) & (F.col("rel") == "ISSUED_TO")).first().id
    assert api.explain_relation(issued)["files"].count() == 2
    bought = api.explain_relation(api.edges.filter("rel = 'PURCHASED_OR_QUOTED'").first().id)
    assert [r.key for r in bought["via"].collect()] == ["INV-4417"] and bought["relation"].first().rule
    assert api.connection(ids["Ida Moreno"], acme).first().hops >= 2 and api.connection(acme, acme).count() == 0
    assert {r.alias for r in api.spellings("brightwell orchards").collect()} >= {"BRIGHTWELL Orch."} and api.file(1)["mentions"].count() > 5
    assert api.related(acme, "issued_to").count() == 1
    assert [r.name for r in api.preset("customers").collect()] == ["Brightwell Orchards"] and api.preset("owner").first().reason == "given"
    assert {r.etype: r.n for r in api.preset("entities").collect()}["company"] == 2 and api.preset("people").count() >= 2
