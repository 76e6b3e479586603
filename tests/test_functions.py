import pytest
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import files, graph, relate


def values(spark, function, inputs):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(inputs)], "n int, x string")
    return [r.y for r in rows.select("n", function(F.col("x")).alias("y")).orderBy("n").collect()]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (t.lines, ["a\r\n\n  b \t\n", "", None], [["a", "b"], [], None]),
        (t.collapse_spaces, ["  a \n b ", None], ["a b", None]),
        (t.company_key, ["The Acme & Sons Ltd.", "Müller GmbH", "Ltd", "Bank of Élan plc"], ["acme sons", "mueller", "ltd", "bank elan"]),
        (t.has_legal_suffix, ["Acme Ltd.", "Acme", "Foo, Inc", "Harbor Robotics Ltd Group", "Ltdx", None], [True, False, True, True, False, False]),
        (t.person_key, ["José Müller", "O'Neil  Ann"], ["jose mueller", "o neil ann"]),
        (t.person_key_folded, ["José Müller"], ["jose muller"]),
        (t.person_initial_form, ["Thomas van Bianchi"], ["t bianchi"]),
        (t.clean_person, ["Dr. Ann Lee", "ann lee", "Ann", "Mr John Q. Public"], ["Ann Lee", None, None, "John Q. Public"]),
        (t.stem, ["a/b.c/INV-1_v2.pdf", "x.zip::in/y.txt", "plain"], ["INV-1_v2", "y", "plain"]),
        (t.base_stem, ["INV-1_v2", "note (3)", "plan final"], ["INV-1", "note", "plan"]),
        (t.extension, ["a/b.PDF", "a.b/c", ".git"], ["pdf", "", ""]),
        (lambda c: t.field(c, "Job"), ["x\nJob: Conveyor Upgrade \ny", "none"], ["Conveyor Upgrade", None]),
        (t.money, ["£3,344.00", "1.234,50 EUR", "7", "none", "1.234.567"], [3344.0, 1234.5, 7.0, None, 1234567.0]),
        (t.currency, ["£1", "2 EUR", "$3", "4"], ["GBP", "EUR", "USD", None]),
        (t.email_domains, ["a@B.com, c@d.co.uk"], [["b.com", "d.co.uk"]]),
        (t.title_key, ["RE: Shrink-Wrap"], ["re shrink wrap"]),
    ],
)
def test_text(spark, function, given, wanted):
    assert values(spark, function, given) == wanted


@pytest.mark.parametrize(
    "pattern, path, below",
    [
        ("node_modules", "a/node_modules/x", True), ("node_modules", "a/my_node_modules/x", False), ("/build", "a/build/x", False), ("/build", "build/x", True),
        ("tmp*", "a/tmp1/x", True), ("a/**/z", "a/b/c/z/x", True), ("a/?", "a/b/x", True), ("a/?", "a/bb/x", False),
    ],
)
def test_directories(spark, pattern, path, below):
    assert spark.range(1).select(files.in_directories(F.lit(path), [pattern])).first()[0] is below


def test_folder_context(spark):
    patterns = [r"Customers/{company}/{job_id:JOB-\d{4}-\d{4}} {title}/{category}"]
    rows = [("Customers/Acme Corp/JOB-2023-0003 Shrink Wrap/Invoices/a.pdf",), ("Admin/Mail/x.eml",)]
    got = files.with_context(spark.createDataFrame(rows, "path string"), patterns).orderBy(F.desc("path")).first()
    assert (got.area, got.folder_company, got.folder_job, got.folder_job_id, got.folder_job_title, got.folder_category) == (
        "Customers", "Acme Corp", "JOB-2023-0003 Shrink Wrap", "JOB-2023-0003", "Shrink Wrap", "Invoices",
    )


def test_relations(spark):
    facts = spark.createDataFrame([(1, 10, "ISSUED_TO", 20), (1, 10, "ISSUED_TO", 20), (2, 10, "ISSUED_TO", 20), (2, 10, "REFERENCES", 10)], "file_id long, src long, rel string, dst long")
    assert [(r.src, r.dst, r.weight) for r in relate.relations(facts).collect()] == [(10, 20, 2)]


def test_gazetteer(spark):
    texts = spark.createDataFrame([(1, "Acme Corporation met Acme. Acmes did not."), (2, "acme")], "file_id long, text string")
    names = spark.createDataFrame([("Acme", 1), ("Acme Corporation", 2), ("met Acme.", 3)], "alias string, entity_id long")
    assert {(r.file_id, r.entity_id) for r in relate.gazetteer_mentions(texts, names).collect()} >= {(1, 2), (1, 3)}
    assert all(r.file_id == 1 for r in relate.gazetteer_mentions(texts, names).collect())


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, "A", 1, 0), (2, 3, "B", 1, 0), (1, 4, "A", 1, 0), (4, 3, "B", 1, 0), (5, 6, "A", 1, 0)], "src long, dst long, rel string, weight long, derived int")
    assert [r.path for r in graph.shortest_paths(1, 3, edges).collect()] == [[1, 2, 3], [1, 4, 3]]
    assert [r.path for r in graph.shortest_paths(1, 3, edges, avoid=[2]).collect()] == [[1, 4, 3]]
    assert graph.shortest_paths(1, 6, edges).count() == 0 and graph.shortest_paths(1, 1, edges).count() == 0
