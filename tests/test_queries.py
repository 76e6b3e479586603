"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave import tables
from docweave.operators import graph, relate
from docweave.plans import registry, star

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert plain(found.select(*columns).collect()) == plain([row[names.index(c)] for c in columns] for row in result.fetchall())


def test_two_hop_starts_from_every_project(spark):
    facts = star.facts(spark, DATA).select("src", "dst").distinct().collect()
    steps = defaultdict(set)
    for src, dst in facts:
        if src != dst:
            steps[src].add(dst)
            steps[dst].add(src)
    want = {}
    for (start,) in star.entities(spark, DATA).filter("etype = 'project'").select("id").collect():
        want[start, start] = 0
        for hop, nodes in ((1, steps[start]), (2, {far for near in steps[start] for far in steps[near]})):
            for node in nodes:
                want.setdefault((start, node), hop)
    got = registry.queries()["two_hop"](spark, DATA).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.hop for r in got} == want
    assert len({r.start for r in got}) == 25


def test_title_groups_have_whole_titles(spark, tmp_path):
    titles = ["Monthly report, May", "Monthly report, June", "MONTHLY report - May", "", None, "Plan"]
    pages = [(n, "http://a", "<p>" if t is None else f"<title>{t}</title>") for n, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["page_title_groups"](spark, str(tmp_path)).collect()
    assert [(r.title, r.n_files) for r in got] == [("monthly report may", 2)]


def test_extracted_facts_come_from_every_template(spark):
    found = {r.rel for r in registry.queries()["extract_facts"](spark, DATA).select("rel").distinct().collect()}
    assert found == set("ISSUED_TO WORKS_FOR ATTENTION_OF HAS_DOCUMENT REFERENCES HAS_PROJECT LISTS_PRODUCT SENT RECEIVED FILED_UNDER DESCRIBES ADDRESSED_TO AUTHORED HOLDS ISSUED_BY PARTY_TO ATTENDED MENTIONS".split())


def test_title_groups_read_whole_turns(spark, duck, tmp_path):
    long = "word " * 400
    turns = [(1, 0, "user", long + "May"), (2, 0, "user", long + "June"), (3, 1, "user", long.upper() + "may"), (4, 2, "user", ""), (5, 3, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()["title_groups_min_files"](spark, str(tmp_path)).collect()
    assert sorted((r.title, r.n_files) for r in got) == [("user turn 0", 2), (long.strip() + " may", 2)]
    sql = "WITH conversations AS (SELECT * FROM '{}/conversations.parquet/*.parquet'), ".format(tmp_path) + registry.oracle_sql()["title_groups_min_files"].removeprefix("WITH ")
    assert plain((r.title, r.n_files) for r in got) == plain(duck.execute(sql).fetchall())


def test_gazetteer_keeps_equal_and_shorter_items(spark, tmp_path):
    spark.createDataFrame([(1, "see Acme Tool Works here"), (2, "Acme Tool")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "Acme Tool"), (2, "Acme Tool Works"), (3, "Acme Tool Works"), (4, "Works")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.queries()["gazetteer_mentions"](spark, str(tmp_path)).collect()
    assert sorted((r.file_id, r.entity_id) for r in got) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def alike(a, b):
    """200 times the longest common subsequence over both lengths."""
    best = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = best[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1])
    return 200 * best[len(a), len(b)] / (len(a) + len(b))


def test_ratios_of_words_by_hand(spark):
    rows = registry.queries()["lcs_ratio"](spark, DATA).collect()
    assert len(rows) > 500 and all(r.r == pytest.approx(alike(r.a, r.b)) for r in rows)


def test_similar_titles_of_all_pages(spark):
    rows = {r.title: (r.known, r.ratio) for r in registry.queries()["similar_titles"](spark, DATA).collect()}
    key = lambda title: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in title.lower()).split())
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    known = {k for r in pages if "<title>" in r.html and (k := key(r.html.split("<title>")[1].split("<")[0]))}
    asked = {k[: len(k) // 2] + k[len(k) // 2 + 1 :] for k in known} - {""}
    want = {}
    for a in asked:
        ratio, best = max((alike(a, k), k) for k in known)
        if ratio >= 90:
            want[a] = (best, ratio)
    assert {a: v[0] for a, v in rows.items()} == {a: v[0] for a, v in want.items()} and len(want) > 20


def test_paths_and_hops_of_repeated_facts(spark):
    facts = spark.createDataFrame([(f, a, "SENT", b) for f in (1, 2) for a, b in ((1, 2), (2, 3), (1, 4), (4, 3))], "file_id long, src long, rel string, dst long")
    assert [r.path for r in graph.shortest_paths(1, 3, facts).collect()] == [[1, 2, 3], [1, 4, 3]]
    start = spark.createDataFrame([(1,)], "start long")
    assert sorted((r.node, r.hop) for r in graph.within_hops(start, facts, 2).collect()) == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_relations_around_an_entity(spark, monkeypatch):
    facts, nodes = star.facts(spark, DATA), star.entities(spark, DATA)
    every = relate.derive(relate.relations(facts), nodes).collect()
    for few in (relate.FEW, 0):
        monkeypatch.setattr(relate, "FEW", few)
        for center in (11, 73):
            got = relate.around(facts, nodes, center).select("src", "dst", "rel", "weight", "derived").collect()
            assert plain(got) == plain((r.src, r.dst, r.rel, r.weight, r.derived) for r in every if center in (r.src, r.dst)) and len(got) > 10


def test_relations_among_few_and_many(spark, monkeypatch):
    edges = relate.relations(star.facts(spark, DATA))
    ids = edges.filter("src < 200").select(F.col("src").alias("id")).union(edges.filter("src < 200").select("dst")).distinct()
    few = graph.relations_among(ids, edges).collect()
    monkeypatch.setattr(graph, "FEW_NODES", 0)
    columns = ["src", "dst", "rel", "weight"]
    many = graph.relations_among(ids, edges).select(*columns).collect()
    assert few and plain(tuple(r[c] for c in columns) for r in few) == plain(many)


def test_relations_of_facts_in_given_partitions(spark):
    facts, nodes = star.facts(spark, DATA), star.entities(spark, DATA)
    stated = [(7, 31, "SENT", 42), (8, 31, "SENT", 42), (7, 5, "HAS_DOCUMENT", 42), (8, 5, "HAS_DOCUMENT", 42), (9, 42, "HAS_DOCUMENT", 42), (9, 64, "INVOLVED_IN", 5), (9, 64, "AUTHORED", 42)]
    facts = facts.union(spark.createDataFrame(stated, "file_id long, src long, rel string, dst long"))
    columns = ["src", "dst", "rel", "weight", "derived"]
    want = plain(relate.derive(relate.relations(facts), nodes).select(*columns).collect())
    found = relate.derive(relate.relations(facts, 7), nodes, facts, 7).select(*columns)
    assert plain(found.collect()) == want
    assert plain([(31, 5, "INVOLVED_IN", 1, 1), (64, 5, "INVOLVED_IN", 1, 0)]) == [r for r in want if r[2] == "'INVOLVED_IN'" and r[0] in ("31", "64") and r[1] == "5"]
    assert relate.relations(facts, 7).rdd.getNumPartitions() == relate.involved_in(facts, 7).rdd.getNumPartitions() == 7


def dealt(spark, name, monkeypatch, capsys):
    """A query's rows with many partitions, and how often its plan deals rows to as many."""
    monkeypatch.setattr(tables, "ROWS", 500)
    parts = star.parts(spark, DATA)
    assert parts > 25
    found = registry.queries()[name](spark, DATA)
    found.explain()
    return found, capsys.readouterr().out.count(f", {parts}), REPARTITION_BY_NUM")


def test_partitions_of_neighbours_follow_the_facts(spark, duck, monkeypatch, capsys):
    found, n = dealt(spark, "neighbours_ranked", monkeypatch, capsys)
    assert n >= 12 and found.rdd.getNumPartitions() == star.parts(spark, DATA)
    columns = "center, id, etype, weight, type_rank, place"
    want = duck.execute(f"SELECT {columns} FROM ({registry.oracle_sql()['neighbours_ranked']})").fetchall()
    assert plain(found.select(*columns.split(", ")).collect()) == plain(want)


def test_partitions_of_degrees_follow_the_facts(spark, duck, monkeypatch, capsys):
    found, n = dealt(spark, "degree_topk", monkeypatch, capsys)
    assert n >= 12
    assert plain(found.select("id", "etype", "name", "degree").collect()) == plain(duck.execute(registry.oracle_sql()["degree_topk"]).fetchall())


def test_degrees_in_given_partitions(spark):
    nodes = spark.createDataFrame([(n,) for n in range(1, 6)], "id long")
    edges = spark.createDataFrame([(1, 2, "SENT"), (1, 2, "RECEIVED"), (3, 3, "SENT"), (4, 1, "SENT")], "src long, dst long, rel string")
    found = graph.with_degree(nodes, edges, 9)
    assert sorted(map(tuple, found.select("id", "degree").collect())) == [(1, 3), (2, 2), (3, 1), (4, 1), (5, 0)]
    assert found.rdd.getNumPartitions() == 9


def test_partitions_of_a_search_follow_the_facts(spark, duck, monkeypatch, capsys):
    found, n = dealt(spark, "search_entities", monkeypatch, capsys)
    assert n >= 12
    assert plain(found.select("id", "etype", "name", "degree").collect()) == plain(duck.execute(registry.oracle_sql()["search_entities"]).fetchall())


def test_conditions_on_ids(spark):
    nodes = spark.createDataFrame([(n, "product" if n < 3 else "company", None, None, None) for n in range(1, 5)], "id long, etype string, name string, key string, attrs map<string,string>")
    edges = spark.createDataFrame([(1, 3, "SENT", 2, 0), (1, 3, "RECEIVED", 5, 0), (2, 4, "SENT", 1, 0), (3, 4, "SENT", 1, 0)], "src long, dst long, rel string, weight long, derived int")
    odd = F.col("id") % 2 == 1
    assert [(r.id, r.degree) for r in graph.search(nodes, edges, where=odd, parts=3).collect()] == [(3, 3), (1, 2)]
    found = graph.neighbours(edges, nodes, nodes.select(F.col("id").alias("center")), parts=3, where=F.col("center") == 3).orderBy("place").collect()
    assert [(r.center, r.id, r.weight, r.place) for r in found] == [(3, 4, 1, 1), (3, 1, 5, 2)]
