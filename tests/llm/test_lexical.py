"""Lexical search: every score worked out plainly; WAND against all documents."""

import math
import random
import re

import numpy as np
import pytest

from docweave.llm import lexical
from docweave.llm.work import Workspace

from .conftest import edge_rows, invented

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, k=10):
    docs = [(i, t) for i, text in docs if (t := terms_of(text))]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    items = {}
    for item, text in queries:
        items.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in items.items():
        scored = []
        for doc_id, t in docs:
            m, score = 10 + 90 * len(t) * n_docs // n_terms, 0
            for term in terms & set(t):
                tf = t.count(term)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n=300):
    rng = random.Random(6)
    common, rare = invented(1, 12).split(), invented(2, 400).split()
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(1, 90))]
        rows.append((i, rng.choice([" ", ", ", "\n", "."]).join(words)))
    rows += [(n + k, rows[k][1]) for k in range(40)] + [(5, "Straße ÜBER-straße x1"), (5, None), (None, rows[3][1]), (None, None), (9000, ""), (9001, "...!")]
    queries = [(i, " ".join(rng.sample(rows, 1)[0][1].split()[:15] + rng.sample(rare, 6))) for i in range(25)]
    return rows, queries + [(100, None), (101, "nowherefound"), (102, "straße Über"), (3, "another row of item three"), (None, rows[7][1]), (103, common[0])]


@pytest.mark.parametrize("small", [False, True])
def test_search_is_all_documents(spark, monkeypatch, small):
    rows, queries = corpus()
    if small:  # many shards and windows, all terms indexed, many passes
        for name, value in (("SHARD_DOCS", 40), ("WINDOW", 7), ("SENT_TERMS", 0), ("PASS_TERMS", 90), ("PIECE", 16)):
            monkeypatch.setattr(lexical, name, value)
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, score string, item_id string").repartition(3)
    items = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, doc_id string").repartition(2)
    got = lexical.search(docs, items, Workspace(spark, "l")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, queries)))


def test_wand_is_a_full_scan():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (500, 3), (9000, 10), (9000, 2)):
        lists, every = [], np.zeros(n, "i8")
        for _ in range(rng.integers(1, 20)):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.05, 0.7]))
            gain = rng.integers(1, rng.choice([3, 50, 4000]), len(docs))
            lists.append((docs, gain))
            every[docs] += gain
        want = [d for d in np.lexsort((np.arange(n), -every))[:k] if every[d] > 0]
        docs, scores = lexical.best(lists, n, k)
        order = np.lexsort((docs, -scores))
        assert docs[order].tolist() == want and scores[order].tolist() == every[want].tolist()


def test_large_numbers_do_not_wrap():
    plain = lexical.impacts(np.array([3]), np.array([10**8]), 10**12, 10**15)
    assert plain[0] == 3 * 10**9 // (3000 + 8 * (10 + 90 * 10**8 * 10**12 // 10**15))


def test_edges(spark, edge, none):
    queries = spark.createDataFrame([(1, invented(1, 40)), (2, "four WORDS 日本語")], "item_id long, text string")
    got = lexical.search(edge, queries, Workspace(spark, "l"), k=3).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute([r[:2] for r in edge_rows()], [(1, invented(1, 40)), (2, "four WORDS 日本語")], 3)))
    for docs, items in ((none, queries), (edge, queries.limit(0)), (none, queries.limit(0))):
        empty = lexical.search(docs, items, Workspace(spark, "n"))
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
