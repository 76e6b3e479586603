"""SimHash: fingerprints bit by bit, links between all pairs."""

import random

import pytest
import xxhash

from docweave.llm import simhash
from docweave.llm.work import Workspace

from .conftest import edge_rows, invented


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in hashes) > len(hashes))


def components(prints):
    """Of (doc_id, fingerprint) rows: doc_id, fingerprint, smallest doc_id that links reach."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return [(doc_id, p, least.get(find(p))) for doc_id, p in prints]


def test_fingerprints(monkeypatch):
    texts = [r[1] for r in edge_rows()] + ["a b c d", "A\x0bB", "x y z", " \x1f "]
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == [plain(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts if len(t or "") < 3000] == [plain(t) for t in texts if len(t or "") < 3000]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("bucket", [500, 20])
def test_links_are_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    if bucket == 20:
        monkeypatch.setattr("docweave.llm.work.BROADCAST_ROWS", 0)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains, dense clusters, pairs at distances of 1 to 6
        p = rng.choice(prints[:6] + prints[-20:])
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << bit
        prints.append(p)
    prints += [0, (1 << 64) - 1, 15, 31]
    got = simhash.close_links(spark.createDataFrame([(signed(p),) for p in set(prints)], "fingerprint long"), Workspace(spark, "s")).collect()
    root = {p: p for p in map(signed, prints)}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in got:
        root[find(r.a)] = find(r.b)
    want = {}
    for i, p, least in components(list(enumerate(prints))):
        want.setdefault(least, set()).add(signed(p))
    have = {}
    for p in root:
        have.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def documents():
    rng = random.Random(4)
    rows = []
    for g in range(40):
        words = invented(g, rng.randint(1, 300)).split()
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = invented(rng.randrange(10**6), 1)
    rng.shuffle(rows)
    return rows + [(None, rows[0][1]), (None, None), (900, ""), (901, " \n"), (902, None), (None, "no id here at all"), rows[1], rows[1]]


@pytest.mark.parametrize("broadcast", [True, False])
def test_find(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("docweave.llm.work.BROADCAST_ROWS", 0)
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, fingerprint string, bucket string, n string").repartition(3)
    got = simhash.find(docs, Workspace(spark, "s")).collect()
    want = components([(i, plain(t)) for i, t in rows])
    assert sorted(map(str, ((r[0], r[1] % (1 << 64), r[2]) for r in got))) == sorted(map(str, want))


def test_edges(spark, edge, none):
    got = simhash.find(edge, Workspace(spark, "s")).collect()
    want = components([(r[0], plain(r[1])) for r in edge_rows()])
    assert sorted(map(str, ((r[0], r[1] % (1 << 64), r[2]) for r in got))) == sorted(map(str, want))
    empty = simhash.find(none, Workspace(spark, "n"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
