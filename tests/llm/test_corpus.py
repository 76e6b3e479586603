"""Operators over the whole corpus: 1, 2, 3, 7 and the pipeline."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import graphs, mixing, near_dedup, toxicity, warc
from docweave.llm.work import Workspace

from .conftest import SCHEMA, edge_rows, invented


def pages(spark):
    big, other = "<p>" + invented(5, 400), "<p>é" + invented(6, 400)
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (3, "http://ä/ü?q=1", other), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small")]
    rows += [(200 + k, "u", "small") for k in range(30)] + [(None, "u", big), (None, "n", "n" * 1200), (9, "again", big)] + [(100 + k, "u", invented(k, 300)) for k in range(40)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3)


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc(spark, ws, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("docweave.llm.work.BROADCAST_ROWS", 0)
    table = pages(spark)
    read = warc.read_archives(warc.write_archives(table, ws))
    assert read.count() == table.count() and read.filter("error is not null").count() == 0
    got = {(r.record_id, r.record_type, r.refers_to_id, r.payload_bytes, r.payload_digest) for r in read.collect()}
    want = set()
    for r in table.select("page_id", F.coalesce("html", F.lit("")).alias("h")).withColumns({"d": F.sha1("h"), "n": F.octet_length("h")}).collect():
        refers = "urn:x-page:9" if r.h.startswith("<p>") and r.h == "<p>" + invented(5, 400) and r.page_id != 9 else None
        want.add((f"urn:x-page:{'none' if r.page_id is None else r.page_id}", "revisit" if refers else "response", refers, r.n, r.d))
    assert got == want
    payloads = {bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()}
    assert payloads == {r.html or "" for r in table.select("html").collect()}
    empty = warc.write_archives(table.limit(0), Workspace(spark, "e"))
    assert warc.read_archives(empty).count() == 0


def test_warc_rejects_what_is_broken(spark):
    writer = warc.ArchiveWriter()
    records = [warc.page_record(i, "u", invented(i, 300).encode(), "2020-01-01T00:00:00Z") for i in range(40)]
    for record in records:
        writer.add(record)
    data = writer.close()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    found = list(warc.frames(memoryview(data)))
    assert [c for _, c in found] == records
    plain = zstandard.ZstdCompressor().compress
    bad = [
        records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[0][:-1], records[0].replace(b"WARC-Date", b"WARC-Dat3"),
        records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"<", b"!", 1)[:-20] + records[0][-19:],
    ]
    archives = [("bad", b"".join(map(plain, [*bad, records[1]]))), ("cut", data[:-3]), ("none", b"hello"), ("null", None), ("empty", b"")]
    rows = warc.read_archives(spark.createDataFrame(archives, "archive string, content binary")).collect()
    assert [r.error is None for r in rows if r.archive == "bad"] == [False] * len(bad) + [True]
    few = warc.read_archives(spark.createDataFrame([("long", b"".join(map(plain, records[:3])))], "archive string, content binary"), max_bytes=len(records[1]) - 1).collect()
    assert [r.error is None for r in few] == [len(r) < len(records[1]) for r in records[:3]]
    assert [r.error is None for r in rows if r.archive == "cut"] == [True] * 39 + [False]
    assert [r.error is None for r in rows if r.archive == "none"] == [False] and not [r for r in rows if r.archive in ("null", "empty")]


def test_warc_survives_broken_archives(spark):
    writer = warc.ArchiveWriter()
    for i in range(40):
        writer.add(warc.page_record(i, "u", invented(i, 300).encode(), "2020-01-01T00:00:00Z"))
    data = writer.close()
    size = int.from_bytes(data[4:8], "little")
    frame = lambda raw: data[:4] + len(raw).to_bytes(4, "little") + raw
    plain = zstandard.ZstdCompressor().compress
    page = warc.page_record(1, "u", b"x" * 1200, "2020-01-01T00:00:00Z")
    revisit = warc.page_record(2, "u", b"x" * 1200, "2020-01-01T00:00:00Z", 1)
    digest = revisit[revisit.index(b"sha1:") + 5 :][:32]
    length = b"Content-Length: %d" % len(page[page.index(b"\r\n\r\n") + 4 : -4])
    assert length in page
    alone = {
        "damaged dictionary": frame(data[8:40] + bytes(b ^ 255 for b in data[40:60]) + data[60 : 8 + size]) + data[8 + size :],
        "cut dictionary": frame(data[8 : 8 + size // 2]) + data[8 + size :],
        "garbage dictionary": frame((0xEC30A437).to_bytes(4, "little") + b"garbage" * 50) + data[8 + size :],
        "no dictionary": frame(b"hello there") + data[8 + size :],
        "packed garbage": frame(plain(b"hello there")) + data[8 + size :],
        "square": plain(page.replace(length, "Content-Length: ²".encode())),
        "no base32": plain(revisit.replace(digest, b"1" * 32)),
        "short digest": plain(revisit.replace(digest, digest[:16])),
    }
    after = {"cut skippable": plain(page) + data[:4] + (100).to_bytes(4, "little") + b"short", "cut skippable header": plain(page) + data[:6], "three bytes": plain(page) + data[:3]}
    rows = warc.read_archives(spark.createDataFrame([*alone.items(), *after.items()], "archive string, content binary")).collect()
    for name in alone:
        assert [r.error is None for r in rows if r.archive == name] == [False], name
    for name in after:
        assert [r.error is None for r in rows if r.archive == name] == [True, False], name
    kept = warc.read_archives(spark.createDataFrame([("a", plain(page) + plain(revisit)), ("b", plain(revisit.replace(b"page:1>", b"page:7>")))], "archive string, content binary"))
    assert kept.filter("error is not null").count() == 0
    assert [(r.archive, r.refers_to_id) for r in warc.unresolved_revisits(kept).collect()] == [("b", "urn:x-page:7")]


def test_mixing(spark, ws, none):
    rng = random.Random(4)
    rows = [(i, invented(i, rng.randint(0, 60)), None if i % 50 == 0 else f"s{min(int(rng.expovariate(0.7)), 6)}") for i in range(1500)]
    rows += [(5000, None, "s1"), (5001, "", "empty"), (None, "a b c", "s2"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, ws).collect()
    assert len(got) == len(rows)
    sizes, order = {}, sorted({r[2] for r in rows if r[2] is not None}) + [None]
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    targets, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest = total - sum(targets.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    targets |= share
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in order)
    again = mixing.mix(docs.repartition(7), Workspace(spark, "again")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(none, Workspace(spark, "n")).count() == 0
    repeated = mixing.repeat_rows(docs, Workspace(spark, "r"))
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)


def test_transfer_keeps_words_and_expectation():
    rng = random.Random(1)
    for a, b, p, q in ((10, 10, 0.5, 0.5), (3, 100, 0.2, 0.7), (50, 7, 0.9, 0.95)):
        mean = np.zeros(2)
        for _ in range(4000):
            x, y = mixing.transfer(a, p, b, q, rng.random())
            assert x in (0.0, 1.0) or y in (0.0, 1.0)
            assert a * x + b * y == pytest.approx(a * p + b * q)
            mean += (x, y)
        assert np.allclose(mean / 4000, (p, q), atol=0.04)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def copies(n):
    """Groups of chained edits, and a passage that many documents share."""
    rng = random.Random(8)
    rows, passage = [], invented(77, 80).split()
    for g in range(n):
        words = invented(1000 + g, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = invented(rng.randrange(10**6), 1)
    for g in range(40):
        own = passage + invented(5000 + g, rng.randint(5, 60)).split()
        rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_dedup_is_all_pairs(spark, ws, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("docweave.llm.work.BROADCAST_ROWS", 0)
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(near_dedup, "SETS_A_PART", 2)
    rows = copies(25)
    got = near_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"), ws).select("row.doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r[:3]) for r in got) == sorted(brute_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_edges(spark, edge, none, ws):
    got = near_dedup.find(edge, ws).select("row.doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(edge_rows())))
    assert near_dedup.find(none, Workspace(spark, "n")).count() == 0
    one = near_dedup.keep_one(edge, Workspace(spark, "k"))
    assert one.columns == edge.columns
    texts = [r.text for r in one.collect()]
    assert sum(shingle_set(t) == shingle_set("Only four words here") for t in texts) == 1
    assert sum(t is None or not t.strip() for t in texts) == 4 and texts.count(invented(1, 200)) == 1


def test_components(spark, ws):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(2000, 2000 + k) for k in range(100)]
    got = dict(tuple(r) for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), ws, "c").collect())
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


BAD = ["grumblewort", "snarkbiter", "dolthead"]


def toxic_rows(n):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = invented(i, rng.randint(20, 200)).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ing", "xx", "o"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(800)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [(got[i], y) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and np.mean([r.predicted == y for r, y in held]) > 0.95
    model = toxicity.fit(docs, marks)
    assert model.word_odds(["snarkbitters"])[0] > 10 * abs(np.median(model.word_odds(invented(12345, 200).split())))


def test_scores_by_hand(spark):
    rows, labels = toxic_rows(200)
    model = toxicity.train([t for _, t in rows], [y for _, y in labels])
    got = spark.createDataFrame(rows[:30], "doc_id long, text string").select(toxicity.scorer(spark, model)(F.col("text")).alias("s")).collect()
    for (_, text), row in zip(rows, got, strict=False):
        words, odds = text.lower().split(), []
        for at in range(0, len(words), toxicity.PASSAGE):
            vectors = [model.embeddings[toxicity.grams_of(w)].astype("f8").mean(0) for w in words[at : at + toxicity.PASSAGE]]
            odds.append(float(np.mean(vectors, 0) @ (model.weights[1] - model.weights[0]).astype("f8")) + model.bias)
        lean = np.exp(toxicity.SHARP * np.array(odds))
        assert row.s == pytest.approx(1 / (1 + np.exp(-(lean * odds).sum() / lean.sum())), abs=1e-4)
    other = toxicity.Model(model.embeddings * 0, model.weights, model.biases)
    assert toxicity._odds_of(model) is toxicity._odds_of(model) and toxicity._odds_of(other) == {} and len(toxicity._ODDS) == 1


def test_no_training_at_all(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    rows, labels = toxic_rows(40)
    assert np.isfinite(toxicity.train([t for _, t in rows], [y for _, y in labels]).bias)


def test_pipeline_stages_on_edge_rows(spark, edge, none, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (11, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("edge", edge), ("none", none)):
        sizes = [docs.count()]
        for stage, make in corpus_pipeline.STAGES:
            out = make(spark, docs, str(tmp_path))
            assert stage == "byte_bpe" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            sizes.append(docs.count())
        assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4] and (name == "edge" or not any(sizes))


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.score_documents(edge, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(not r.predicted for r in toxicity.score_documents(edge, labels.limit(0)).collect() if r.doc_id in (4, 5))
    assert toxicity.score_documents(none, labels).count() == 0


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_rows(300)
    rows += [(1000 + i, t) for i, t in rows[1:40:2]]
    extra = [(i, t, f"s{i % 3}", "en", *["x"] * 6) for i, t in rows]
    spark.createDataFrame(extra, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "byte_bpe" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_dedup":
            assert not {r.doc_id for r in docs.collect()} & {1000 + i for i, _ in toxic_rows(300)[0][1:40:2]}
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
