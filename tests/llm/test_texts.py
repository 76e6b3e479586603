"""Operators that keep one row for each document: 4, 5, 6, 8, 9, 10."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from docweave.llm import byte_bpe, iblt, lm_scores, mpeg_audio, ngram_trie, packed_ids, token_counts, word_encoder
from docweave.llm.word_encoder import WordEncoder

from .conftest import edge_rows, invented

WORD = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [(r[0], r[1] or "") for r in edge_rows()]


def many(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_token_counts(edge, none, library):
    got = token_counts.count_tokens(edge, WORD)
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in TEXTS]
    assert many(got.collect()) == many(want)
    assert token_counts.count_tokens(none, WORD).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_of_other_tokenizers(edge, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(edge, path).select("doc_id", "n_tokens").collect()
    assert many(got) == many((i, count(t)) for i, t in TEXTS)


def test_words_encode_as_whole_texts(library, monkeypatch):
    monkeypatch.setattr(word_encoder, "CACHE_PIECES", 50)
    monkeypatch.setattr(word_encoder, "WORDS_TOGETHER", 3)
    rng = random.Random(3)
    encoder = WordEncoder(WORD)
    texts = ["".join(rng.choice("abAB .,'’é²<|>\n\x1c 日ßİſ1") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x<|endoftext|>y <|startoftext|>", "don't DON'T they'll", "É É", "word.word ...word,, %%%a", "ÀÉß.. ÑANDÚ, straßE! µ ª aª ÿ÷ Ÿ x\n"]
    for k in range(0, len(texts), 100):
        ends, ids = encoder.encode(pa.array(texts[k : k + 100]))
        assert np.diff(ends).tolist() == encoder.counts(pa.array(texts[k : k + 100])).tolist()
        for text, a, b in zip(texts[k : k + 100], ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_caches_keep_no_long_words(library):
    encoder, text = WordEncoder(WORD), "日本語のとても長い文" * 200 + " short"
    assert encoder.encode(pa.array([text]))[1].tolist() == library.encode(text, add_special_tokens=False).ids
    codec = byte_bpe.ByteBpe.read(MULTI, public_tokenizers.PATTERN)
    codec.encode("x" * 500)
    assert max(map(len, [*encoder.known, *codec.cache])) <= 64


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 16, 17, 31, 32):
        for n in (0, 1, 31, 32, 33, 5000):
            ids = rng.integers(0, 1 << bits, n, dtype="u8")
            assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, n) == ids).all()
    docs = [rng.integers(0, 49408, n).astype("<u4") for n in (0, 5, 4096, 9000, 1)]
    shard = packed_ids.Shard(packed_ids.write_shard([3, None, 5, 6, 7], docs, 16))
    assert [(d, ids.tolist()) for d, _, ids in shard.documents()] == [(d, x.tolist()) for d, x in zip([3, None, 5, 6, 7], docs, strict=True)]
    assert shard.ids(4000, 9050).tolist() == np.concatenate(docs)[4000:9050].tolist()
    with pytest.raises(ValueError):
        packed_ids.Shard(packed_ids.write_shard([1], docs[1:2], 16)[:-1])


def test_token_ids(edge, none, ws, library, monkeypatch):
    monkeypatch.setattr(packed_ids, "SHARD_IDS", 500)
    got = packed_ids.read_shards(ws.save(packed_ids.encode_shards(edge, WORD, 1), "s")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert many((r.doc_id, r.ids_crc32) for r in got) == many((i, crc(t)) for i, t in TEXTS)
    assert packed_ids.read_shards(ws.save(packed_ids.encode_shards(none, WORD, 1), "n")).count() == 0


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(edge, none, reference):
    got = byte_bpe.encode_texts(edge, MULTI, public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in TEXTS:
        ids = reference.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert many(got.drop("ids").collect()) == many(want)
    back = byte_bpe.decode_ids(got, MULTI, public_tokenizers.PATTERN).collect()
    assert many((r.doc_id, bytes(r.text).decode()) for r in back) == many(TEXTS)
    assert byte_bpe.encode_texts(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_random_texts(reference):
    codec = byte_bpe.ByteBpe.read(MULTI, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("aab bbcéñ日本 \n\t'sx1²ª\x1c\xa0\x85.") for _ in range(rng.randint(0, 60)))
        assert codec.encode(text) == reference.encode_ordinary(text)
    assert all(codec.lookup(t) == i for i, t in codec.token.items()) and codec.lookup(b"\xff\xfe\xfd") == -1
    assert sorted(codec.hash.slots) == list(range(codec.hash.n))


def test_mpeg_round_trip(edge, none, ws):
    got = mpeg_audio.read_back(ws.save(mpeg_audio.store_texts(edge), "m")).collect()
    pad = lambda b: b + bytes(-len(b) % 64 if b else 64)
    want = [(i, len(t.encode()), len(p := pad(t.encode())), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in TEXTS]
    assert many((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == many(want)
    media = {r.doc_id: bytes(r.media) for r in ws.save(mpeg_audio.store_texts(edge.filter("doc_id > 6")), "again").collect()}
    for r in got:
        if r.doc_id in media:
            data, audio = media[r.doc_id], mpeg_audio.parse(media[r.doc_id])
            assert (r.media_bytes, r.media_sha256, r.frame_offsets) == (len(data), hashlib.sha256(data).hexdigest(), audio.offsets)
            frames = -(-r.payload_bytes // mpeg_audio.ROOM[320])
            assert r.feature.startswith(f"mpeg1-layer3 frames={frames} samples={frames * 1152} ") and f"crc={frames}/{frames} Xing={frames}" in r.feature
    assert mpeg_audio.read_back(ws.save(mpeg_audio.store_texts(none), "n")).count() == 0


def test_checksum_by_hand():
    rng = random.Random(4)
    for _ in range(50):
        data, crc = rng.randbytes(rng.randint(0, 40)), 0xFFFF
        for byte in data:
            for k in range(7, -1, -1):
                crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ (byte >> k & 1) else 0)
        assert mpeg_audio.crc16(data) == crc


def test_mpeg_any_bytes():
    rng = random.Random(6)
    whole = mpeg_audio.store(rng.randbytes(6000))
    vbri = bytes((0xFF, 0xFB, 0x14, 0xC0)).ljust(36, b"\0") + b"VBRI"
    for data in [vbri, vbri + b"\0" * 9, vbri.ljust(144, b"\xff"), b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"TAG".ljust(128, b"x"), b"APETAGEX" + b"\xff" * 24]:
        mpeg_audio.parse(data)
    for _ in range(400):
        data = bytearray(whole[rng.randrange(200) : rng.randrange(len(whole))])
        for _ in range(rng.randint(0, 30)):
            if data:
                data[rng.randrange(len(data))] = rng.choice([0, 255, 0xFB, rng.randrange(256)])
        audio = mpeg_audio.parse(bytes(data) + rng.choice([b"", b"TAG".ljust(128, b"\0"), rng.randbytes(50)]))
        assert sum(audio.sizes) + audio.skipped <= len(data) + 128 and audio.offsets == sorted(audio.offsets)


def test_mpeg_parsing(spark):
    data = mpeg_audio.store(b"abc" * 3000)
    audio = mpeg_audio.parse(data)
    assert audio.table == "Xing" and audio.table_frames == len(audio.offsets) == 7 and audio.checked == 7 and not audio.broken and not audio.skipped
    assert audio.samples == 7 * 1152 and audio.duration == mpeg_audio.Fraction(7 * 1152, 32000)
    assert all(data[o] == 0xFF for o in audio.offsets) and audio.seek[0] <= audio.offsets[0]
    junk = mpeg_audio.parse(data[: audio.offsets[2]] + b"\xff\xfbjunk\xff" + data[audio.offsets[2] :] + b"TAG" + b"Title".ljust(125, b"\0"))
    assert junk.skipped == 7 and len(junk.offsets) == 7 and junk.tags["TIT2"] == "Title"
    hurt = bytearray(data)
    hurt[audio.offsets[1] + 8] ^= 1  # side information
    assert mpeg_audio.parse(bytes(hurt)).broken == 1
    with pytest.raises(ValueError):
        mpeg_audio.payload_of(bytes(hurt), mpeg_audio.parse(bytes(hurt)))
    rows = spark.createDataFrame([(1, data), (2, None), (3, b"no audio")], "doc_id long, media binary")
    assert [(r.doc_id, r.frames) for r in mpeg_audio.read_audio(rows).orderBy("doc_id").collect()] == [(1, 7), (2, 0), (3, 0)]


def test_mpeg_tag_names_in_the_payload():
    for kbps, room in mpeg_audio.ROOM.items():
        for size in {room, max(1, room - 40), room + mpeg_audio.ROOM[320]}:
            for name in (b"TAG", b"APETAGEX", b"APETAGEX\0\x07\0\0\x40\0\0\0\x01\0\0\0\0\0\0\x80"):
                length = len(mpeg_audio.store(b"x" * size))
                start = length - (128 if name == b"TAG" else 32) - mpeg_audio.store(b"x" * size).rindex(b"x") - 1 + size
                for at in {start, size - 128, size - 32}:
                    if 0 <= at <= size - len(name):
                        payload = b"x" * at + name + b"x" * (size - at - len(name))
                        data = mpeg_audio.store(payload)
                        audio = mpeg_audio.parse(data)
                        assert mpeg_audio.payload_of(data, audio) == payload and list(audio.tags) == [mpeg_audio.LENGTH_TAG] and not audio.skipped
                        signed = data + b"TAG" + b"Title".ljust(125, b"\0")
                        audio = mpeg_audio.parse(signed)
                        assert mpeg_audio.payload_of(signed, audio) == payload and audio.tags["TIT2"] == "Title" and not audio.skipped


def test_mpeg_cut_frame_before_a_tag():
    data = mpeg_audio.store(b"abc" * 3000)
    audio = mpeg_audio.parse(data[:-50] + b"TAG" + b"Title".ljust(125, b"\0"))
    assert len(audio.offsets) == 6 and audio.tags["TIT2"] == "Title"


def test_mpeg_text_with_tag_at_the_end(spark, ws):
    texts = [(size, "x" * at + "HASHTAG " + "x" * (size - at - 8)) for size in (128, 192) for at in range(size - 7)]
    media = ws.save(mpeg_audio.store_texts(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)), "tagged")
    got = mpeg_audio.read_back(media).collect()
    assert sorted((r.doc_id, r.payload_sha256) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)


def plain_pieces(text):
    """A text's paragraphs as they are: lines, longer ones cut after words whose digest is a multiple of eight, or after 32 words."""
    out = set()
    for line in text.split("\n"):
        words, piece = line.split(), []
        for word in words:
            piece.append(word)
            if len(words) > 8 and (len(piece) == 32 or xxhash.xxh3_64_intdigest(word) % 8 == 0):
                out.add(" ".join(piece))
                piece = []
        if piece:
            out.add(" ".join(piece))
    return out


def test_fingerprints(edge, none, ws, spark):
    got = iblt.compare_with_next(edge, ws).collect()
    assert len(got) == len(TEXTS) and iblt.compare_with_next(none, type(ws)(spark, "n")).count() == 0
    keyed = edge.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for row, following in zip(order, order[1:] + order[:1], strict=True):  # rows without an id, and the last, too
        changed = row.text[: len(row.text) - len(row.text) // 3] + following.text[: len(row.text) // 3]
        own, after = plain_pieces(row.text), plain_pieces(following.text)
        likeness = [round(jaccard(own, x), 9) for x in (plain_pieces(changed), after)]
        want.append((row.doc_id, len(row.text), hashlib.sha256(changed.encode()).hexdigest(), *likeness))
    assert many((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == many(want)
    assert all(r.edited_cells >= iblt.CELLS and r.next_cells >= iblt.CELLS for r in got)
    assert all(r.edited_cells == iblt.CELLS for r in got if r.fingerprint == r.edited_fingerprint and r.near_edited == 1)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 3)}) == 1


def test_peeling_recovers_differences():
    rng = np.random.default_rng(2)
    pairs = []
    for n in (0, 1, 3, 50, 3000):
        shared, a, b = (rng.integers(0, 1 << 63, n, dtype="u8") for _ in range(3))
        pairs.append((np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b[: n // 2]]))))
    for (a, b), (mine, theirs, _) in zip(pairs, iblt.differences(pairs), strict=True):
        assert set(mine) == set(a) - set(b) and set(theirs) == set(b) - set(a)


def test_fingerprints_realign_after_an_edit():
    words = invented(4, 2000).split()
    digests = lambda x: iblt.paragraph_digests(" ".join(x))
    for near in (["inserted", *words], words[1:], [*words[:700], "inserted", *words[700:1500], *words[1501:]]):
        assert iblt.likenesses([(digests(words), digests(near))])[0][0] > 0.9
    assert len(digests(["same"] * 1000)) < 5 and len(digests(words)) > 2000 / 16


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe, n in ((10, 5), (1000, 300), (10**9, 1000), (7, 200), (1, 0), (2**40, 50)):
        values = np.sort(rng.integers(0, universe, n))
        coded = ngram_trie.EliasFano.build(values, universe)
        assert (coded.access(np.arange(n)) == values).all()
        x = rng.integers(0, universe, 400)
        assert (coded.successor(x, np.zeros(400, "i8"), np.full(400, n)) == np.searchsorted(values, x)).all()


def lm_by_hand(rows):
    """Scores of (doc_id, text) rows from plain counts of one, two and three words."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    ones, pairs, triples, before = Counter(), Counter(), Counter(), Counter()
    sequences = [(i, [("begin",), ("begin",), *t.encode().lower().split(), ("end",)]) for i, t in rows]
    for i, s in sequences:
        if not out(i):
            ones.update(s[2:])
            pairs.update(zip(s[1:], s[2:], strict=False))
            before.update(s[1:-1])
            triples.update(zip(s, s[1:], s[2:], strict=False))
            pairs[("begin",), ("begin",)] += 1
    n, v, (mu2, mu3) = sum(ones.values()), len(ones), lm_scores.MU
    p1 = lambda w: (ones[w] + 1) / (n + v + 1)
    p2 = lambda b, w: (pairs[b, w] + mu2 * p1(w)) / (before[b] + mu2)
    p3 = lambda a, b, w: (triples[a, b, w] + mu3 * p2(b, w)) / (pairs[a, b] + mu3)
    for i, s in sequences:
        w = s[2:]
        yield i, out(i), len(w), sum(ones[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p3(*x)) for x in zip(s, s[1:], w, strict=False))


@pytest.mark.parametrize(("block", "shard"), [(1000, 5000), (2_000_000, 4_000_000), (50, 40)])
def test_lm_scores(none, ws, spark, monkeypatch, block, shard):
    monkeypatch.setattr(lm_scores, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_scores, "SHARD_TOKENS", shard)
    monkeypatch.setattr(lm_scores, "SHARD_WORDS", shard)
    rng = random.Random(5)
    rows = [(i, t) for i, t in TEXTS if shard > 40 or len(t) < 5000]
    rows += [(i, " ".join(rng.choice(["of the", "enc", "END", "begin", "a", "b", invented(i, 1)]) for _ in range(rng.randint(0, 40)))) for i in range(100, 180)]
    got = lm_scores.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ws).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(lm_by_hand(rows), key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=0.01)
    assert lm_scores.score_documents(none, type(ws)(spark, "n")).count() == 0


def test_trie():
    rng = np.random.default_rng(1)
    triples, n = np.unique(rng.integers(4, 40, (4000, 3)), axis=0, return_counts=True)
    pairs, pair = np.unique(triples[:, :2], axis=0, return_inverse=True)
    total = np.bincount(pair, n).astype("i8")
    total_a = np.bincount(pairs[:, 0], total)[pairs[:, 0]].astype("i8")
    trie = ngram_trie.Trie(np.frombuffer(ngram_trie.Trie.build(pairs[:, 0], pairs[:, 1], total_a, total, pair, triples[:, 2], n, 50, (9.0, 3.0)), "u1"))
    ask = np.array([(a, b, c) for a in range(50) for b in range(50) for c in range(0, 50, 7)])
    known = {tuple(t): k for t, k in zip(triples.tolist(), n.tolist(), strict=True)}
    held = {tuple(t): (x, y) for t, x, y in zip(pairs.tolist(), total.tolist(), total_a.tolist(), strict=True)}
    node = trie.find_pairs(ask[:, 0], ask[:, 1])
    third = trie.find_thirds(node, ask[:, 2])
    p2, weight, p3 = (book[trie.codes(codes, at)] for book, codes, at in ((trie.p2_book, trie.p2, node), (trie.weight_book, trie.weights, node), (trie.p3_book, trie.p3, third)))
    for i, (a, b, c) in enumerate(ask.tolist()):
        assert (node[i] >= 0) == ((a, b) in held) and (third[i] >= 0) == ((a, b, c) in known)
        if (a, b) in held:
            x, y = held[a, b]
            assert p2[i] == pytest.approx(math.log10(x / (y + 9)), abs=0.01) and weight[i] == pytest.approx(math.log10(3 / (x + 3)), abs=0.01)
        if (a, b, c) in known:
            assert p3[i] == pytest.approx(math.log10(known[a, b, c] / (x + 3)), abs=0.01)
    empty = np.zeros(0, "i8")
    none = ngram_trie.Trie(np.frombuffer(ngram_trie.Trie.build(*[empty] * 7, 5, (9.0, 3.0)), "u1"))
    assert none.find_pairs(np.array([1]), np.array([2])).tolist() == [-1] and none.find_thirds(np.array([-1]), np.array([2])).tolist() == [-1]
