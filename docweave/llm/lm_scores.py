"""Language-model scores from an n-gram trie of order three that is built in shards and never gathered.

Documents become blocks of tokens, numbered within the block. The blocks' words meet in shards of the
vocabulary, which count them and give them dense numbers, the most frequent first. A block then sends each
trie shard its distinct word triples with their training counts; the shard builds its trie from
all blocks' counts, looks every triple up, and answers with quantised probabilities and weights.
The numbers are exact: no hash of a word stands for it. Hashes only choose shards.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_trie import Trie
from .words import pack_columns, slices, split_words, unpack_columns
from .work import BROADCAST_ROWS, Workspace, table

#: Tokens of a block, about; all tokens for which there is one trie shard; words of blocks for which there is one shard of the vocabulary.
BLOCK_TOKENS, SHARD_TOKENS, SHARD_WORDS = 1_000_000, 2_000_000, 1_000_000
#: Weight of the next lower order in a context of one word and of two, in tokens.
MU = (200.0, 20.0)
# Numbers that are no words: in a block's own list of words, and in all. What training texts lack is UNKNOWN.
END, BEGIN, PAD, FIRST = 0, 1, 2, 3
UNKNOWN, G_BEGIN, G_PAD, G_END, G_FIRST = 0, 1, 2, 3, 4

BLOCK_SQL = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, n_words long, n_tokens long, learned_tokens long, learned_docs long, tokens binary, words binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SQL.split(", ")]
NUMBERED_SQL = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, tokens binary, numbers binary"
MESSAGE_SQL = "shard long, block long, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x.astype("u8") + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes), sizes)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def to_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``doc_id, text, held_out``: tokens as numbers in the block's own list of words.

    Tokens are the words of the text, A-Z in lower case, then one end; an empty text is the end alone.
    """
    block_tokens = BLOCK_TOKENS

    def close(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, held, lengths = ([x for part in parts for x in part[k]] for k in (0, 1, 2))
        every = pa.concat_arrays([part[4] for part in parts]).dictionary_encode()
        renumber = np.split(every.indices.to_numpy(), np.cumsum([len(part[4]) for part in parts])[:-1])
        words = np.concatenate([new[part[3]] for new, part in zip(renumber, parts, strict=True)])
        order = np.argsort(-np.bincount(words, minlength=len(every.dictionary)), kind="stable")
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        sizes = np.array(lengths)
        tokens = np.full(sizes.sum(), END)
        at = np.ones(len(tokens), bool)
        at[np.cumsum(sizes) - 1] = False
        tokens[at] = rank[words] + FIRST
        learn = ~np.array(held)
        listed = zstandard.ZstdCompressor(level=3).compress(b" ".join(every.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist()))
        row = [number, ids, held, lengths, len(order), len(tokens), int(sizes[learn].sum()), int(learn.sum()), pack_columns(tokens), listed]
        return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(BLOCK_NAMES, row, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for some in slices(batch):
                offsets, words = split_words(pc.ascii_lower(some.column("text")))
                coded = words.dictionary_encode()
                lengths = (np.diff(offsets) + 1).tolist()
                parts.append((some.column("doc_id").to_pylist(), some.column("held_out").to_pylist(), lengths, coded.indices.to_numpy(), coded.dictionary))
                size += sum(lengths)
                if size >= block_tokens:
                    yield close(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield close(number, parts)

    return docs.mapInArrow(run, BLOCK_SQL)


def _words_of(listed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(listed)
    return raw.split(b" ") if raw else []


def _by_shard(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' places by shard of the vocabulary, and where each shard's begin in that order."""
    shard = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def send_words(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's words with their training counts, one message for each shard of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            words = _words_of(row["words"])
            learn = np.repeat(~np.array(row["held_out"]), row["lengths"])
            counts = np.bincount(unpack_columns(row["tokens"])[0][learn], minlength=len(words) + FIRST)[FIRST:]
            order, bounds = _by_shard(words, shards)
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[s] : bounds[s + 1]]
                listed = zstandard.ZstdCompressor(level=3).compress(b" ".join([words[i] for i in own.tolist()]))
                yield pa.RecordBatch.from_pydict({"shard": [s], "block": [row["block"]], "payload": [listed], "counts": [pack_columns(counts[own])]})

    return blocks.select("block", "held_out", "lengths", "tokens", "words").mapInArrow(run, f"{MESSAGE_SQL}, counts binary")


def count_words(sent: DataFrame) -> DataFrame:
    """Answers to the blocks: each word's count and its rank in the shard by count. A row without a block has
    ``levels``: how many of the shard's words have a count of so many binary digits."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [_words_of(r["payload"]) for r in rows]
        coded = pa.concat_arrays([pa.array(x, pa.binary()) for x in lists]).dictionary_encode()
        at = coded.indices.to_numpy()
        counts = np.bincount(at, np.concatenate([unpack_columns(r["counts"])[0] for r in rows]), len(coded.dictionary)).astype("i8")
        order = pc.sort_indices(pa.table({"n": counts, "word": coded.dictionary}), [("n", "descending"), ("word", "ascending")]).to_numpy()
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        levels = np.bincount(np.frexp(counts[counts > 0].astype("f8"))[1], minlength=64)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        answers = [pack_columns(rank[x], counts[x]) for x in np.split(at, ends)]
        shard = rows[0]["shard"]
        out = {"shard": [shard] * (len(rows) + 1), "block": [*[r["block"] for r in rows], None], "payload": [*answers, None], "levels": [*[None] * len(rows), levels.tolist()]}
        return pa.Table.from_pydict(out, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("levels", pa.list_(pa.int64()))]))

    return sent.groupBy("shard").applyInArrow(run, f"{MESSAGE_SQL}, levels array<long>")


def number_words(blocks: DataFrame, counted: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """Blocks with ``numbers``, each local word's number in all and its count, and how many words training texts have.

    Words with more binary digits in their counts come first, then those of lower shards. The driver gets 64 numbers for each shard of the vocabulary.
    """
    rows = sorted(counted.filter("levels is not null").select("shard", "levels").collect())
    levels = np.array([r["levels"] for r in rows], "i8").reshape(-1, 64)[:, ::-1]
    before = np.cumsum(levels.T.reshape(-1)).reshape(64, -1).T - levels  # words of higher levels, and of this level in lower shards
    shift = (G_FIRST + before - (np.cumsum(levels, 1) - levels))[:, ::-1]
    shifts = blocks.sparkSession.createDataFrame([(r["shard"], s.tolist()) for r, s in zip(rows, shift, strict=True)], "shard long, shift array<long>")
    answers = counted.filter("block is not null").select("shard", "block", "payload").join(shifts, "shard")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words = _words_of(row.pop("words"))
        order, bounds = _by_shard(words, shards)
        number, count = np.zeros(len(words) + FIRST, "i8"), np.zeros(len(words) + FIRST, "i8")
        number[:FIRST] = (G_END, G_BEGIN, G_PAD)
        for answer in right.to_pylist():
            own = FIRST + order[bounds[answer["shard"]] : bounds[answer["shard"] + 1]]
            rank, n = unpack_columns(answer["payload"])
            count[own] = n
            number[own] = np.where(n > 0, rank + np.array(answer["shift"])[np.frexp(n.astype("f8"))[1]], UNKNOWN)
        return pa.Table.from_pydict({k: [v] for k, v in (row | {"numbers": pack_columns(number, count)}).items()})

    left = blocks.select("block", "doc_ids", "held_out", "lengths", "tokens", "words").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(run, NUMBERED_SQL), int(levels.sum())


class Block:
    """A block's distinct word triples, its documents being padded with two begins and one more place after the end."""

    def __init__(self, row: dict, learned_docs: int):
        self.lengths = np.array(row["lengths"])
        self.local = unpack_columns(row["tokens"])[0]
        number, self.counts = unpack_columns(row["numbers"])
        self.counts[END] = learned_docs
        self.words, rank = np.unique(number, return_inverse=True)
        self.total = np.zeros(len(self.words), "i8")  # how often a word stands before another one in training texts
        self.total[rank] = self.counts
        self.total[rank[BEGIN]], self.total[rank[PAD]], self.total[rank[END]] = learned_docs, 0, 0
        self.tokens = rank[self.local]
        padded = self.lengths + 3
        text = np.full(padded.sum(), rank[PAD])
        text[_starts(padded)] = text[_starts(padded) + 1] = rank[BEGIN]
        text[_within(self.lengths) + np.repeat(_starts(padded) + 2, self.lengths)] = self.tokens
        at = _within(self.lengths + 1) + np.repeat(_starts(padded), self.lengths + 1)
        self.a, self.b, self.c = text[at], text[at + 1], text[at + 2]
        self.learn = np.repeat(~np.array(row["held_out"], bool), self.lengths + 1)
        #: The triple that ends in each token; the next one begins with its context's last word.
        self.triple = np.arange(len(self.tokens)) + np.repeat(np.arange(len(self.lengths)), self.lengths)

    def often(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs whose words both stand before others at least ``n`` times, and the pairs' training counts."""
        hot = self.total >= n
        some = np.flatnonzero(hot[self.a] & hot[self.b] & self.learn)
        pairs, counts = np.unique(self.a[some] * len(self.words) + self.b[some], return_counts=True)
        return self.words[pairs // len(self.words)], self.words[pairs % len(self.words)], counts

    def distinct(self) -> np.ndarray:
        """Sort the triples; gives their order and leaves ``of``, the distinct triple of each place, and its counts."""
        bits = max(1, len(self.words).bit_length())
        key = self.a << bits | self.b
        if 3 * bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key << bits | self.c
        order = np.argsort(key)
        new = _new(key[order])
        self.of = np.empty(len(order), "i8")
        self.of[order] = np.cumsum(new) - 1
        self.n = np.bincount(self.of, self.learn, int(new.sum())).astype("i8")
        return order[new]

    def deal(self, shards: int, hot_tokens: int, hot: list[dict]) -> None:
        """Order the distinct triples by shard, then by their words. All triples of a first word share a shard unless there are
        ``hot_tokens`` of them; those of a pair do unless it is in ``hot``, whose counts are known."""
        first = self.distinct()
        a, b, c = self.words[self.a[first]], self.words[self.b[first]], self.words[self.c[first]]
        route = _scramble(a)
        wide = self.total[self.a[first]] >= hot_tokens
        route[wide] = _scramble(route[wide] ^ _scramble(b[wide] + 1))
        self.pair_total = np.zeros(len(a), "i8")
        if hot:
            known = sorted((p["a"] << 32 | p["b"], p["total"]) for p in hot)
            keys, totals = (np.array(x, "i8") for x in zip(*known, strict=True))
            at = np.minimum(np.searchsorted(keys, a << 32 | b), len(keys) - 1)
            self.pair_total = np.where(keys[at] == (a << 32 | b), totals[at], 0)
            at = np.flatnonzero(self.pair_total)
            route[at] = _scramble(route[at] + _scramble(c[at]) % (-(-self.pair_total[at] // hot_tokens)).astype("u8"))
        shard = (route % np.uint64(shards)).astype("i8")
        shard[(a == UNKNOWN) | (b == UNKNOWN)] = shards  # no training text has them
        order = np.argsort(shard.astype("u2") if shards < 1 << 16 else shard, kind="stable")
        self.place = np.empty(len(order), "i8")
        self.place[order] = np.arange(len(order))
        self.dealt = tuple(x[order] for x in (a, b, c, self.n, self.total[self.a[first]], self.pair_total))
        self.bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        self.asked = np.flatnonzero(np.diff(self.bounds))
        new_pair = _new(*self.dealt[:2], shard[order])
        self.pair_of = np.cumsum(new_pair) - 1
        self.pair_bounds = np.append(self.pair_of, len(new_pair) and self.pair_of[-1] + 1)[self.bounds]

    def message(self, shard: int) -> bytes:
        """A shard's triples, each first word and each pair given once."""
        a, b, c, n, total, pair_total = (x[self.bounds[shard] : self.bounds[shard + 1]] for x in self.dealt)
        pairs = np.flatnonzero(_new(a, b))
        firsts = np.flatnonzero(_new(a[pairs]))
        sizes = lambda at, end: np.diff(np.append(at, end))
        return pack_columns(a[pairs][firsts], total[pairs][firsts], sizes(firsts, len(pairs)), b[pairs], pair_total[pairs], sizes(pairs, len(a)), c, n)


def _blocks_of(batches: Iterator[pa.RecordBatch], learned_docs: int) -> Iterator[tuple[dict, Block]]:
    return ((row, Block(row, learned_docs)) for batch in batches for row in batch.to_pylist())


def hot_pairs(numbered: DataFrame, ws: Workspace, learned_docs: int, hot_tokens: int) -> DataFrame:
    """``block, hot``: the pairs ``a, b`` with at least ``hot_tokens`` training occurrences, their ``total``, for each block that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks_of(batches, learned_docs):
            a, b, n = block.often(hot_tokens)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "block": np.full(len(a), row["block"]), "n": n})

    pairs = ws.save(numbered.mapInArrow(run, "a long, b long, block long, n long"), "pairs")
    hot = pairs.groupBy("a", "b").agg(F.sum("n").alias("total")).filter(F.col("total") >= hot_tokens)
    return ws.save(pairs.join(hot, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("a", "b", "total")).alias("hot")), "hot")


def send_triples(numbered: DataFrame, shards: int, learned_docs: int, hot_tokens: int) -> DataFrame:
    """Each block's distinct triples with their training counts, one message for each shard that any belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks_of(batches, learned_docs):
            block.deal(shards, hot_tokens, row["hot"] or [])
            for s in block.asked.tolist():
                yield pa.RecordBatch.from_pydict({"shard": [s], "block": [row["block"]], "payload": [block.message(s)]})

    return numbered.mapInArrow(run, MESSAGE_SQL)


def answer_triples(sent: DataFrame, vocabulary: int, mu: tuple[float, float]) -> DataFrame:
    """A trie for each shard, and its answers: codes of the pairs' probabilities and weights and of the triples' probabilities, and what the codes mean."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        parts = [unpack_columns(r["payload"]) for r in rows]
        join = lambda k: np.concatenate([p[k] for p in parts])
        ids, n_pairs = join(0), join(2)
        pairs, pair_of = np.unique(np.repeat(ids, n_pairs).astype("u8") << np.uint64(32) | join(3).astype("u8"), return_inverse=True)
        total_a, given = np.zeros(len(pairs), "i8"), np.zeros(len(pairs), "i8")
        total_a[pair_of] = np.repeat(join(1), n_pairs)
        given[pair_of] = join(4)
        key = np.repeat(pair_of, join(5)) << 32 | join(6)
        order = np.argsort(key, kind="stable")  # of sorted runs
        new = _new(key[order])
        triples = key[order][new]
        triple_of = np.empty(len(order), "i8")
        triple_of[order] = np.cumsum(new) - 1
        n = np.bincount(triple_of, join(7), len(triples)).astype("i8")
        of, third = triples >> 32, triples & 0xFFFFFFFF
        total = np.where(given > 0, given, np.bincount(of, n, len(pairs)).astype("i8"))  # a pair whose triples other shards have too
        a, b = (pairs >> np.uint64(32)).astype("i8"), (pairs & np.uint64(0xFFFFFFFF)).astype("i8")
        seen, node = total > 0, np.cumsum(total > 0) - 1
        learned = n > 0
        data = Trie.build(a[seen], b[seen], total_a[seen], total[seen], node[of[learned]], third[learned], n[learned], vocabulary, mu)
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            trie = Trie(np.memmap(file, "u1", "r"))
            at = trie.find_pairs(a, b)
            p2, weights = trie.codes(trie.p2, at), trie.codes(trie.weights, at)
            p3 = trie.codes(trie.p3, trie.find_thirds(at[of], third))
            books = np.concatenate([np.resize(np.append(b, np.zeros(256)), 256) for b in (trie.p2_book, trie.weight_book, trie.p3_book)]).astype("<f4").tobytes()
        pair_ends, triple_ends = (np.cumsum([len(p[k]) for p in parts])[:-1] for k in (3, 6))
        split = zip(np.split(p2[pair_of], pair_ends), np.split(weights[pair_of], pair_ends), np.split(p3[triple_of], triple_ends), strict=True)
        return pa.table({"shard": [r["shard"] for r in rows], "block": [r["block"] for r in rows], "payload": [pack_columns(*codes) for codes in split], "books": [books] * len(rows)})

    return sent.groupBy("shard").applyInArrow(run, f"{MESSAGE_SQL}, books binary")


def score_blocks(numbered: DataFrame, answers: DataFrame, shards: int, learned_docs: int, hot_tokens: int, mu: tuple[float, float], n: int, v: int) -> DataFrame:
    """Scores of each block's documents from the shards' answers and its words' counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row, learned_docs)
        block.deal(shards, hot_tokens, row["hot"] or [])
        p2, weight = np.zeros(int(block.pair_of[-1]) + 1), np.ones(int(block.pair_of[-1]) + 1)  # what is unseen leaves all to the lower order
        p3 = np.zeros(len(block.place))
        for answer in right.to_pylist():
            s, books = answer["shard"], 10 ** np.frombuffer(answer["books"], "<f4").reshape(3, 256).astype("f8")
            books[[0, 2], 0] = 0
            pairs, triples = slice(block.pair_bounds[s], block.pair_bounds[s + 1]), slice(block.bounds[s], block.bounds[s + 1])
            codes = unpack_columns(answer["payload"])
            p2[pairs], weight[pairs], p3[triples] = books[0][codes[0]], books[1][codes[1]], books[2][codes[2]]
        own, following = block.place[block.of[block.triple]], block.place[block.of[block.triple + 1]]
        known = block.counts[block.local]
        p1 = (known + 1) / (n + v + 1)
        before = block.total[block.b[block.triple]]
        p = p2[block.pair_of[following]] + mu[0] / (before + mu[0]) * p1
        p = p3[own] + weight[block.pair_of[own]] * p
        starts = _starts(block.lengths)
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), *map(pa.array, (block.lengths, np.add.reduceat((known > 0).astype("i8"), starts), np.add.reduceat(np.log10(p1), starts), np.add.reduceat(np.log10(p), starts)))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


def score_documents(docs: DataFrame, ws: Workspace, mu: tuple[float, float] = MU) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Held out are rows whose crc32(doc_id) mod 7 is 2; rows without an id are not. A null or empty text
    is one token, the end; a very long text is one block. Repeated rows are counted each time. Other columns are
    ignored, whatever their names; an empty table gives an empty result. The driver gets totals, and
    64 numbers for each shard of the vocabulary.

    A first word with a quarter of SHARD_TOKENS occurrences has its pairs spread over shards, such a pair its triples,
    so a shard holds no more than its share however frequent a word is.
    """
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    slim = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    blocks = ws.save(to_blocks(slim), "blocks")
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "learned_tokens", "learned_docs"))).first()
    shards, word_shards = max(1, -(-sums["n_tokens"] // SHARD_TOKENS)), max(1, -(-sums["n_words"] // SHARD_WORDS))
    n, learned_docs, hot_tokens = sums["learned_tokens"], sums["learned_docs"], max(1, SHARD_TOKENS // 4)
    counted = ws.save(count_words(send_words(blocks, word_shards)), "counted")
    ws.release()
    numbered, words = number_words(blocks, counted, word_shards)
    numbered = ws.save(numbered, "numbered")
    ws.drop("blocks", "counted")
    ws.release()
    hot = hot_pairs(numbered, ws, learned_docs, hot_tokens)
    few = (hot.agg(F.sum(F.size("hot"))).first()[0] or 0) <= BROADCAST_ROWS
    numbered = numbered.join(F.broadcast(hot) if few else hot, "block", "left")
    vocabulary = G_FIRST + words
    answers = ws.save(answer_triples(send_triples(numbered, shards, learned_docs, hot_tokens), vocabulary, mu), "answers")
    ws.release()
    scored = score_blocks(numbered, answers, shards, learned_docs, hot_tokens, mu, n, words + (learned_docs > 0))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Workspace(spark, "lm"))
