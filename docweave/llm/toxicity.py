"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its character n-grams' embeddings, a passage's the mean
of its words'. A softmax layer gives the passage's log-odds; a document's are its
passages', weighted towards the highest, since a few words make a long text toxic.
Embeddings and layer learn together from the documents' labels alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, table

#: n-gram lengths, hashed to so many rows of embeddings, and words of a passage.
GRAMS, BUCKETS, DIM, PASSAGE = (3, 4, 5, 6), 1 << 18, 4, 8
#: How strongly a document's log-odds lean to its highest passages.
SHARP = 4.0
#: The training sample's bounds: rows of each label, and UTF-8 bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16 << 20
EPOCHS, RATE, DECAY, SEED = 12, 0.05, 1e-6, 7
GAIN = 6.0
#: An n-gram is learned only if it is in so many documents of the sample, or in this share of them if that is more.
MIN_DOCS, MIN_SHARE = 3, 0.002
CACHE = 400_000

_WORDS = re.compile(r"\w+")
_MAX_WORD = 40  # a longer word is taken in pieces


def words_of(text: str) -> list[str]:
    words = _WORDS.findall(text.lower())
    if any(len(w) > _MAX_WORD for w in words):
        words = [w[i : i + _MAX_WORD] for w in words for i in range(0, len(w), _MAX_WORD)]
    return words


def grams_of(word: str) -> list[int]:
    """Rows of the embeddings for a word's n-grams; the whole word, with its edges, is one too."""
    edged = f"<{word}>"
    found = {edged[i : i + n] for n in GRAMS for i in range(len(edged) - n + 1)} | {edged}
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in found]


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram rows of all words, one word after another, and how many each word has."""
    bags = [grams_of(w) for w in words]
    return np.fromiter((g for bag in bags for g in bag), "i4"), np.fromiter(map(len, bags), "i8", len(bags))


@dataclass
class Model:
    """Embeddings, and the softmax layer's weights and biases of the two labels."""

    embeddings: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def word_odds(self, words: list[str]) -> np.ndarray:
        """What each word adds to the log-odds, before the mean: the layer is linear, so means of odds are odds of means."""
        if not words:
            return np.zeros(0)
        flat, sizes = _bags(words)
        odds = self.embeddings[flat] @ (self.weights[1] - self.weights[0])
        return np.add.reduceat(odds, np.cumsum(sizes) - sizes) / sizes

    def digest(self) -> bytes:
        """What tells models apart."""
        return xxhash.xxh3_128_digest(b"".join(x.tobytes() for x in (self.embeddings, self.weights, self.biases)))

    @property
    def bias(self) -> float:
        return float(self.biases[1] - self.biases[0])


def passage_starts(n_words: int) -> np.ndarray:
    return np.arange(0, n_words, PASSAGE)


def document_odds(passages: np.ndarray) -> float:
    """Log-odds of a document of these passages."""
    lean = np.exp(SHARP * (passages - passages.max()))
    return float((lean * passages).sum() / lean.sum())


def _expand(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The values of ``flat`` in the runs ``at``, one run after another."""
    lengths = sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit by full-batch Adam on the documents' cross-entropy, both labels with half the weight."""
    rng = np.random.default_rng(SEED)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype("f4"), rng.normal(0, 0.1, (2, DIM)).astype("f4"), np.array([1.0, -1.0], "f4"))
    number: dict[str, int] = {}
    word_at, passage_sizes, doc_sizes, y = [], [], [], []
    for text, label in zip(texts, labels, strict=True):
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        if ids:
            word_at.append(np.array(ids))
            starts = passage_starts(len(ids))
            passage_sizes.append(np.diff(np.append(starts, len(ids))))
            doc_sizes.append(len(starts))
            y.append(label)
    if len(set(y)) < 2:
        return model
    word_at, sizes, docs, y = np.concatenate(word_at), np.concatenate(passage_sizes), np.array(doc_sizes), np.array(y, "f4")
    flat, gram_sizes = _bags(list(number))
    gram_starts, starts, doc_starts = (np.cumsum(s) - s for s in (gram_sizes, sizes, docs))
    gram_word, passage_of, doc_of = (np.repeat(np.arange(len(s)), s) for s in (gram_sizes, sizes, docs))
    spread_in, toxic_in = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8")
    ends = np.cumsum(np.add.reduceat(sizes, doc_starts))
    for label, end, n in zip(y, ends, np.diff(np.append(0, ends)), strict=True):
        words = np.unique(word_at[end - n : end])
        grams = np.unique(_expand(words, gram_starts, gram_sizes, flat))
        spread_in[grams] += 1
        toxic_in[grams] += label > 0
    # The first dimension starts at each n-gram's smoothed log-odds, the layer at a gain for it.
    model.embeddings[:, 0] = np.log((toxic_in + 0.5) / (y.sum() + 1)) - np.log((spread_in - toxic_in + 0.5) / (len(y) - y.sum() + 1))
    model.weights[:, 0] = (-GAIN / 2, GAIN / 2)
    flat[spread_in[flat] < max(MIN_DOCS, MIN_SHARE * len(docs))] = BUCKETS  # one row for all rare n-grams, kept at 0
    used = np.unique(np.append(flat, BUCKETS))
    gram_at = np.searchsorted(used, flat).astype("i4")
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    table_ = np.append(model.embeddings, np.zeros((1, DIM), "f4"), 0)[used]
    params = [table_, model.weights, model.biases]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    spread = lambda at, values, of, n: np.stack([np.bincount(at, values[:, k][of], n) for k in range(values.shape[1])], 1)
    odds, lean = np.zeros(len(sizes)), np.repeat(1 / docs, docs)  # what no training says
    for step in range(1, EPOCHS + 1):
        table_, w, b = params
        vectors = np.stack([np.add.reduceat(table_[:, k][gram_at], gram_starts) for k in range(DIM)], 1) / gram_sizes[:, None]
        hidden = np.add.reduceat(vectors[word_at], starts) / sizes[:, None]
        odds = hidden @ (w[1] - w[0]) + (b[1] - b[0])
        top = np.maximum.reduceat(odds, doc_starts)
        lean = np.exp(SHARP * (odds - top[doc_of]))
        lean /= np.add.reduceat(lean, doc_starts)[doc_of]
        p = 1 / (1 + np.exp(-np.add.reduceat(lean * odds, doc_starts)))
        slope = lean * (weight * (p - y))[doc_of]
        towards = np.outer(slope, w[1] - w[0])
        to_words = spread(word_at, towards / sizes[:, None], passage_of, len(number))
        to_grams = spread(gram_at, to_words / gram_sizes[:, None], gram_word, len(used))
        to_grams[-1] = 0
        to_grams += DECAY * table_
        up = hidden.T @ slope
        for i, grad in enumerate((to_grams, np.stack([-up, up]), np.array([-slope.sum(), slope.sum()]))):
            m, v = moments[i]
            m[...] = 0.9 * m + 0.1 * grad
            v[...] = 0.999 * v + 0.001 * grad * grad
            params[i] = (params[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype("f4")
    # Put the boundary where the sample's labels part best: between the two documents next to it, nearer to
    # the clean one, since toxic words that were not learned score lower than those that were.
    found = np.add.reduceat(lean * odds, doc_starts)
    order = np.argsort(found)
    gain = np.cumsum(np.where(y[order] > 0, -weight[order], weight[order]))
    best = np.flatnonzero(gain >= gain.max() - 1e-6)
    cut = 0.75 * found[order[best[0]]] + 0.25 * found[order[min(best[-1] + 1, len(order) - 1)]]
    params[2] = params[2] - np.array([-cut / 2, cut / 2], "f4")
    model.embeddings *= 0  # n-grams that were never seen say nothing
    model.embeddings[used[:-1]], model.weights, model.biases = params[0][:-1], params[1], params[2]
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of rows whose crc32(doc_id) mod 5 is not 0: at most SAMPLE_ROWS of each
    label and about SAMPLE_BYTES in all, those with the lowest hashes of their ids."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    picked = known.filter("toxic > 0").orderBy(order, "doc_id").limit(SAMPLE_ROWS).unionByName(known.filter("toxic <= 0").orderBy(order, "doc_id").limit(SAMPLE_ROWS))
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if n_bytes > SAMPLE_BYTES:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE_BYTES / n_bytes))
    found = sorted((r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows.toLocalIterator())
    return [t for _, t, _ in found], [y for _, _, y in found]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


_ODDS: dict[bytes, dict[str, float]] = {}


def _odds_of(model: Model) -> dict[str, float]:
    """The words' odds that this Python worker knows of a model; those of any other model are dropped."""
    key = model.digest()
    if key not in _ODDS:
        _ODDS.clear()
        _ODDS[key] = {}
    return _ODDS[key]


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: a text's toxicity from 0 to 1. The broadcast model has a fixed size, 9 MB."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        known = _odds_of(model)
        for texts in batches:
            out = np.empty(len(texts))
            for at in range(0, len(texts), 256):
                split = [words_of(t) for t in texts.iloc[at : at + 256]]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for words in split for w in words if w not in known})
                known.update(zip(new, model.word_odds(new).tolist(), strict=True))
                for i, words in enumerate(split, at):
                    if words:
                        starts = passage_starts(len(words))
                        sums = np.add.reduceat(np.fromiter(map(known.__getitem__, words), "f8", len(words)), starts)
                        odds = document_odds(sums / np.diff(np.append(starts, len(words))) + model.bias)
                    else:
                        odds = model.bias
                    out[i] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            yield pd.Series(out)

    return lambda text: score(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_sample(docs, labels))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text gets the score of a text without words; a very long one is scored whole, passage by passage. Repeated
    rows and ties get equal scores; rows without an id are scored, never learned from. Without labels of both kinds nothing is
    toxic. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    score = scorer(docs.sparkSession, fit(docs, labels))
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


__all__ = ["Model", "Workspace", "fit", "op7_toxicity", "score_documents", "scorer", "train"]
