"""Exact whole-text encoding with a public tokenizer, a batch of distinct words at a time.

A tokenizer whose pre-tokenizer drops white space never lets a token reach over
it, so a text's ids are the ids of its words one after another. Arrow splits a batch of texts and
numbers its distinct words; each goes through the library once and is kept in a bounded cache of the
Python worker. For any other tokenizer whole texts are handed to the library, never split.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import split_words

#: Distinct pieces of words that a worker keeps before it starts afresh, and the letters of the longest that it
#: keeps: together they bound the cache's bytes, also for texts without spaces.
CACHE_PIECES, CACHE_LETTERS = 600_000, 64
#: Words of plain letters in one text for the library.
WORDS_TOGETHER = 500
#: UTF-8 bytes, about, that one call of the library gets.
BATCH_BYTES = 1 << 18

# Letters that lower-casing and composition leave as single letters, then plain punctuation.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?|%&$*#]*)$"
_LETTERS = re.compile("[a-zà-öø-ÿß]+")
_PLAIN_CHARACTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?|%&$*#]+"


def drops_white_space(path: str) -> bool:
    """Whether a tokenizers file cuts at white space, removes it and lower-cases letter by letter."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
        and r"[\p{L}]+" in first.get("pattern", {}).get("Regex", "")
        and kinds == {"NFC", "Replace", "Lowercase"}
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    )


def byte_batches(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in batches of about ``limit`` bytes; a longer one is a batch of its own."""
    batch: list[str] = []
    size = 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode())
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


class Library:
    """``ids(texts)`` of a tokenizers ``.json`` or a sentencepiece ``.model`` file, without added ids."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.vocab_size()
            self.specials: list[str] = []
            self._ids: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.size = model.get_vocab_size(with_added_tokens=True)
            self.specials = [t.content for t in model.get_added_tokens_decoder().values()]
            self.tokenizer = model
            self._ids = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def last_tokens(self) -> np.ndarray:
        """Which ids end a word by the tokenizer's own mark; empty if it has none."""
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not mark:
            return np.zeros(0, bool)
        return np.array([(self.tokenizer.id_to_token(i) or "").endswith(mark) for i in range(self.size)])

    def ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [ids for batch in byte_batches(texts) for ids in self._ids(batch)]


class WordEncoder:
    """Encodes texts to the ids of their words.

    A word of plain letters and punctuation has the ids of its lower-case letters, then those of its punctuation, so
    the cache holds such pieces. Letters alone are one word for the tokenizer, which marks its last token:
    many are encoded in one call, and cut apart after these tokens.
    """

    def __init__(self, path: str):
        self.library = Library(path)
        self.by_word = path.endswith(".json") and drops_white_space(path)
        self.known: dict[str, bytes] = {"": b""}
        # An added token within a plain word would have to be plain itself.
        self.plain = self.by_word and not any(re.fullmatch(_PLAIN_CHARACTERS, s) for s in self.library.specials)
        self.last = self.library.last_tokens() if self.plain else np.zeros(0, bool)

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.library.ids(texts)]

    def _pack_letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), WORDS_TOGETHER):
            some = words[i : i + WORDS_TOGETHER]
            ids = np.array(self.library.ids([" ".join(some)])[0], "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._pack(some)
        return out

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each of some distinct pieces."""
        if len(self.known) > CACHE_PIECES:
            self.known = {"": b""}
        known = self.known
        found = list(map(known.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        letters = [p for p in new if p.isalpha() and _LETTERS.fullmatch(p)] if len(self.last) else []
        fresh = dict(zip(letters, self._pack_letters(letters), strict=True))
        rest = [p for p in new if p not in fresh]
        fresh.update(zip(rest, self._pack(rest), strict=True))
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHE_LETTERS)
        return [fresh[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some distinct words has, and the ids, one word's after another."""
        heads, tails = words, pa.array([""], pa.string()).take(pa.array(np.zeros(len(words), "i8")))
        if self.plain:
            cut = pc.extract_regex(words, _PLAIN)
            whole = pc.is_null(cut)
            heads = pc.if_else(whole, words, pc.utf8_lower(pc.struct_field(cut, "letters")))
            tails = pc.if_else(whole, "", pc.struct_field(cut, "marks"))
        pieces = pa.concat_arrays([heads, tails]).dictionary_encode()
        packed = self._ids_of(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), "i8", len(packed)) // 4
        both = pieces.indices.to_numpy().reshape(2, -1).T.reshape(-1)  # each word's letters, then its marks
        return sizes[both].reshape(-1, 2).sum(1), _gather(np.frombuffer(b"".join(packed), "<u4"), sizes, both)

    def word_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's words begin and end in the next array, which has each word's number among the distinct
        words, how many ids each distinct word has, and those ids, one word's after another."""
        if self.by_word:
            offsets, words = split_words(texts)
            coded = words.dictionary_encode()
            return offsets, coded.indices.to_numpy(), *self._words(coded.dictionary)
        packed = self._pack(texts.to_pylist())  # whole texts as words
        return np.arange(len(texts) + 1), np.arange(len(texts)), np.fromiter(map(len, packed), "i8", len(packed)) // 4, np.frombuffer(b"".join(packed), "<u4")

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, none null."""
        offsets, numbers, sizes, _ = self.word_ids(texts)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[numbers])])[offsets])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin and end in the array of all ids, and that array."""
        offsets, numbers, sizes, ids = self.word_ids(texts)
        return np.concatenate([[0], np.cumsum(sizes[numbers])])[offsets], _gather(ids, sizes, numbers)


def _gather(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``values``, whose runs have these sizes, one after another."""
    own = sizes[at]
    starts = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(own) - own)
    return values[np.repeat(starts, own) + np.arange(own.sum())]


_ENCODERS: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """The encoder that this Python worker keeps between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
