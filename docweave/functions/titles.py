"""Longest common subsequences of blocks of titles, a block against a block in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Classes of letters that are counted, and titles of one block that are held against the other block at a time.
CLASSES, ROWS = 40, 128


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points from 1 for each text, filled up with 0, and the lengths."""
    sizes = np.array([len(x) for x in texts], np.int64)
    rows = np.zeros((len(texts), int(sizes.max())), np.int64)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    return rows, sizes


def _counts(rows: np.ndarray, levels: int) -> np.ndarray:
    """Each row's letters by class, as ones of 64-bit words: a count of n is n ones of its class's ``levels``, or all of them.
    Two texts' words differ in no more bits than letters must be put in and taken out to make one of the other."""
    row, column = np.nonzero(rows)
    counted = np.bincount(row * CLASSES + rows[row, column] % CLASSES, minlength=len(rows) * CLASSES).reshape(len(rows), CLASSES, 1)
    return np.packbits((counted > np.arange(levels)).reshape(len(rows), -1), axis=1).view(np.uint64)


def _places(rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For each row and symbol the places where it stands, as bits of 64-bit words; the last symbol stands nowhere."""
    words = -(-rows.shape[1] // 64)
    out = np.zeros((len(rows), len(symbols) + 1, words), np.uint64)
    row, column = np.nonzero(rows)
    bit = np.left_shift(np.uint64(1), (column % 64).astype(np.uint64))
    np.bitwise_or.at(out, (row, np.searchsorted(symbols, rows[row, column]), column // 64), bit)
    return out


def _common(letters: np.ndarray, of: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of symbols with the known title at ``of``: its bits are ones at first, and one more
    becomes a zero wherever the subsequence grows by a letter. All pairs take a letter's step at once, words from the lowest on with a carry."""
    state = np.full((len(of), places.shape[2]), ~np.uint64(0))
    for step in range(letters.shape[1]):
        here, carry = places[of, letters[:, step]], np.zeros(len(of), np.uint64)
        for w in range(state.shape[1]):
            met = state[:, w] & here[:, w]
            part = state[:, w] + met
            total = part + carry
            carry = ((part < met) | (total < part)).astype(np.uint64)
            state[:, w] = total | (state[:, w] & ~here[:, w])
    return np.bitwise_count(~state).sum(axis=1).astype(np.int64)


def alike(titles: list[str], known: list[str], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, ratio`` of all pairs of a title and a known one of which the longest common subsequence makes up ``least`` percent, a few titles at a
    time. Pairs whose letters, in any order, or lengths differ too often are not compared further."""
    rows, sizes = _letters(titles)
    known_rows, known_sizes = _letters(known)
    levels = 8 * -(-max(rows.shape[1], known_rows.shape[1]) // 80)
    symbols = np.unique(known_rows[known_rows > 0])
    at = np.searchsorted(symbols, rows)
    letters = np.where(symbols[np.minimum(at, len(symbols) - 1)] == rows, at, len(symbols))
    counts, known_counts, places = _counts(rows, levels), _counts(known_rows, levels).T.copy(), _places(known_rows, symbols)
    for start in range(0, len(titles), ROWS):
        some = counts[start : start + ROWS]
        most = ((sizes[start : start + ROWS, None] + known_sizes) * (100 - least) // 100).astype(np.int32)
        differ = np.zeros(most.shape, np.int32)
        for w in range(some.shape[1]):
            differ += np.bitwise_count(some[:, None, w] ^ known_counts[w])
        i, j = np.nonzero(differ <= most)
        if len(i):
            i += start
            both = sizes[i] + known_sizes[j]
            common = _common(letters[i], j, places)
            good = 200 * common >= least * both
            yield i[good], j[good], 200.0 * common[good] / both[good]
