"""Hashes of the words of a text and of their runs, computed on whole arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BYTES = np.random.default_rng(20_001).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)

#: Bytes that part words: blank and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and digits; bytes of other letters belong to words.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _BYTES[_LOWER]

_SEGMENT = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _MULTIPLIER, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(data: bytes, gaps: np.ndarray = SPACES) -> np.ndarray:
    """A 64-bit hash of every word of a text in UTF-8, A to Z taken as a to z.

    Words are what lies between bytes marked in ``gaps``. Long texts are worked on in
    segments cut at a gap, so that the arrays stay small.
    """
    return placed_words(data, gaps)[0]


def placed_words(data: bytes, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a text, and where they begin."""
    found, begun, at = [], [], 0
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < len(whole):
        end = min(len(whole), at + _SEGMENT)
        while end < len(whole) and not gaps[whole[end]]:
            end += 1
        part = whole[at:end]
        inside = ~gaps[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(part) and inside[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.concatenate((edge, [len(part)]))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            sizes = ends - starts
            # Positions of the bytes of words, and each byte's place in its word.
            before = np.cumsum(sizes) - sizes
            letters = part[inside]
            place = np.arange(len(letters)) - np.repeat(before, sizes)
            values = _LOWER_BYTES[letters] * _power(int(sizes.max()) + 1)[place]
            found.append(mixed(np.add.reduceat(values, before) + sizes.astype(np.uint64)))
            begun.append(starts + at)
        at = end
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(begun)


def words_of_many(
    texts: Iterable[bytes], gaps: np.ndarray = SPACES, limit: int = 4 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes of some texts in a row, and where the words of each begin (and the last end).

    Texts are taken together until they have ``limit`` bytes, so that short ones cost little
    and no more than one long one is held.
    """
    held, size = [], 0

    def done():
        words, starts = placed_words(b" ".join(held), gaps)
        ends = np.cumsum([0] + [len(t) + 1 for t in held])
        return words, np.searchsorted(starts, ends)

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        total = total * _MULTIPLIER + words[i:i + count]
    return mixed(total)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted set of hashes of ``n``-word shingles; of a shorter text, that of the whole text."""
    return next(shingle_sets([text], n))


def shingle_sets(texts: Iterable[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    for words, ends in words_of_many((t or "").encode("utf-8") for t in texts):
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = words[start:end]
            yield np.unique(run_hashes(own, min(n, len(own)))) if len(own) else own
