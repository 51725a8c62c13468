"""Vectorised hashes of words and word shingles."""

from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 16), _MULT, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the words before each text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased;
    the hash is a polynomial in the word's bytes, read off from the right.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), first
    sizes = end - begin
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    place = where - np.repeat(begin, sizes)  # byte j of a word weighs M**j
    terms = (_LOWER[data[where]].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place]
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return mixed(sums), first


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles, the text of each, and every text's number of words.

    A text of fewer words than ``k`` has one shingle, of all it has; one
    without words has none.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    total = int(shingles.sum())
    owner = np.repeat(np.arange(len(texts)), shingles)
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(total)
    h = np.zeros(total, np.uint64)
    last = first[1:][owner]
    for j in range(k if total else 0):
        at = start + j
        h = np.where(at < last, mixed(h * _MULT + words[np.minimum(at, len(words) - 1)]), h)
    return h, owner, counts
