"""Sets of word shingles as 64-bit numbers, made with array arithmetic over a text's bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n + 1:
        size = max(n + 1, 2 * len(_powers))
        _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _R)]).cumprod(dtype=np.uint64)
        _inverses = np.concatenate([[np.uint64(1)], np.full(size - 1, _R_INVERSE)]).cumprod(dtype=np.uint64)


def _words_of(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[a]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    _tables(len(a))
    sums = np.concatenate([[np.uint64(0)], ((a.astype(np.uint64) + np.uint64(1)) * _powers[: len(a)]).cumsum(dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A number per run of bytes other than ASCII white space, in text order. Long texts go by blocks cut at white space."""
    if len(data) <= BLOCK:
        return _words_of(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        parts.append(_words_of(data[at:stop]))
        at = stop
    return np.concatenate(parts)


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of all stretches of `words` words; a text of fewer has one, of all its words; none: empty."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total + w[i : len(w) - n + 1 + i])
    return np.unique(total)
