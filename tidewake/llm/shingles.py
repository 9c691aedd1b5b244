"""Sets of word shingles as sorted arrays of 64-bit hashes, computed over whole blocks of texts.

Words are maximal runs of bytes that aren't ASCII white space, A-Z lower-cased. A text's
set holds the hash of every ``width`` consecutive words; a shorter text has its whole word
sequence as the one shingle; a text without words has the empty set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidewake.llm.common import mix64

WIDTH = 5
#: Texts are hashed in blocks of about so many bytes.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E6C63D0876A3F35)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """White-space flags and a random word for each byte."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return space, mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a block."""
    space, chars = _tables()
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    gap = space[b]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(max(len(b), BLOCK) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(chars[b] * power[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return start, mix64(h ^ (end - start).astype(np.uint64))


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    m = len(words) - width + 1
    h = np.full(m, width, np.uint64)
    for i in range(width):
        h = h * _FOLD + words[i : i + m]
    return mix64(h)


def _blocks(texts: list[bytes]) -> list[list[int]]:
    out, size = [[]], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(t) + 1
    return out


def long_words(text: bytes) -> np.ndarray:
    """Word hashes of a text beyond a block, cut at white space."""
    parts, at = [], 0
    while at < len(text):
        to = at + BLOCK
        while to < len(text) and text[to] not in b"\t\n\v\f\r ":
            to += 1
        parts.append(word_hashes(text[at:to])[1])
        at = to
    return np.concatenate(parts)


def _set(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(fold(words, min(width, len(words))))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for block in _blocks(texts):
        if not block:
            continue
        if len(block) == 1 and len(texts[block[0]]) > BLOCK:
            out[block[0]] = _set(long_words(texts[block[0]]), width)
            continue
        start, words = word_hashes(b" ".join(texts[i] for i in block))
        ends = np.cumsum([len(texts[i]) + 1 for i in block])
        bounds = np.searchsorted(start, ends)
        lo = 0
        for i, hi in zip(block, bounds):
            out[i] = _set(words[lo:hi], width)
            lo = hi
    return out


def set_fingerprint(s: np.ndarray) -> int:
    """64 bits that identify a set."""
    if not len(s):
        return 0
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0])
