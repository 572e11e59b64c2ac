"""Word shingles of whole texts as 64-bit hashes, vectorised over the text's bytes.

A word is a run of ASCII letters and digits or of bytes beyond ASCII, after the text
was put in lower case; characters beyond ASCII that aren't letters or digits part words only if
they are among the common marks of ``_MARKS``.
"""

from __future__ import annotations

import re

import numpy as np

WORDS, _PIECE = 5, 1 << 20
_MARKS = re.compile("[\u00a0«»¡¿·–—‘’“”„…、。！，？]")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_P = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = np.random.default_rng(12).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**(n-1) and their inverses modulo 2**64 (kept for later texts)."""
    global _up, _down
    if len(_up) < n:
        size = 1 << (n - 1).bit_length()
        p, q = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _up, _down = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _up, _down


def finish(h: np.ndarray) -> np.ndarray:
    """Mix 64-bit values well."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash a word, in order. A long text is taken in pieces that end before a space."""
    if len(text) <= _PIECE:
        return _word_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = text.find(" ", at + _PIECE)
        end = len(text) if end < 0 else end
        parts.append(_word_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _word_hashes(text: str) -> np.ndarray:
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub(" ", low)
    raw = np.frombuffer(low.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return finish((total[ends] - total[starts]) * down[starts])


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """One hash for each place of a shingle; a shorter text is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += w[j : j + n] * _MIX[j]
    return finish(total)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    return np.unique(shingle_hashes(text, words), return_counts=True)
