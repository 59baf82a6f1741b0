"""Recompression of word sequences: rounds that name runs and pairs, as numpy helpers for Arrow batches.

A name is a hash of what it stands for, so all tasks give equal runs and pairs equal names without a dictionary. In each
round maximal runs of one symbol get a name first. Then a hash deals the symbols into left and right ones, and every left
one that a right one follows is joined with it; which pairs are joined depends on the two symbols alone. So equal
substrings get equal symbols except near their ends. How near is tracked: every symbol has a context, the words on which
its being there depends, and a sequence of words that holds the context holds the symbol wherever it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from terrashift.llm.shingles import U, mix

_GOLD, _RUN = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_FAR = 1 << 40


@dataclass(frozen=True)
class ParseSpec:
    """``rounds`` rounds give symbols of six words on average; none is longer than ``longest`` words."""

    window: int = 50
    rounds: int = 7
    longest: int = 24
    #: Words parsed at once; longer texts are parsed in pieces that overlap by two windows.
    piece: int = 1 << 16


@dataclass
class Symbols:
    """Symbols in text order: name, text, first word, number of words, context from ``lo`` up to ``hi``."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(*(getattr(self, f)[at] for f in ("name", "doc", "start", "size", "lo", "hi")))


def _groups(s: Symbols, join: np.ndarray) -> np.ndarray:
    """First symbol of each group, where ``join[i]`` ties symbol i + 1 to symbol i."""
    return np.flatnonzero(np.concatenate([[True], ~join]))


def _runs(s: Symbols, number: int, spec: ParseSpec) -> Symbols:
    same = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1])
    if not same.any():
        return s
    first = _groups(s, same)
    count = np.diff(np.append(first, len(s.name)))
    last = first + count - 1
    # A run is known as one by the symbols on both sides; at a text's end nothing says that it does not go on.
    before, after = first - 1, last + 1
    left = (first > 0) & (s.doc[before] == s.doc[first])
    right = (after < len(s.name)) & (s.doc[np.minimum(after, len(s.name) - 1)] == s.doc[first])
    lo = np.where(left, np.minimum.reduceat(s.lo, first), -_FAR)
    lo = np.where(left, np.minimum(lo, s.lo[before]), lo)
    hi = np.where(right, np.maximum.reduceat(s.hi, first), _FAR)
    hi = np.where(right, np.maximum(hi, s.hi[np.minimum(after, len(s.name) - 1)]), hi)
    several = count > 1
    named = several & (count * s.size[first] <= spec.longest)
    # Symbols of a run that is too long stay, and depend on the whole run.
    owner = np.repeat(np.arange(len(first)), count)
    wide = several[owner]
    out = Symbols(s.name.copy(), s.doc, s.start, s.size.copy(), np.where(wide, lo[owner], s.lo), np.where(wide, hi[owner], s.hi))
    at = first[named]
    out.name[at] = mix(s.name[at] * _RUN + mix(count[named].astype(U) + U(number << 20)))
    out.size[at] = count[named] * s.size[at]
    keep = np.ones(len(s.name), bool)
    keep[named[owner] & (np.arange(len(s.name)) != first[owner])] = False
    return out.take(keep)


def _pairs(s: Symbols, number: int, spec: ParseSpec) -> Symbols:
    right = (mix(s.name + U(number * int(_GOLD) % (1 << 64))) >> U(63)).astype(bool)
    near = s.doc[1:] == s.doc[:-1]
    at = np.flatnonzero(~right[:-1] & right[1:] & near & (s.size[:-1] + s.size[1:] <= spec.longest))
    n = len(s.name)
    joined, gone = np.zeros(n, bool), np.zeros(n, bool)
    joined[at], gone[at + 1] = True, True
    name, size, lo, hi = s.name.copy(), s.size.copy(), s.lo.copy(), s.hi.copy()
    # A symbol that stays single depends on the neighbour that it could have been joined with.
    beside = np.zeros(n, bool)
    beside[:-1] = near
    single = np.flatnonzero(~right & ~joined & beside)
    lo[single], hi[single] = np.minimum(s.lo[single], s.lo[single + 1]), np.maximum(s.hi[single], s.hi[single + 1])
    hi[~right & ~joined & ~beside] = _FAR
    beside[1:], beside[0] = near, False
    single = np.flatnonzero(right & ~gone & beside)
    lo[single], hi[single] = np.minimum(s.lo[single], s.lo[single - 1]), np.maximum(s.hi[single], s.hi[single - 1])
    lo[right & ~gone & ~beside] = -_FAR
    name[at] = mix(s.name[at] * _GOLD + mix(s.name[at + 1] + U(number)))
    size[at] += s.size[at + 1]
    lo[at], hi[at] = np.minimum(s.lo[at], s.lo[at + 1]), np.maximum(s.hi[at], s.hi[at + 1])
    return Symbols(name, s.doc, s.start, size, lo, hi).take(~gone)


def _parse(words: np.ndarray, first: np.ndarray, spec: ParseSpec) -> Symbols:
    n = len(words)
    at = np.arange(n)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = Symbols(mix(words), doc, at, np.ones(n, np.int64), at, at + 1)
    if n:
        for number in range(1, spec.rounds + 1):
            s = _pairs(_runs(s, number, spec), number, spec)
    return s.take((s.hi - s.lo <= spec.window) & (s.lo >= 0))


def anchors(words: np.ndarray, first: np.ndarray, spec: ParseSpec = ParseSpec()) -> Symbols:
    """Symbols of the last round whose context fits into a window. ``start``, ``lo`` and ``hi`` count within each text.

    ``first`` has the first word of each text and the number of all words.
    """
    if len(words) <= spec.piece + 4 * spec.window:
        s = _parse(words, first, spec)
        base = first[:-1][s.doc]
    else:
        assert len(first) == 2, "a long text comes by itself"
        parts = []
        for a in range(0, len(words), spec.piece):
            lo, hi = max(0, a - 2 * spec.window), min(len(words), a + spec.piece + 2 * spec.window)
            # What depends on words beyond the piece has no context in it, so pieces give what the whole text gives.
            p = _parse(words[lo:hi], np.array([0, hi - lo]), spec)
            p = p.take((p.start + lo >= a) & (p.start + lo < a + spec.piece))
            p.start, p.lo, p.hi = p.start + lo, p.lo + lo, p.hi + lo
            parts.append(p)
        s = Symbols(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("name", "doc", "start", "size", "lo", "hi")))
        base = np.zeros(len(s.doc), np.int64)
    s.start, s.lo, s.hi = s.start - base, s.lo - base, s.hi - base
    return s


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the ``width`` words from each of the ascending ``starts`` on."""
    out = np.zeros((2, len(starts)), U)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        end = int(np.searchsorted(starts, a + block))
        part, rel = words[a : a + block + width], starts[at:end] - a
        for k, salt in enumerate((U(0x165667B19E3779F9), U(0x27D4EB2F165667C5))):
            x = mix(part ^ salt)
            up, down = _powers(len(part))
            run = np.zeros(len(part) + 1, U)
            np.cumsum(x * up, out=run[1:])
            out[k, at:end] = mix((run[rel + width] - run[rel]) * down[rel])
        at = end
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from terrashift.llm import shingles

    up, down = shingles._powers()
    return up[:n], down[:n]
