"""Word shingles of UTF-8 buffers and SuperMinHash signatures, as numpy helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = U(0xD1342543DE82EF95)
#: Bytes worked on at once; temporary arrays and the power tables are some 40 times that.
CHUNK = 1 << 18
_RANK_SHIFT = U(40)
_FRACTION = U((1 << 40) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_ASIS = np.arange(256, dtype=np.uint8)
_LOWER = _ASIS.copy()
_LOWER[65:91] += 32
_CODES = {lower: mix((codes.astype(U) + U(1)) * _GOLD) for lower, codes in ((True, _LOWER), (False, _ASIS))}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as many as a chunk has bytes."""
    if not _POWERS:
        for name, b in (("up", _BASE), ("down", U(pow(int(_BASE), -1, 1 << 64)))):
            p = np.full(CHUNK + 1, b, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _one_word(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of a single word of any length, block by block."""
    up, _ = _powers()
    total = U(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), CHUNK):
            block = data[at : at + CHUNK]
            total += U(pow(int(_BASE), at, 1 << 64)) * (codes[block] * up[: len(block)]).sum(dtype=U)
    return mix(np.array([total], U) + np.array([len(data)], U) * _GOLD)


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (cut at ASCII white space, A-Z lower-cased if so asked) and the first word of each text.

    ``data`` holds the texts' bytes one after the other, at most ``CHUNK`` of them, ``bounds`` the n + 1 offsets. The
    second result has n + 1 entries: text i has the words from entry i up to entry i + 1.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    inner = bounds[1:-1]
    after[inner[(inner > 0) & (inner <= n)] - 1] = False
    stop = np.flatnonzero(solid & ~after) + 1
    up, down = _powers()
    run = np.zeros(n + 1, U)
    np.cumsum(_CODES[lower][data] * up[:n], out=run[1:])
    words = mix((run[stop] - run[start]) * down[start] + (stop - start).astype(U) * _GOLD)
    return words, np.searchsorted(start, bounds)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; with fewer words, of the whole sequence."""
    if not len(words):
        return np.zeros(0, U)
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, U(width), U)
    for i in range(width):
        out = mix(out * _GOLD + words[i : len(words) - width + 1 + i])
    return np.unique(out)


def long_word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """``word_hashes`` of one text of any length, in pieces that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                # A word longer than the piece: on to the next white space.
                while end < len(data) and not len(gaps := np.flatnonzero(_SPACE[data[end : end + CHUNK]])):
                    end = min(end + CHUNK, len(data))
                end = min(end + int(gaps[0]), len(data)) if end < len(data) else end
        piece = data[at:end]
        parts.append(_one_word(piece, _CODES[lower]) if len(piece) > CHUNK else word_hashes(piece, np.array([0, len(piece)]), lower)[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, U)


def word_chunks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes, first word of each text) of consecutive texts, through the Arrow buffer.

    Short texts come ``CHUNK`` bytes at a time, a longer one by itself and hashed in pieces.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1), len(texts))
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo > CHUNK:
            words = long_word_hashes(data[lo:hi], lower)
            yield i, words, np.array([0, len(words)])
        else:
            yield i, *word_hashes(data[lo:hi], offsets[i : j + 1] - lo, lower)
        i = j


def text_words(texts: pa.Array, lower: bool = True) -> Iterator[np.ndarray]:
    """Word hashes of every text in turn."""
    for _, words, first in word_chunks(texts, lower):
        for t in range(len(first) - 1):
            yield words[first[t] : first[t + 1]]


def text_sets(batch_ids: pa.Array, texts: pa.Array, k: int = 5) -> Iterator[tuple[object, np.ndarray]]:
    """(id, shingle set) of every row. A worker holds the batch and, at once, some 60 bytes for each word of one text."""
    for doc_id, words in zip(batch_ids.to_pylist(), text_words(texts)):
        yield doc_id, shingle_set(words, k)


def superminhash(items: np.ndarray, m: int, block: int = 1 << 15) -> np.ndarray:
    """SuperMinHash signature of a set of 64-bit hashes.

    Every element deals its own permutation of the m slots; at step j it offers j plus a random fraction to the j-th
    slot of that permutation, and a slot keeps its smallest offer. Ranks within one element exclude each other, which
    lowers the variance below that of independent hashes. All elements take step j together, and the walk stops at the
    first step that is above every slot's value: later offers cannot win.
    """
    h = np.full(m, np.iinfo(np.uint64).max, U)
    for at in range(0, len(items), block):
        x = items[at : at + block]
        rows = np.arange(len(x))
        deal = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
        for j in range(m):
            if (U(j) << _RANK_SHIFT) > h.max():
                break
            s = mix(x + U((j + 1) * int(_GOLD) % (1 << 64)))
            pick = j + ((s >> U(44)) % U(m - j)).astype(np.int64)
            slot = deal[rows, pick]
            deal[rows, pick] = deal[:, j]
            np.minimum.at(h, slot, (U(j) << _RANK_SHIFT) | (s & _FRACTION))
    return h


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of consecutive slots."""
    rows = signature.reshape(bands, -1)
    out = np.arange(bands, dtype=U)
    for c in range(rows.shape[1]):
        out = mix(out * _GOLD + rows[:, c])
    return out.view(np.int64)
