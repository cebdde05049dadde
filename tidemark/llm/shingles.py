"""Vectorised word shingles and SuperMinHash signatures of blocks of texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, ascending; hash of each word)."""
    parts = [(text or "").encode("utf-8") for text in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # the text ends with a space
    # A polynomial of the bytes, as a difference of prefix sums, moved to the word's start.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    bounds = np.cumsum([len(x) + 1 for x in parts])
    return np.searchsorted(bounds, starts, side="right"), mix(value + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, by document, then hash.

    A text of fewer words than ``width`` has the whole sequence as its one shingle; one without words has none.
    """
    doc, word = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    value, length = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    left = (first[doc] + n[doc] - np.arange(len(word))) if len(word) else np.zeros(0, int)  # words from here to the text's end
    for k in range(width):
        here = left > k
        at = np.flatnonzero(here)
        value[at] = mix(value[at] * _U(0x9DDFEA08EB382D69) + word[at + k])
        length[at] += _U(1)
    begins = (left >= width) | ((n[doc] < width) & (np.arange(len(word)) == first[doc])) if len(word) else np.zeros(0, bool)
    doc, value = doc[begins], mix(value[begins] ^ length[begins])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]


def super_minhash(doc: np.ndarray, value: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_docs x m, uint32: rank in the high 8 bits) of sets given as (document, hash) pairs.

    Each element draws, level by level, one step of its own random permutation of the m places and puts level + r there;
    a document stops as soon as all its places hold values of levels that are done, so large sets need a level or two.
    All elements of the documents that go on take a level together.  Documents without elements keep the largest value.
    """
    if m > 256:
        raise ValueError("at most 256 places")
    out = np.full(n_docs * m, 0xFFFFFFFF, np.uint32)
    swaps: list[np.ndarray] = []
    doc = doc.astype(np.int64)
    for level in range(m):
        if not len(doc):
            break
        draw = mix(value + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = level + (((draw & _U(0xFFFFFFFF)) * _U(m - level)) >> _U(32)).astype(np.int16)
        # Where the permutation stands at place ``swap``: follow the swaps that moved something there, backwards.
        place = swap.copy()
        for before in range(level - 1, -1, -1):
            place = np.where(place == swaps[before], np.int16(before), place)
        swaps.append(swap)
        rank = (np.uint32(level) << np.uint32(24)) | (draw >> _U(40)).astype(np.uint32)
        np.minimum.at(out, doc * m + place, rank)
        full = out.reshape(n_docs, m).max(axis=1) < np.uint32(min((level + 1) << 24, 0xFFFFFFFF))
        goes = ~full[doc]
        if not goes.all():
            doc, value = doc[goes], value[goes]
            swaps = [s[goes] for s in swaps]
    return out.reshape(n_docs, m)
