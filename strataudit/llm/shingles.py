"""Hashed word shingles of whole texts, computed on a portion of texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits, so that each bit of the result depends on all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and the number of words of each text.

    A word is a run of characters other than the space and U+0009 to U+000D; A-Z count as a-z.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    ends_of_texts = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(firsts, lengths)
    terms = _BYTE[data[inside]] * _PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = mixed(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))
    upto = np.searchsorted(starts, ends_of_texts)
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingles of each text; with fewer words the whole sequence is one; else none."""
    hashes, counts = word_hashes(texts)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = max(0, len(hashes) - width + 1)
    rolled = np.zeros(full, dtype=np.uint64)
    for k in range(width):
        rolled += hashes[k:k + full] * factors[k]
    rolled, at, sets = mixed(rolled), 0, []
    for n in counts.tolist():
        if n >= width:
            sets.append(np.unique(rolled[at:at + n - width + 1]))
        elif n:
            sets.append(mixed(np.array([(hashes[at:at + n] * factors[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            sets.append(rolled[:0])
        at += n
    return sets
