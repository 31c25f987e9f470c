"""Word shingles as 64-bit integers, computed for whole Arrow batches at once.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased first.
A document's shingles are its distinct runs of ``k`` words; a document of 1 to ``k - 1`` words
has one shingle, its whole word sequence; a document without words (or a null text) has none.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the concatenated documents and the number of the document it is in.

    ``raw`` holds the documents' bytes one after the other; document i is raw[bounds[i]:bounds[i+1]].
    """
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[bounds] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * _power(_BASE, len(raw)), out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64)), np.searchsorted(bounds, starts, side="right") - 1


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of every text."""
    out: list[np.ndarray] = []
    at, room = 0, 1 << 18
    while at < len(texts):  # blocks of a quarter megabyte, which stay in cache, or one longer text
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") <= room):
            size += len(texts[to] or b"")
            to += 1
        out += _block([t or b"" for t in texts[at:to]], k)
        at = to
    return out


def _block(texts: list[bytes], k: int) -> list[np.ndarray]:
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    none = np.zeros(0, dtype=np.uint64)
    if not bounds[-1]:
        return [none] * len(texts)
    words, doc = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    many = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(many)))
    runs = none
    if len(words) >= k:
        runs = words[: len(words) - k + 1] * _PLACE[0]
        for i in range(1, k):
            runs = runs + words[i : len(words) - k + 1 + i] * _PLACE[i]
        runs = mix(runs)
    out = []
    for i, n in enumerate(many):
        a = first[i]
        if n >= k:
            out.append(np.unique(runs[a : a + n - k + 1]))
        elif n:
            own = np.add.reduce(words[a : a + n] * _PLACE[:n], keepdims=True)
            out.append(mix(own + _PLACE[k + n : k + n + 1]))
        else:
            out.append(none)
    return out
