"""Word shingles and MinHash signatures of many texts at once, in vectorised numpy.

Words are maximal runs of bytes other than ASCII white space. A word's hash is a polynomial over a
random table of its bytes, modulo 2**64, taken from running sums over the whole batch and scrambled;
a shingle's hash mixes the hashes of its words by place. A text of fewer words than a shingle has
its whole word sequence as its one shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed together, unless one text is longer.
BATCH = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BATCH + BATCH // 2), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def batches(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts of about ``BATCH`` bytes together."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH:
            yield slice(start, i)
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


def shingle_hashes(texts: list[bytes], k: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, text after text (repeats included), and how many each text has."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    counts = np.zeros(len(texts), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[data] * _powers(_BASE, n), out=running[1:])
    words = mix64((running[ends] - running[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    of = np.searchsorted(begins, starts, "right") - 1
    n_words = np.bincount(of, minlength=len(texts))
    place = _powers(0x9E3779B97F4A7C15 | 1, k)
    whole = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)
    mixed = np.zeros(len(whole), np.uint64)
    for j in range(k):
        mixed += words[whole + j] * place[j]
    mixed = mix64(mixed)
    counts = np.maximum(n_words - k + 1, 0)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(n_words)))
        extra = np.array([np.sum(words[first[t] : first[t + 1]] * place[: n_words[t]], dtype=np.uint64) for t in short], np.uint64)
        extra = mix64(extra ^ mix64(n_words[short].astype(np.uint64)))
        counts[short] = 1
        at = np.argsort(np.concatenate((of[whole], short)), kind="stable")
        mixed = np.concatenate((mixed, extra))[at]
    return mixed, counts


class MinHash:
    """``n`` universal hash permutations x -> a x + b modulo 2**32 (a odd) of scrambled shingle hashes."""

    #: What a signature holds where a text has no shingles.
    EMPTY = np.uint32(0xFFFFFFFF)

    def __init__(self, n: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def signatures(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of ``n`` minima for each text; ``hashes`` lie text after text."""
        out = np.full((len(counts), len(self.a)), self.EMPTY, np.uint32)
        have = np.flatnonzero(counts)
        if not len(have):
            return out
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        begins = (np.cumsum(counts) - counts)[have]
        held = np.empty_like(x)
        minima = np.empty((len(self.a), len(have)), np.uint32)
        for i in range(len(self.a)):
            np.multiply(x, self.a[i], out=held)
            held += self.b[i]
            minima[i] = np.minimum.reduceat(held, begins)
        out[have] = minima.T
        return out
