"""Repeated windows of byte strings by a Burrows-Wheeler transform (the inner step of operator 12).

``repeated_windows`` writes the strings one after the other and finds common prefixes of neighbouring suffixes by
increasing length: an interval of suffixes that begin with the same string is extended backward by every byte that
precedes it, all intervals of one length at a time; where an extended interval ends, its neighbours part, and if no shorter
string has told so before, they part at just this length. After ``least`` lengths the search stops: neighbours that
nothing has parted share ``least`` bytes or more.
"""

from __future__ import annotations

import numpy as np

#: Strings, with an end each, that one transform takes; keys of two ranks and a place have 63 bits.
MOST = 1 << 21
#: Intervals longer than this are extended by every symbol, shorter ones by those found in them.
LONG = 512
_BITS, _LOW = 21, (1 << 21) - 1


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what stands there, right for ``depth`` symbols at least; ``symbols`` < 512 end with a 0."""
    n = len(symbols)
    place = np.arange(n, dtype=np.int64)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = symbols
    key = padded[:n] << 27 | padded[1 : n + 1] << 18 | padded[2 : n + 2] << 9 | padded[3 : n + 3]
    seen, length = key, 4
    order = np.argsort(seen, kind="stable")
    new = np.empty(n, np.int64)
    while True:
        new[0] = 0
        new[1:] = seen[order[1:]] != seen[order[:-1]]
        groups = np.cumsum(new)
        if length >= depth or groups[-1] == n - 1:
            return order
        rank = np.empty(n + length, np.int64)
        rank[order] = groups
        rank[n:] = 0
        seen = rank[:n] << _BITS | rank[length:]
        order = np.sort(seen << _BITS | place) & _LOW
        length *= 2


def _extended(lb: np.ndarray, rb: np.ndarray, bwt: np.ndarray, lf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of all strings that are one symbol longer at the front; ``at``: symbol and place, sorted."""
    first, last = lf[lb], lf[rb - 1]
    one = (bwt[lb] == bwt[rb - 1]) & (last - first == rb - 1 - lb)  # the same symbol before all of them
    out_l, out_r = [first[one]], [last[one] + 1]
    lb, rb = lb[~one], rb[~one]
    long = rb - lb > LONG
    if long.any():
        symbols = np.unique(bwt).astype(np.int64)
        a = np.searchsorted(at, (symbols[:, None] << _BITS | lb[long]).ravel())
        b = np.searchsorted(at, (symbols[:, None] << _BITS | rb[long]).ravel())
        out_l.append(a[a < b])
        out_r.append(b[a < b])
        lb, rb = lb[~long], rb[~long]
    if len(lb):
        size = rb - lb
        which = np.repeat(np.arange(len(lb)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lb, size)
        key = np.sort((which << 9 | bwt[place]) << _BITS | place)
        edge = np.flatnonzero(key[1:] >> _BITS != key[:-1] >> _BITS) + 1
        out_l.append(lf[key[np.append(0, edge)] & _LOW])
        out_r.append(lf[key[np.append(edge, len(key)) - 1] & _LOW] + 1)
    return np.concatenate(out_l), np.concatenate(out_r)


def parted(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each place of a transform whether the suffix there and the one before share fewer than ``least`` symbols."""
    n = len(bwt)
    at = np.sort(bwt.astype(np.int64) << _BITS | np.arange(n))
    lf = np.empty(n, np.int64)
    lf[at & _LOW] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(lb):
            break
        lb, rb = _extended(lb, rb, bwt, lf, at)
        new = ~known[rb]
        lb, rb = lb[new], rb[new]
        known[rb] = True
    return known[:n]


def repeated_windows(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string where windows of ``least`` bytes begin that begin anywhere else too, in it or another one."""
    sizes = np.array([len(s) for s in strings], np.int64)
    n = int(sizes.sum()) + len(strings) + 1
    if n > MOST:
        raise ValueError(f"{n} symbols are too many for one transform")
    symbols = np.zeros(n, np.int64)
    symbols[:-1] = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols[starts + sizes] = 1
    order = suffix_order(symbols, least + 1)
    common = np.flatnonzero(~parted(symbols[order - 1], least))
    found = np.unique(order[np.concatenate([common, common - 1])])
    owner = np.searchsorted(starts, found, "right") - 1
    inside = found - starts[owner]
    whole = inside + least <= sizes[owner]
    return np.split(inside[whole], np.searchsorted(owner[whole], np.arange(1, len(strings))))
