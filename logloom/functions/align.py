"""Matching blocks of pairs of byte strings, as ``difflib`` finds them, for many pairs at once.

The longest match of a window (of the leftmost ones in the first string, the leftmost in the
second) is a block; the windows before and after it are searched alike. Matches are found from
equal grams, long ones first, so that what is left for short grams are small windows. All
windows of a batch take a step together.
"""

from __future__ import annotations

import numpy as np

GRAMS = (16, 8)
#: Pairs of equal grams that are held at once; a single window with more is searched by length.
MOST_PAIRS = 4_000_000


class _Text:
    """Bytes with the codes of their grams: of eight bytes, exact; of sixteen, two of them."""

    def __init__(self, data: np.ndarray):
        self.data = data
        x = np.concatenate([data, np.zeros(24, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            x = x[:-k] | x[k:] << np.uint64(8 * k)
        self.eight = x

    def codes(self, at: np.ndarray, gram: int) -> list[np.ndarray]:
        if gram == 16:
            return [self.eight[at], self.eight[at + 8]]
        return [self.eight[at] & np.uint64((1 << 8 * gram) - 1)]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of the ranges, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _keys(codes: list[np.ndarray], window: np.ndarray) -> np.ndarray:
    """Window, 32 bits of the gram's hash, and room for the byte before."""
    h = codes[0] * np.uint64(0x9E3779B97F4A7C15)
    if len(codes) > 1:
        h = h + codes[1] * np.uint64(0xC2B2AE3D27D4EB4F)
    return window.astype(np.uint64) << np.uint64(41) | h >> np.uint64(32) << np.uint64(9)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, size) of the longest match of two strings, by size, in memory of their length."""
    both = np.concatenate([a, b]).astype(np.int64)
    n, ranks = len(a), [np.unique(both, return_inverse=True)[1]]

    def found(size: int) -> tuple[int, int] | None:
        k = size.bit_length() - 1
        while len(ranks) <= k:
            half = 1 << len(ranks) - 1
            ranks.append(np.unique(ranks[-1][:-half] * (1 << 32) + ranks[-1][half:], return_inverse=True)[1])
        r, over = ranks[k], size - (1 << k)
        keys = r[: len(r) - over] * (1 << 32) + r[over:]
        own, other = keys[: n - size + 1], keys[n : len(both) - size + 1]
        at = np.flatnonzero(np.isin(own, other))
        return (int(at[0]), int(np.flatnonzero(other == own[at[0]])[0])) if len(at) else None

    low, high, best = 0, min(n, len(b)), (0, 0)
    while low < high:
        size = (low + high + 1) // 2
        got = found(size)
        low, high, best = (size, high, got) if got else (low, size - 1, best)
    return *best, low


def _reach(a: _Text, b: _Text, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes agree from each place in a and in b on, ``most`` at most."""
    k, on = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(on):
        x = a.eight[i[on] + k[on]] ^ b.eight[j[on] + k[on]]
        low = np.log2((x & (~x + np.uint64(1))).astype(np.float64), where=x != 0, out=np.full(len(on), 64.0))  # the lowest bit that differs
        k[on] += (low / 8).astype(np.int64)
        on = on[(x == 0) & (k[on] < most[on])]
    return np.minimum(k, most)


def _runs(a: _Text, b: _Text, w: np.ndarray, gram: int) -> tuple | None:
    """(window, start in a, start in b, size) of all matches of ``gram`` bytes or more in the windows
    ``w`` (rows of a's start and end, b's start and end); None if there are too many equal grams.

    A match begins where the bytes before differ, so b's grams are sorted with the byte before
    them and those with a's own are passed over.
    """
    na, nb = (np.maximum(hi - lo - gram + 1, 0) for lo, hi in ((w[0], w[1]), (w[2], w[3])))
    na, nb = np.where(nb > 0, na, 0), np.where(na > 0, nb, 0)
    pa, pb = _ranges(w[0], na), _ranges(w[2], nb)
    if not len(pa):
        return (np.empty(0, np.int64),) * 4
    wa, wb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ka, kb = _keys(a.codes(pa, gram), wa), _keys(b.codes(pb, gram), wb)
    before = lambda text, at, edge: np.where(at == edge, np.uint64(256), text.data[at - 1].astype(np.uint64))
    kb |= before(b, pb, w[2][wb])
    order = np.argsort(kb, kind="stable")
    kb, pb = kb[order], pb[order]
    bare = kb >> np.uint64(9)
    first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
    heads, last = bare[first], np.append(first[1:], len(kb))
    at = np.minimum(np.searchsorted(heads, ka >> np.uint64(9)), len(heads) - 1)
    met = np.flatnonzero(heads[at] == ka >> np.uint64(9))
    x, i, at, key = wa[met], pa[met], at[met], ka[met]
    lo, hi = first[at], last[at]
    own = before(a, i, w[0][x])
    s = np.searchsorted(kb, key | own)
    new = np.flatnonzero(np.concatenate([[True], kb[1:] != kb[:-1]]))  # stretches of equal keys, with the byte before
    stretch = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(kb))))
    at = np.minimum(s, len(kb) - 1)
    e = np.where(kb[at] == (key | own), np.append(new[1:], len(kb))[stretch[at]], s)
    edge = own == 256  # at the window's edge a match begins whatever is before
    s, e = np.where(edge, hi, s), np.where(edge, hi, e)
    count = np.concatenate([s - lo, hi - e])
    if count.sum() > MOST_PAIRS:
        return None
    j = pb[_ranges(np.concatenate([lo, e]), count)]
    x, i = np.repeat(np.concatenate([x, x]), count), np.repeat(np.concatenate([i, i]), count)
    k = _reach(a, b, i, j, np.minimum(w[1][x] - i, w[3][x] - j))
    full = k >= gram
    return x[full], i[full], j[full], k[full]


def _split(w: np.ndarray, runs: tuple, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, windows left) of windows and all their matches of ``gram`` bytes or more."""
    blocks, rest = [], []
    x, i, j, k = runs
    while True:
        busy = np.zeros(w.shape[1], bool)
        busy[x] = True
        rest.append(w[:, ~busy])
        if not len(x):
            return np.concatenate(blocks, axis=1) if blocks else np.empty((3, 0), np.int64), np.concatenate(rest, axis=1)
        number = np.cumsum(busy) - 1
        x, w = number[x], w[:, busy]
        order = np.lexsort((j, i, -k, x))
        top = order[np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))]
        bi, bj, bk = i[top], j[top], k[top]
        blocks.append(np.stack([bi, bj, bk]))
        before = np.minimum(k, np.minimum(bi[x] - i, bj[x] - j))
        skip = np.maximum(0, np.maximum(bi[x] + bk[x] - i, bj[x] + bk[x] - j))
        l, r = np.flatnonzero(before >= gram), np.flatnonzero(k - skip >= gram)
        n = w.shape[1]
        w = np.concatenate([np.stack([w[0], bi, w[2], bj]), np.stack([bi + bk, w[1], bj + bk, w[3]])], axis=1)
        x, i, j, k = (np.concatenate(p) for p in ((x[l], x[r] + n), (i[l], i[r] + skip[r]), (j[l], j[r] + skip[r]), (before[l], k[r] - skip[r])))
        wide = (w[1] - w[0] >= least) & (w[3] - w[2] >= least)  # a window with a run is
        x, w = (np.cumsum(wide) - 1)[x], w[:, wide]


def blocks(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, least: int = 3) -> np.ndarray:
    """Rows of starts in a, starts in b and sizes, by place in a: the matching blocks of ``least`` bytes
    or more of each pair. ``a`` and ``b`` are the pairs' bytes one after another, up to their ends.

    Blocks of fewer bytes don't bear on these: a window without a match of ``least`` bytes is done.
    """
    short = max(1, min(least, 8))
    one, two = _Text(a), _Text(b)
    w = np.stack([np.concatenate([[0], ends_a[:-1]]), ends_a, np.concatenate([[0], ends_b[:-1]]), ends_b]).astype(np.int64) if len(ends_a) else np.empty((4, 0), np.int64)
    w, made = w[:, (w[1] - w[0] >= short) & (w[3] - w[2] >= short)], []
    for gram in (*[g for g in GRAMS if g > short], short):
        waiting, left = [w], []
        while waiting:
            w = waiting.pop()
            runs = _runs(one, two, w, gram)
            if runs is not None:
                found, rest = _split(w, runs, gram, short)
                left.append(rest)
            elif w.shape[1] > 1:
                waiting += [w[:, : w.shape[1] // 2], w[:, w.shape[1] // 2 :]]
                continue
            else:
                (i0, i1, j0, j1), (i, j, k) = w[:, 0], _longest(a[w[0, 0] : w[1, 0]], b[w[2, 0] : w[3, 0]])
                found = np.array([[i0 + i], [j0 + j], [k]])
                more = np.array([[i0, i0 + i + k], [i0 + i, i1], [j0, j0 + j + k], [j0 + j, j1]])
                waiting.append(more[:, (more[1] - more[0] >= short) & (more[3] - more[2] >= short)])
            made.append(found)
        w = np.concatenate(left, axis=1) if left else np.empty((4, 0), np.int64)
    out = np.concatenate(made, axis=1) if made else np.empty((3, 0), np.int64)
    out = out[:, out[2] >= least]
    return out[:, np.argsort(out[0], kind="stable")]
