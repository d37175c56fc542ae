"""Suffix arrays by induced sorting, in numpy.

Suffixes are classed S or L by their first difference; leftmost-smaller (LMS) substrings are sorted and named;
where names repeat, the string of names is sorted by the same method, recursively; the whole array is then
induced from the LMS suffixes in order. Bytes are induced a bucket at a time, each in a few array steps; names,
a third of the length at most and of a large alphabet, one by one. All of it is linear.
"""

from __future__ import annotations

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the end counts as smallest."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    back = step[::-1]
    at = np.maximum.accumulate(np.where(back != 0, np.arange(n), -1))
    return (back[at] > 0)[::-1]


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes from the LMS suffixes ``lms``, given in order."""
    heads = np.zeros(sigma + 1, np.int64)
    np.cumsum(sizes, out=heads[1:])
    sa = np.full(len(t), -1, np.int64)
    in_bucket = np.searchsorted(t[lms], np.arange(sigma + 1))  # lms is sorted by its first symbol
    top = heads[:-1].copy()

    def place_l(src: np.ndarray) -> None:
        p = src - 1
        p = p[(src > 0)]
        p = p[~is_s[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        c, p = c[order], p[order]
        kinds, first, counts = np.unique(c, return_index=True, return_counts=True)
        sa[np.repeat(top[kinds] - first, counts) + np.arange(len(c))] = p
        top[kinds] += counts

    place_l(np.array([len(t)]))  # the empty suffix comes first
    for c in np.flatnonzero(sizes):
        done = heads[c]
        while done < top[c]:
            upto = top[c]
            place_l(sa[done:upto])
            done = upto
        place_l(lms[in_bucket[c] : in_bucket[c + 1]])
    low = heads[1:].copy()  # S suffixes fill buckets from the end

    def place_s(src: np.ndarray) -> None:
        """src: from the largest suffix to the smallest."""
        p = src - 1
        p = p[src > 0]
        p = p[is_s[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        c, p = c[order], p[order]
        kinds, first, counts = np.unique(c, return_index=True, return_counts=True)
        sa[np.repeat(low[kinds] - 1 + first, counts) - np.arange(len(c))] = p
        low[kinds] -= counts

    for c in np.flatnonzero(sizes)[::-1]:
        done = heads[c + 1]
        while done > low[c]:
            downto = low[c]
            place_s(sa[downto:done][::-1])
            done = downto
        place_s(sa[heads[c] : top[c]][::-1])
    return sa


class _Names:
    """A string of names of a large alphabet, induced one by one.

    The symbol before each place is looked up by place, -1 where the suffix there is of the other class or none;
    the last entry serves the places of the array that are empty as yet.
    """

    def __init__(self, names: np.ndarray, sigma: int, is_s: np.ndarray):
        self.n, self.last = len(names), int(names[-1])
        before = np.full((2, self.n + 1), -1)
        before[0, 1:-1] = np.where(is_s[:-1], -1, names[:-1])
        before[1, 1:-1] = np.where(is_s[:-1], names[:-1], -1)
        self.before_l, self.before_s = before.tolist()
        self.ends = np.cumsum(np.bincount(names, minlength=sigma))
        self.names = names

    def induce(self, lms: np.ndarray) -> np.ndarray:
        sa = np.full(self.n, -1)
        c = self.names[lms]  # ascending: each goes to its place from the end of its bucket
        sa[self.ends[c] - np.searchsorted(c, c, "right") + np.arange(len(c))] = lms
        sa = sa.tolist()
        top = np.append(0, self.ends[:-1]).tolist()
        sa[top[self.last]] = self.n - 1  # the empty suffix comes first, and before it stands this one
        top[self.last] += 1
        before = self.before_l
        for x in sa:  # goes on into what is put in behind it
            c = before[x]
            if c >= 0:
                k = top[c]
                sa[k] = x - 1
                top[c] = k + 1
        low = self.ends.tolist()
        before = self.before_s
        for x in reversed(sa):
            c = before[x]
            if c >= 0:
                k = low[c] - 1
                sa[k] = x - 1
                low[c] = k
        return np.fromiter(sa, np.int64, self.n)


def _sorted_names(names: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of a string of names from 0 to sigma - 1, each of which occurs."""
    n = len(names)
    if sigma == n:
        out = np.empty(n, np.int64)
        out[names] = np.arange(n)
        return out
    is_s = suffix_types(names)
    own = _Names(names, sigma, is_s)
    start = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(start) > 1:
        start = _ranked(names, start, own.induce(start[np.argsort(names[start], kind="stable")]))
    return own.induce(start)


def _ranked(t: np.ndarray, start: np.ndarray, rough: np.ndarray) -> np.ndarray:
    """The LMS suffixes in order, from an array in which the LMS substrings are."""
    is_lms = np.zeros(len(t), bool)
    is_lms[start] = True
    names = _name(t, start, rough[is_lms[rough]], len(t))
    return start[_sorted_names(names, int(names.max()) + 1)]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (uint8) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    sizes = np.bincount(t, minlength=256)
    is_s = suffix_types(t)
    start = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(start) > 1:
        rough = _induce(t, is_s, start[np.argsort(t[start], kind="stable")], 256, sizes)
        start = _ranked(t, start, rough)
    return _induce(t, is_s, start, 256, sizes)


def _name(t: np.ndarray, start: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Names of the LMS substrings, by text order; equal substrings have equal names."""
    till = np.append(start[1:] + 1, n + 1)  # the next LMS symbol included; the last one ends with the sentinel
    length = np.zeros(n, np.int64)
    length[start] = till - start
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    same &= (a + length[a] <= n) & (b + length[b] <= n)
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[a[live]] > k]
        live_same = t[a[live] + k] == t[b[live] + k] if len(live) else np.zeros(0, bool)
        same[live[~live_same]] = False
        live = live[live_same]
        k += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.zeros(n, np.int64)
    out[order] = name
    return out[start]


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place p, how far suffix p agrees with the one before it in the array, at most ``most``.

    Where the symbols before both agree, the value is one less than that of p-1 (if that was not cut at
    ``most``); only the others are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    p = np.arange(n)
    inner = (before > 0) & (p > 0)
    derived = np.zeros(n, bool)
    derived[inner] = t[p[inner] - 1] == t[before[inner] - 1]
    derived[1:] &= before[1:] == before[:-1] + 1
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = t
    eight = np.zeros(n + 8, np.uint64)
    for i in range(8):
        eight |= padded[i : i + n + 8].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero((before >= 0) & ~derived)
    most_of = lambda x, y: np.minimum(np.minimum(n - x, n - y), most + n)
    live, k = todo, 0
    # the start of a chain is compared over most + its length, so that derived values down the chain hold
    chain = np.maximum.accumulate(np.where(~derived, p, -1))
    reach = np.bincount(chain, minlength=n)  # places that each start answers for
    cap = np.minimum(most_of(p, before), most + reach - 1)
    while len(live):
        x = eight[live + k] ^ eight[before[live] + k]
        low = x & (~x + np.uint64(1))
        bits = np.where(x == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
        got = bits // 8
        out[live] = k + got
        k += 8
        live = live[(got == 8) & (cap[live] > k)]
    out = np.minimum(out, np.maximum(cap, 0))
    value = out[chain] - (p - chain)
    return np.clip(np.where(before >= 0, value, 0), 0, most)
