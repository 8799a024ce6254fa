"""Suffix arrays by recursive induced sorting (Nong, Zhang and Chan 2009), with scans done in array operations."""

from __future__ import annotations

from heapq import heappop, heapreplace

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type).  t ends with a sentinel that is smaller than all else."""
    n = len(t)
    s = np.empty(n, bool)
    s[n - 1] = True
    rising = t[:-1] < t[1:]
    equal = t[:-1] == t[1:]
    # A run of equal symbols has the type of its last one.
    last = np.where(equal, n - 1, np.arange(n - 1))
    last = np.minimum.accumulate(last[::-1])[::-1]
    s[:-1] = np.where(last < n - 1, rising[np.minimum(last, n - 2)], True)
    return s


def deal(lists: list[list[np.ndarray]], t: np.ndarray, p: np.ndarray) -> None:
    """Appends positions to the lists of their symbols, in order."""
    if not len(p):
        return
    keys = t[p]
    order = np.argsort(keys, kind="stable")
    p, keys = p[order], keys[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    for k, part in zip(keys[starts].tolist(), np.split(p, cuts), strict=True):
        lists[k].append(part)


def induce(t: np.ndarray, s: np.ndarray, sigma: int, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that an order of the leftmost S-type ones (seeds) brings about.

    A scan of a bucket from left to right places the L-type suffixes before its entries; entries that land in the bucket
    itself are scanned in turn, so each wave of them is one array operation.  Then the same from right to left for
    S-type suffixes.
    """
    seed_lists: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    large: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    small: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    deal(seed_lists, t, seeds)
    none = np.zeros(0, seeds.dtype)
    for c in range(sigma):
        wave = np.concatenate(large[c]) if large[c] else none
        waves, later = [wave], []
        while len(wave):
            p = wave[wave > 0] - 1
            p = p[~s[p]]
            here = t[p] == c
            later.append(p[~here])
            wave = p[here]
            waves.append(wave)
        large[c] = waves
        if seed_lists[c]:
            p = np.concatenate(seed_lists[c])
            later.append(p[p > 0] - 1)
        if later:
            deal(large, t, np.concatenate(later))
    for c in range(sigma - 1, -1, -1):
        large[c] = [np.concatenate(large[c])] if large[c] else []
        wave = np.concatenate(small[c]) if small[c] else none
        waves, later = [wave], []
        while len(wave):
            p = wave[wave > 0] - 1
            p = p[s[p]]
            here = t[p] == c
            later.append(p[~here])
            wave = p[here]
            waves.append(wave)
        small[c] = [np.concatenate(waves)[::-1]]
        if large[c]:
            p = large[c][0][::-1]
            p = p[p > 0] - 1
            later.append(p[s[p]])
        if later:
            deal(small, t, np.concatenate(later))
    # The sentinel is the only suffix that nothing induces.
    small[int(t[-1])] = [np.array([len(t) - 1], seeds.dtype)]
    return np.concatenate([x for c in range(sigma) for x in (*large[c], *small[c])])


def in_turn(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the symbols in it, starts of their runs, and ranks within these."""
    packed = np.sort(symbols.astype(np.int64) << 32 | np.arange(len(symbols)))
    by, symbols = packed & 0xFFFFFFFF, packed >> 32
    first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    return by, symbols, first, np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))


def scan(order: np.ndarray, t: np.ndarray, wanted: np.ndarray, free: np.ndarray, width: int) -> None:
    """Scans the order in blocks from left to right: the wanted positions before its entries go to the next free places of their
    symbols, which are further right.

    What goes to symbols that have free places in the block itself is done one by one, in turn with the entries that arise from it;
    it is little as long as a block is a small part of the order.  The block's other entries are done at once.
    """
    n = len(t)
    for done in range(0, n, width):
        limit = min(done + width, n)
        near = int(np.searchsorted(free, limit))  # symbols below have free places in the block, or are full
        p = order[done:limit]
        at = np.flatnonzero(p > 0)
        q = p[at] - 1
        some = wanted[q]
        at, q = at[some], q[some]
        some = t[q] < near
        if some.any():
            queue = list(zip((at[some] + done).tolist(), q[some].tolist(), strict=True))  # sorted, and so a heap
            while queue:
                _, i = queue[0]
                symbol = t[i]
                place = int(free[symbol])
                free[symbol] = place + 1
                order[place] = i
                if place < limit and i and wanted[i - 1] and t[i - 1] < near:
                    heapreplace(queue, (place, i - 1))
                else:
                    heappop(queue)
            p = order[done:limit]
            q = p[p > 0] - 1
            q = q[wanted[q]]
            q = q[t[q] >= near]
        if len(q):
            by, symbols, first, rank = in_turn(t[q])
            order[free[symbols] + rank] = q[by]
            free[symbols[first]] += np.diff(np.append(first, len(by)))


def induce_ranges(t: np.ndarray, s: np.ndarray, sigma: int, seeds: np.ndarray, width: int = 1 << 12) -> np.ndarray:
    """``induce`` for strings of many symbols, whose buckets are small: blocks of the suffix array are scanned at once."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    order = np.full(n, -1, np.int32)
    by, symbols, _, rank = in_turn(t[seeds])
    places = ends[symbols] - np.bincount(symbols, minlength=sigma)[symbols] + rank
    order[places] = seeds[by]
    scan(order, t, ~s, np.append(0, ends[:-1]), width)
    order[places] = -1  # seeds are induced anew, but for the sentinel
    order[0] = n - 1
    scan(order[::-1], sigma - 1 - t, s, n - ends[::-1], width)  # from right to left is from left to right in the mirror
    return order


def suffix_array(t: np.ndarray, sigma: int, bytewise: bool = True) -> np.ndarray:
    """The order of the suffixes of t, which ends with a sentinel 0 that is nowhere else.

    Leftmost S-type substrings are sorted by inducing, named in their order, and the string of their names is sorted the same way
    (by ranges, as it has many symbols) until all names differ; then the order of all suffixes is induced.
    """
    if len(t) == 1:
        return np.zeros(1, np.int32)
    by = induce if bytewise else induce_ranges
    s = classify(t)
    seeds = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)  # leftmost S-type positions
    order = by(t, s, sigma, seeds)
    is_seed = np.zeros(len(t), bool)
    is_seed[seeds] = True
    ranked = order[is_seed[order]]  # their substrings, up to the next one, are in order now
    ends = np.empty(len(t), np.int32)
    ends[seeds] = np.append(seeds[1:], len(t) - 1)
    a, b = ranked[:-1], ranked[1:]
    same = ends[a] - a == ends[b] - b
    length = np.where(same, ends[a] - a, -1)
    alive = np.flatnonzero(same)
    d = 0
    while len(alive):
        alive = alive[length[alive] >= d]
        equal = t[a[alive] + d] == t[b[alive] + d]
        same[alive[~equal]] = False
        alive = alive[equal]
        d += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] < len(seeds) - 1:
        name_of = np.empty(len(t), np.int32)
        name_of[ranked] = names
        # The sentinel's name is the smallest and unique, so the reduced string is such a string again.
        ranked = seeds[suffix_array(name_of[seeds], int(names[-1]) + 1, bytewise=False)]
    return by(t, s, sigma, ranked)


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For the positions of some stretches of t: the common prefix with the suffix before it in the order, up to ``most`` symbols.

    In text order a common prefix is at most one symbol shorter than that of the position before (Kasai et al. 2001), so each
    stretch is walked with what is already known; all stretches are walked at once.
    """
    out = np.zeros(len(t), np.int16)
    before = np.full(len(t), -1, np.int32)
    before[order[1:]] = order[:-1]
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by].astype(np.int64), sizes[by]
    common = np.zeros(len(starts), np.int64)
    for k in range(int(sizes.max(initial=0))):
        m = int(np.searchsorted(-sizes, -k, "left"))  # stretches that have a position k
        p, length = starts[:m] + k, np.maximum(common[:m] - 1, 0)
        f = before[p].astype(np.int64)
        alive = np.flatnonzero((f >= 0) & (length < most))
        while len(alive):
            alive = alive[t[p[alive] + length[alive]] == t[f[alive] + length[alive]]]
            length[alive] += 1
            alive = alive[length[alive] < most]
        common[:m] = length
        out[p] = length
    return out
