"""Two-stage suffix sorting in numpy, to a bounded depth.

A suffix is ascending if it is smaller than its successor, descending otherwise. Only ascending suffixes are sorted
directly; a scan over the buckets of first bytes, smallest first, then places each descending suffix behind those that
it follows. Sorted to `depth` bytes, neighbours that agree in so many bytes are the repeated strings.
"""

import numpy as np


def big_endian(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros behind the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):  # pairs, fours, eights
        x[:-shift] = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    return x[: len(text)]


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, before the end, is not."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    up = np.zeros(n, bool)
    if len(differs):
        at = np.searchsorted(differs, np.arange(n))  # the next place where neighbours differ
        ok = at < len(differs)
        d = differs[at[ok]]
        up[ok] = text[d] < text[d + 1]
    return up


def sort_direct(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes from each on; only those still tied are looked at again."""
    n = len(keys)
    at = at[np.argsort(keys[at], kind="stable")]
    k = keys[at]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        same = np.zeros(len(at), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        p = at[tied]
        k = np.where(p + d < n, keys[np.minimum(p + d, n - 1)], np.uint64(0))
        order = np.lexsort((k, group[tied]))
        at[tied] = p[order]
        k, g = k[order], group[tied]
        new = np.zeros(len(at), np.int64)
        step = np.zeros(len(tied), np.int64)
        step[1:] = (k[1:] != k[:-1]) & (g[1:] == g[:-1])
        new[tied] = step
        group = group + np.cumsum(new)
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask), sorted by the `depth` bytes from each on."""
    up = ascending(text)
    # a descending suffix is placed by its successor: take in the chain up to the next ascending one
    need = wanted.copy()
    while True:
        more = np.zeros_like(need)
        more[1:] = need[:-1] & ~up[:-1]
        more &= ~need
        if not more.any():
            break
        need |= more
    keys = big_endian(text)
    direct = sort_direct(np.flatnonzero(need & up), keys, depth)
    firsts = text[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[-1] and not up[-1]:
        waiting[text[-1]].append(np.array([len(text) - 1]))
    out = []

    def hand_on(block: np.ndarray, c: int) -> np.ndarray:
        """Puts the block's descending predecessors behind what waits in their buckets; returns those in this one."""
        p = block[block > 0] - 1
        p = p[need[p] & ~up[p]]
        b = text[p]
        for k in np.unique(b):
            if k != c:
                waiting[k].append(p[b == k])
        return p[b == c]

    for c in range(256):
        while waiting[c]:
            layer = np.concatenate(waiting[c])
            waiting[c] = []
            while len(layer):
                out.append(layer)
                layer = hand_on(layer, c)
        block = direct[bounds[c] : bounds[c + 1]]
        if len(block):
            out.append(block)
            hand_on(block, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def agree(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each position's first `length` bytes equal those of the one before it in order (adjacent common prefix)."""
    keys, n = big_endian(text), len(text)
    same = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        a, b = order[left] + d, order[left - 1] + d
        ok = (np.maximum(a, b) < n) & (keys[np.minimum(a, n - 1)] == keys[np.minimum(b, n - 1)])
        left = left[ok]
    same[left] = True
    return same
