"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies the suffixes, sorts the leftmost-smaller substrings by
induction (recursively where some are equal), and induces all suffixes from them in
linear passes. ``permuted_prefixes`` gives each suffix's common prefix with the one before it
in order: only suffixes whose left neighbours differ are compared, the others follow
from the one before them in the text.
"""

from __future__ import annotations

import numpy as np


def smaller_type(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is smallest and true."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    up = np.append(s[:-1] < s[1:], True)
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return up[nearest]


def _induce(sa: list[int], before: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> None:
    """Fill in all suffixes from the leftmost-smaller ones that stand at the ends of their buckets.

    ``before`` has each suffix's left symbol. One pass to the right puts the larger-type suffixes
    at the heads of their buckets, one to the left the smaller-type ones at the tails;
    either pass reads what it has just written.
    """
    left_small = np.append([False], small[:-1])
    first = np.arange(len(sa)) == 0
    larger = np.where(first | left_small, -1, before).tolist()
    head = heads.tolist()
    for p in sa:
        if p > 0:
            c = larger[p]
            if c >= 0:
                h = head[c]
                sa[h] = p - 1
                head[c] = h + 1
    smaller = np.where(first | ~left_small, -1, before).tolist()
    tail = tails.tolist()
    for p in reversed(sa):
        if p > 0:
            c = smaller[p]
            if c >= 0:
                t = tail[c] - 1
                sa[t] = p - 1
                tail[c] = t


def _seed(n: int, s: np.ndarray, lms: np.ndarray, tails: np.ndarray) -> list[int]:
    """Leftmost-smaller suffixes, in the order given, at the tails of their buckets."""
    sa = np.full(n, -1, dtype=np.int64)
    order = np.argsort(s[lms], kind="stable")
    symbols = s[lms][order]
    last = np.searchsorted(symbols, symbols, side="right")
    sa[tails[symbols] - (last - np.arange(len(symbols)))] = lms[order]
    return sa.tolist()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order. The last symbol has to be 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = smaller_type(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    tails = np.cumsum(np.bincount(s))
    heads = np.append([0], tails[:-1])
    before = np.append([0], s[:-1])
    sa = _seed(n, s, lms, tails)
    _induce(sa, before, small, heads, tails)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    done = np.asarray(sa)
    ordered = done[is_lms[done]]
    if len(lms) > 1:
        size = np.zeros(n, dtype=np.int64)
        size[lms] = np.append(np.diff(lms) + 1, 1)
        a, b, k = ordered[:-1], ordered[1:], size[ordered[1:]]
        starts = np.append([0], np.cumsum(k)[:-1])
        step = np.arange(k.sum()) - np.repeat(starts, k)
        unlike = s[np.minimum(np.repeat(a, k) + step, n - 1)] != s[np.repeat(b, k) + step]
        new = (size[a] != k) | (np.add.reduceat(unlike, starts) > 0)
        names = np.append([0], np.cumsum(new))
        if names[-1] + 1 < len(lms):
            named = np.empty(n, dtype=np.int64)
            named[ordered] = names
            ordered = lms[suffix_array(named[lms])]
    sa = _seed(n, s, ordered, tails)
    _induce(sa, before, small, heads, tails)
    return np.asarray(sa)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position, the length that a suffix shares with the one before it in ``sa``; 0 for the first."""
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0) & (s[at - 1] == s[np.maximum(before - 1, 0)])
    own = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, dtype=np.int64)
    live, k = own, 0
    while len(live):
        other = before[live] + k
        room = (live + k < n) & (other < n)
        live = live[room]
        live = live[s[live + k] == s[before[live] + k]]
        k += 1
        length[live] = k
    anchor = np.maximum.accumulate(np.where(follows, 0, at))
    return length[anchor] - (at - anchor)
