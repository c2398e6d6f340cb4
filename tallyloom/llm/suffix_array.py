"""Suffix arrays by induced sorting, and common prefixes in text order, vectorised over whole buckets.

``suffix_array`` classifies suffixes as larger or smaller than their right neighbour, sorts the leftmost smaller
(LMS) substrings by one induction, names them, sorts the shorter text of names recursively, and induces all suffixes
from that order.  An induction walks the buckets once in each direction; inside a bucket it moves whole waves of
entries: those placed by earlier buckets, then those they place into the same bucket, until none is added.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size walk bucket by bucket; longer texts of names have too many buckets for waves and are
#: sorted by pairing neighbouring names, the same recursion with substrings of two, four, eight ... names.
MOST_BUCKETS = 1024


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of the suffixes of an integer text in ascending order; the end is smaller than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if alphabet > MOST_BUCKETS:
        return _by_pairs(text)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _induce(text, alphabet, smaller, lms)
    ordered = _induce(text, alphabet, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = ordered[is_lms[ordered]]
    names, distinct = _names(text, lms, ordered)
    if distinct == len(lms):
        by_name = np.empty(len(lms), np.int64)
        by_name[names] = lms
        return _induce(text, alphabet, smaller, by_name)
    return _induce(text, alphabet, smaller, lms[suffix_array(names, distinct)])


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; runs of one symbol follow what ends them."""
    n = len(text)
    differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    end = differs[np.searchsorted(differs, np.arange(n))]
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    return rises[end]


def _induce(text: np.ndarray, alphabet: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order induced by the LMS suffixes, which come in the given order."""
    n = len(text)
    counts = np.bincount(text, minlength=alphabet)
    tail = np.cumsum(counts)
    head = tail - counts
    out = np.full(n, -1, np.int64)
    symbols = text[lms]
    order = np.argsort(symbols, kind="stable")
    seeds = np.bincount(symbols, minlength=alphabet)
    sorted_symbols = symbols[order]
    out[(tail - seeds)[sorted_symbols] + np.arange(len(lms)) - (np.cumsum(seeds) - seeds)[sorted_symbols]] = lms[order]
    used = np.flatnonzero(counts)

    free = head.copy()

    def larger_left(entries: np.ndarray) -> None:
        left = entries[entries > 0] - 1
        left = left[~smaller[left]]
        if len(left):
            s = text[left]
            o = np.argsort(s, kind="stable")
            s = s[o]
            c = np.bincount(s, minlength=alphabet)
            out[free[s] + np.arange(len(s)) - (np.cumsum(c) - c)[s]] = left[o]
            np.add(free, c, out=free)

    last = int(text[n - 1])
    out[free[last]] = n - 1  # the end of the text induces the last suffix
    free[last] += 1
    for c in used.tolist():
        at = int(head[c])
        while at < free[c]:
            at, begin = int(free[c]), at
            larger_left(out[begin:at])
        if seeds[c]:
            larger_left(out[tail[c] - seeds[c] : tail[c]])

    back = tail.copy()

    def smaller_left(entries: np.ndarray) -> None:
        left = entries[entries > 0] - 1
        left = left[smaller[left]]
        if len(left):
            s = text[left]
            o = np.argsort(s, kind="stable")
            s = s[o]
            c = np.bincount(s, minlength=alphabet)
            out[back[s] - 1 - (np.arange(len(s)) - (np.cumsum(c) - c)[s])] = left[o]
            np.subtract(back, c, out=back)

    for c in used[::-1].tolist():
        at = int(tail[c])
        while at > back[c]:
            at, end = int(back[c]), at
            smaller_left(out[at:end][::-1])
        smaller_left(out[head[c] : free[c]][::-1])
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Integer names of the LMS substrings in text order, by content, and how many there are."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms] = np.append(lms[1:] - lms[:-1] + 1, n + 1)  # the last one reaches the end and equals no other
    a, b = ordered[:-1], ordered[1:]
    new = np.ones(len(ordered), bool)
    left = np.flatnonzero(length[a] == length[b])
    step = 0
    while len(left):
        left = left[text[a[left] + step] == text[b[left] + step]]
        step += 1
        done = length[a[left]] == step
        new[left[done] + 1] = False
        left = left[~done]
    by_position = np.zeros(n, np.int64)
    by_position[ordered] = np.cumsum(new) - 1
    return by_position[lms], int(new.sum())


def _by_pairs(names: np.ndarray) -> np.ndarray:
    n, reach = len(names), 1
    rank = names.astype(np.int64)
    while True:
        follow = np.zeros(n, np.int64)
        if reach < n:
            follow[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) != 0)
        if new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        reach *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the order, listed by text position.

    ``room`` bounds the prefix (the distance to the end of a string).  A position whose left neighbours agree inside a
    string has one less than the position before it, so symbols are compared only where they differ.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    again = np.zeros(n, bool)  # value follows from the position before
    again[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (room[1:] == room[:-1] - 1)
    again[1:] &= text[:-1] == text[np.maximum(before[1:] - 1, 0)]
    fresh = np.flatnonzero(~again)
    length = np.zeros(n, np.int64)
    left = fresh[before[fresh] >= 0]
    wide = np.concatenate((text.astype(np.uint16), np.zeros(4, np.uint16)))
    four = np.ndarray(n + 1, np.uint64, wide.tobytes(), 0, (2,))
    step = 0
    while len(left):  # four symbols at a time
        a, b = left + step, before[left] + step
        equal = np.flatnonzero((np.maximum(a, b) + 4 <= n))
        same = four[a[equal]] == four[b[equal]]
        length[left] = step
        left = left[equal[same]]
        step += 4
        length[left] = step
        left = left[length[left] < room[left]]
    for _ in range(3):
        a, b = fresh + length[fresh], before[fresh] + length[fresh]
        more = (before[fresh] >= 0) & (np.maximum(a, b) < n)
        more[more] = text[a[more]] == text[b[more]]
        length[fresh[more]] += 1
    run = np.cumsum(~again) - 1
    start = fresh[run]
    return np.minimum(np.maximum(length[start] - (np.arange(n) - start), 0), room)
