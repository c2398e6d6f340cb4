"""Repeated byte strings, removed by suffix arrays.

Texts are cut into shards such that equal windows always meet: consecutive windows with one minimiser (of 8-byte
grams) travel together.  Each shard is one text whose suffix array is induced and whose common prefixes are computed in
text order; suffixes that share a window with their neighbour form groups, and each group takes its lowest document.
A string's end bounds its prefixes, so matches never cross documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Runs, anchor_hash, context_runs, passing_runs, remove_repeats
from .suffix_array import common_prefixes, suffix_array
from .texts import prefix_hash, substring_hash

#: Bytes of a window, and of the grams whose smallest hash is the minimiser.
WINDOW, GRAM = 50, 8

#: Ends each string of a shard; symbols 0 to 255 are bytes.
_END = 256


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    if len(data) < window:
        return None
    sums = prefix_hash(data)
    inside = np.maximum(np.diff(offsets) - window + 1, 0)
    row = np.repeat(np.arange(len(inside)), inside)
    at = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside) + offsets[row]
    every = np.arange(len(data) - gram + 1)
    begin, n, place, left = context_runs(substring_hash(sums, every, every + gram), at, row, window, gram)
    anchor = anchor_hash(substring_hash(sums, place, place + gram + (window - gram + 1) // 2), left)
    return sums, at, row, begin, n, anchor


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_units (UTF-8 bytes), n_removed, spans (maximal removed byte ranges), kept
    (the remaining bytes; a cut may fall inside a character).  The whole text counts, a null text is empty.  Strings are
    judged on the input, overlaps count.  Rows with one id do not make each other's strings repeated; a null id comes
    after all others.  Other columns of ``docs`` are not read.
    """
    def anchors(data, offsets):
        found = _windows(data, offsets, window, gram)
        if found is None:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        _, _, row, begin, _, anchor = found
        return row[begin], anchor

    def extract(data, offsets, known) -> Runs:
        none = np.zeros(0, np.int64)
        found = _windows(data, offsets, window, gram)
        if found is None:
            return Runs(none, none, none, none.view(np.uint64), none, none, data)
        sums, at, row, begin, n, anchor = found
        begin, n, key = passing_runs(begin, n, anchor, known, lambda i: substring_hash(sums, at[i], at[i] + window))
        p = at[begin]
        return Runs(row[begin], p - offsets[row[begin]], n, key, p, p + n + window - 1, data)

    def fingerprint(runs: Runs) -> np.ndarray:
        return substring_hash(prefix_hash(runs.data), runs.begin, runs.end)

    def solve(offsets, data, n, low, key):
        return _lowest(offsets, data, n, low, key, window)

    def kept(value, begins, ends):
        edges = [0, *np.column_stack((begins, ends)).ravel().tolist(), len(value)]
        rest = b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return len(value), len(value) - len(rest), rest

    return remove_repeats(docs, doc_id, text, window, extract, anchors, fingerprint, solve, kept)


def _lowest(offsets: np.ndarray, data: np.ndarray, n: np.ndarray, low: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Lowest document of each window of the distinct strings of a shard, whose keys are in order."""
    lengths = np.diff(offsets)
    lows = np.repeat(low, n)
    same = np.append(False, key[1:] == key[:-1])
    chosen = np.flatnonzero(same | np.append(same[1:], False))  # a string alone with its anchor shares no window
    if not len(chosen):
        return lows
    size = lengths[chosen]
    ends = np.cumsum(size + 1)
    begins = ends - size - 1
    string = np.repeat(np.arange(len(chosen)), size + 1)
    within = np.arange(ends[-1]) - begins[string]
    room = size[string] - within
    text = np.full(ends[-1], _END, np.uint16)
    body = room > 0
    text[body] = data[offsets[chosen][string[body]] + within[body]]

    order = suffix_array(text, _END + 1)
    shared = common_prefixes(text, order, room)
    order = order[room[order] >= window]
    new = shared[order] < window
    if len(new):
        new[0] = True
    heads = np.flatnonzero(new)
    lowest = np.minimum.reduceat(low[chosen][string[order]], heads)
    by_position = np.zeros(len(text), np.int64)
    by_position[order] = np.repeat(lowest, np.diff(np.append(heads, len(order))))
    first = np.append(0, np.cumsum(n))[:-1]
    count = n[chosen]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lows[np.repeat(first[chosen], count) + inner] = by_position[np.repeat(begins, count) + inner]
    return lows
