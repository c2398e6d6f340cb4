"""Repeated passages of words, removed by super-k-mer partitioning.

The minimiser of a window of words is the smallest hash of the word 3-grams in it.  Consecutive windows sharing a
minimiser travel as one packed string (words joined by a space) to the minimiser's bucket.  There the words of all
strings get integer names by content, and the windows are sorted as rows of names: equal windows become neighbours by
content.  Only whole packed strings are united by hash (128 bits of their anchor and their bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Runs, anchor_hash, context_runs, passing_runs, remove_repeats
from .texts import IS_BLANK, block_hash, mix, row_of, words

#: Words of a window, and of the grams whose smallest hash is the minimiser.
WINDOW, GRAM = 13, 3


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    starts, ends, first = words(data, offsets)
    if len(starts) < window:
        return None
    hashes = block_hash(data, starts, ends)
    row = row_of(np.arange(len(starts) - window + 1), first)
    at = np.flatnonzero(np.arange(len(row)) + window <= first[row + 1])
    row = row[at]
    begin, n, place, left = context_runs(_rolled(hashes, gram), at, row, window, gram)
    anchor = anchor_hash(_rolled(hashes, gram + (window - gram + 1) // 2)[place], left)
    return starts, ends, first, hashes, at, row, begin, n, anchor


def remove_repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a window of words that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_units (words), n_removed, spans (word ranges removed), kept (the other
    words joined by one space, UTF-8).  Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; a null text has
    none.  Windows are judged on the input.  Rows with one id do not make each other's windows repeated; a null id comes
    after all others.  Texts shorter than a window lose nothing.  Other columns of ``docs`` are not read.
    """
    def anchors(data, offsets):
        found = _windows(data, offsets, window, gram)
        if found is None:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        *_, row, begin, _, anchor = found
        return row[begin], anchor

    def extract(data, offsets, known) -> Runs:
        none = np.zeros(0, np.int64)
        found = _windows(data, offsets, window, gram)
        if found is None:
            return Runs(none, none, none, none.view(np.uint64), none, none, data)
        starts, ends, first, hashes, at, row, begin, n, anchor = found
        begin, n, key = passing_runs(begin, n, anchor, known, lambda i: _rolled(hashes, window)[at[i]])
        # Words and one space after each: blanks other than the first after a word are left out.
        inside = ~IS_BLANK[data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        place = np.cumsum(keep) - 1
        packed = data[keep]
        packed[IS_BLANK[packed]] = 32
        p = at[begin]
        return Runs(row[begin], p - first[row[begin]], n, key, place[starts[p]], place[ends[p + n + window - 2] - 1] + 1, packed)

    def solve(offsets, data, n, low, key):
        return _lowest(offsets, data, n, low, window)

    def kept(value, begins, ends):
        every = value.split()
        gone = int((ends - begins).sum())
        if gone:
            edges = [0, *np.column_stack((begins, ends)).ravel().tolist(), len(every)]
            rest = [w for a, b in zip(edges[::2], edges[1::2]) for w in every[a:b]]
        else:
            rest = every
        return len(every), gone, b" ".join(rest)

    return remove_repeats(docs, doc_id, text, window, extract, anchors, _fingerprint, solve, kept)


def _fingerprint(runs: Runs) -> np.ndarray:
    return block_hash(runs.data, runs.begin, runs.end)


def _lowest(offsets: np.ndarray, data: np.ndarray, n: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """Lowest document of each window of the packed strings; windows are compared by their words."""
    starts, ends, first = words(data, offsets)
    lengths = ends - starts
    total = np.cumsum(lengths)
    text = data[np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, total)), pa.py_buffer(text)])
    names = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Name pairs of neighbours until a name stands for a whole window: 2, 4, 8 ... words, then one overlapping pair.
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        pair = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1]
        reach += step
    string = np.repeat(np.arange(len(n)), n)
    at = first[string] + np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    name = names[at]
    lowest = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
    order = np.argsort(name, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(name[order]) != 0))
    lowest[name[order][heads]] = np.minimum.reduceat(low[string][order], heads)
    return lowest[name]
