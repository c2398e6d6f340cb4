"""Periodic runs of words: maximal pairs of a bottom-up LCP-interval tree, restricted to distances that make a run.

A pair of equal stretches at positions i < j of one text is *maximal* when the words before them differ and the words
after them differ.  If its length l is at least its distance p = j - i, the stretch from i to j + l has period p and no
neighbouring word continues that period: it is a run as it stands, nothing has to be extended.  Maximal pairs come from
the suffixes of the text, sorted, and the tree of intervals with a common prefix: two suffixes from different children of
an interval differ after it, so only the words before them have to be compared.  Every interval therefore keeps its
suffixes in lists by left word; when children are united, the elements of the smaller one look up, in the lists of other
left words, only the positions whose distance is admitted.  A run of many periods shows its multiples too: of equal
stretches the smallest period counts.

Texts are independent, so this is one pass over the table without a shuffle.  Words are named exactly (no hashes decide).
Suffix sorting and common prefixes are vectorised over a slice of texts; hashes of short windows first rule out the texts
and suffixes that repeat nothing.  Groups of suffixes with one left word, or whose members are further apart than their
common prefix is long, can give no run and are dropped before the tree is walked.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import mix

#: Words of a run at least; it must also hold two periods.
LEAST = 12

#: Bytes of text whose words are split at once, and of texts that are sorted together.
PART_BYTES = 1 << 22

#: (id or None, names of the words) -> names of the words to use instead
Rewrite = Callable[[int | None, np.ndarray], np.ndarray]


def named_words(data: memoryview, names: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a text, new words added to ``names``; a long text is split part by part, at blanks."""
    found, begin = [], 0
    while begin < len(data):
        end = min(begin + PART_BYTES, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        part = bytes(data[begin:end]).split()  # bytes are split at \x20 and \x09-\x0D and nothing else
        found.append(np.fromiter((names.setdefault(w, len(names)) for w in part), np.int64, len(part)))
        begin = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _classes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the values, and how often each rank occurs."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    number = np.cumsum(new) - 1
    ranks = np.empty(len(values), np.int64)
    ranks[order] = number
    return ranks, np.bincount(number)


def repeated_windows(names: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` words may occur again in their text (a hash may only let more through)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    total = text.astype(np.uint64)[at]
    for k in range(width):
        total = mix(total + names[at + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(total)
    same = total[order][1:] == total[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return at[again]


def sorted_ranks(symbols: np.ndarray) -> np.ndarray:
    """Place of every suffix among the sorted ones, by doubling; only ties are sorted again.

    The symbols of different texts differ, so suffixes are told apart before they leave their text.
    """
    n = len(symbols)
    ranks, count = _classes(symbols)
    # The first place of each class is its rank, so that refining one class leaves the others alone.
    ranks = (np.cumsum(count) - count)[ranks]
    reach, open_ = 1, np.arange(n)
    while True:
        size = np.bincount(ranks[open_], minlength=n)[ranks[open_]]
        open_ = open_[size > 1]
        if not len(open_):
            return ranks
        after = np.where(open_ + reach < n, ranks[np.minimum(open_ + reach, n - 1)] + 1, 0)
        key = ranks[open_] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        group = key // (n + 1)
        new = np.append(True, key[1:] != key[:-1])
        head = np.append(True, group[1:] != group[:-1])
        index = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(head, index, 0))
        ranks[open_] = group + first
        reach *= 2


def common_lengths(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of each pair of neighbouring suffixes of one text.

    If the same word stands before both, the pair one word earlier are neighbours too and share one word more; so only
    pairs with different left words are compared, the others follow in text order.
    """
    n, out = len(symbols), np.zeros(len(a), np.int64)
    order = np.argsort(b)
    a, b = a[order], b[order]
    follows = np.zeros(len(b), bool)
    if len(b):
        follows[1:] = (b[1:] == b[:-1] + 1) & (a[1:] == a[:-1] + 1) & (symbols[a[:-1]] == symbols[b[:-1]])
    heads = np.flatnonzero(~follows)
    length, waiting, width = np.zeros(len(heads), np.int64), np.arange(len(heads)), 16
    while len(waiting):
        rest = []
        for part in np.array_split(waiting, max(1, len(waiting) * width // 2_000_000)):
            x = a[heads[part]] + length[part]
            y = b[heads[part]] + length[part]
            steps = np.arange(width)
            i, j = np.minimum(x[:, None] + steps, n - 1), np.minimum(y[:, None] + steps, n - 1)
            differ = (symbols[i] != symbols[j]) | (np.maximum(x, y)[:, None] + steps >= n)
            stop = differ.any(1)
            length[part] += np.where(stop, differ.argmax(1), width)
            rest.append(part[~stop])
        waiting, width = np.concatenate(rest), min(2 * width, 8192)
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(b))))
    out[order] = length[np.cumsum(~follows) - 1] - (np.arange(len(b)) - head)
    return out


class _Sorted:
    """Numbers in sorted lists of growing size, so that adding stays cheap and ranges are found by bisection."""

    __slots__ = ("lists",)

    def __init__(self) -> None:
        self.lists: list[list[int]] = []

    def add(self, value: int) -> None:
        new = [value]
        while self.lists and len(self.lists[-1]) <= len(new):
            new = self.lists.pop() + new
            new.sort()
        self.lists.append(new)

    def between(self, low: int, high: int) -> list[int]:
        out: list[int] = []
        for values in self.lists:
            at = bisect.bisect_left(values, low)
            if at < len(values) and values[at] <= high:
                out += values[at : bisect.bisect_right(values, high)]
        return out

    def count(self, low: int, high: int) -> int:
        return sum(bisect.bisect_right(v, high) - bisect.bisect_left(v, low) for v in self.lists)


class _Interval:
    """Suffixes of an interval: all of them, and in lists by left word."""

    __slots__ = ("size", "every", "lists")

    def __init__(self) -> None:
        self.size, self.every, self.lists = 0, _Sorted(), {}

    def add(self, position: int, left: int) -> None:
        self.size += 1
        self.every.add(position)
        if left not in self.lists:
            self.lists[left] = _Sorted()
        self.lists[left].add(position)

    def elements(self) -> Iterator[tuple[int, int]]:
        for left, values in self.lists.items():
            for each in values.lists:
                for position in each:
                    yield position, left


def tree_runs(positions: list[int], lefts: list[int], common: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Walk the interval tree over sorted suffixes bottom-up; enter (start, end) -> smallest period into ``found``.

    ``common[k]`` is the common prefix of suffixes k - 1 and k.
    """
    left_of = dict(zip(positions, lefts))

    def united(one: _Interval, other: _Interval, length: int) -> _Interval:
        small, large = (one, other) if one.size <= other.size else (other, one)
        near = max(least - length, 1)
        for i, left in small.elements():
            if large.every.count(i - length, i + length) <= len(large.lists):
                partners = [j for j in large.every.between(i - length, i + length) if left_of[j] != left]
            else:
                partners = [j for other_left, values in large.lists.items() if other_left != left for j in values.between(i - length, i + length)]
            for j in partners:
                start, distance = (i, j - i) if i < j else (j, i - j)
                if distance >= near:
                    stretch = (start, start + distance + length)
                    found[stretch] = min(distance, found.get(stretch, distance))
        for i, left in small.elements():
            large.add(i, left)
        return large

    def leaf(k: int) -> _Interval:
        new = _Interval()
        new.add(positions[k], lefts[k])
        return new

    stack: list[tuple[int, _Interval]] = []
    last = leaf(0)
    for k in range(1, len(positions)):
        length = common[k]
        while stack and stack[-1][0] > length:
            deeper, inner = stack.pop()
            last = united(inner, last, deeper)
        if stack and stack[-1][0] == length:
            last = united(stack.pop()[1], last, length)
        stack.append((length, last))
        last = leaf(k)
    while stack:
        length, inner = stack.pop()
        last = united(inner, last, length)


def runs_of_texts(texts: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per text (names of words) its runs as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    width = (least + 1) // 2  # a run of n words and two periods repeats at least n / 2 words
    if not len(sizes) or sizes.max() <= width:
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    again = repeated_windows(np.concatenate(texts), text, width)
    chosen = np.flatnonzero(np.bincount(text[again], minlength=len(texts)))
    if not len(chosen):
        return out
    # From here on only texts that may repeat something, each with symbols of its own and a symbol after its end.
    base, parts = 0, []
    for t in chosen:
        parts += [texts[t] + base, np.array([base + texts[t].max() + 1])]
        base += int(texts[t].max()) + 2
    symbols = np.concatenate(parts)
    begins = np.cumsum(sizes[chosen] + 1) - sizes[chosen] - 1
    old = np.cumsum(sizes) - sizes
    which = np.full(len(texts), -1)
    which[chosen] = np.arange(len(chosen))
    active = again - old[text[again]] + begins[which[text[again]]]

    ranks = sorted_ranks(symbols)
    active = active[np.argsort(ranks[active])]
    a, b = active[:-1], active[1:]
    steps = np.arange(width)
    # Symbols of two texts differ, so equal windows lie in one text.
    same = (symbols[a[:, None] + steps] == symbols[b[:, None] + steps]).all(1) if len(a) else np.zeros(0, bool)
    length = np.zeros(len(active), np.int64)
    length[1:][same] = common_lengths(symbols, a[same], b[same])
    left = np.where(np.isin(active, begins), -1, symbols[active - 1])

    group = np.cumsum(length == 0) - 1
    first = np.flatnonzero(length == 0)
    varied = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    order = np.lexsort((active, group))
    gap = np.diff(active[order], prepend=0)
    gap[first] = len(symbols)
    varied &= np.minimum.reduceat(gap, first) <= np.maximum.reduceat(length, first)
    bounds = np.append(first, len(active))
    home = np.searchsorted(begins, active[first], "right") - 1
    found: dict[int, dict[tuple[int, int], int]] = {}
    for g in np.flatnonzero(varied):
        part = slice(bounds[g], bounds[g + 1])
        tree_runs(active[part].tolist(), left[part].tolist(), length[part].tolist(), least, found.setdefault(int(home[g]), {}))
    for h, stretches in found.items():
        begin = int(begins[h])
        out[int(chosen[h])] = sorted(((s - begin, e - s, p) for (s, e), p in stretches.items()), key=lambda r: (r[0], r[2]))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words any run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    if runs:
        start, length, period = np.array(runs).T
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:n] > 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), kept (binary) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0, compared byte by byte.  A run is a stretch of
    consecutive words with smallest period q and at least ``max(least, 2 * q)`` words that no neighbouring word extends
    keeping that period.  ``kept`` holds the words, joined by one space, that no run contains after its first q words.
    ``rewrite`` may replace a text's words (as numbers) before anything is looked for.

    A null or empty text, or one of blanks only, has no words, no runs and an empty ``kept``.  Rows are independent: each
    repeated row and each null id comes out as it went in.  A very long text is sorted in one task, in about 80 bytes
    a word; only the id and the text are read, so other columns may have any name.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < batch.num_rows:
                names: dict[bytes, int] = {}
                texts, size, begin = [], 0, at
                while at < batch.num_rows and (size < PART_BYTES or at == begin):
                    value = column[at].as_buffer() if column[at].is_valid else None
                    words = named_words(memoryview(value).cast("B"), names) if value is not None else np.zeros(0, np.int64)
                    texts.append(rewrite(ids[at], words) if rewrite else words)
                    size += value.size if value is not None else 0
                    at += 1
                runs, spelled, kept = runs_of_texts(texts, least), list(names), []
                for words, own in zip(texts, runs):
                    rest = words[~dropped(len(words), own)] if own else words
                    kept.append(b" ".join([spelled[w] for w in rest.tolist()]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, at - begin), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], _RUNS), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "runs", "kept"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(walk, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept binary")
