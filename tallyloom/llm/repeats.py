"""Windows that repeat across documents: finding them by minimiser buckets.

A *window* is a fixed number of consecutive units (words or bytes) of one text.  Its minimiser is the gram with the
smallest hash in it, its *anchor* the minimiser with what surrounds it inside the window, so equal windows have equal
anchors.  Consecutive windows with one anchor form a *run*, which travels as one packed string.  The plan, for any unit:

1. ``repeated_anchors``: every task lists the anchors of its texts, 4 bytes each, in one blob per hash bucket; a
   bucket's task sorts them and keeps those of two or more texts as a small bit filter.  A filter only decides which
   runs need not travel: an anchor of one text cannot belong to a repeated window.
2. ``travelling``: the runs whose anchor passes.  Texts are taken in *loads* of bounded size; of equal strings a load
   sends one, with its lowest document, to the bucket of its anchor, and keeps a list of where they were.
3. ``lowest_documents``: in a bucket the operator's own exact method finds for each window the lowest document that has
   it.  The answer goes back to each load, not to each copy, so a string that fills the corpus is not a hot key.  The
   strings, which are the bulk, cross the network once and are not written; the lists and answers are.
4. ``removed_ranges``: a load and its answers meet and give the removed ranges of each of its documents.

Anchors so frequent that they fill a noticeable share of their bucket are split: their windows travel one by one under
the hash of the whole window, so no group of distinct strings is tied to a frequent gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .texts import mix, slices, window_minimum

#: Bytes that all bit filters of a job may take together; beyond, they let more runs pass.
FILTER_BYTES = 64 << 20

#: An anchor is split when it holds this share of its bucket.
HOT_SHARE = 0.01

#: Bytes of text in a load.
LOAD_BYTES = 16 << 20

#: Packed bytes that a bucket's task solves at once (whole anchors).
CHUNK_BYTES = 2 << 20

#: Null ids come after all others.
NO_ID = (1 << 63) - 1

NONE = np.zeros(0, np.uint64)

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Runs:
    """Runs of windows of one slice: row, first window in the row, number of windows, key; and the bytes to pack."""

    row: np.ndarray
    at: np.ndarray
    n: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray


#: (bytes, offsets, filter) -> the runs that travel
Extract = Callable[[np.ndarray, np.ndarray, "AnchorFilter"], Runs]


def runs_of(position: np.ndarray, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of maximal runs of consecutive positions of a row with one key."""
    if not len(position):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(position), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (position[1:] != position[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(position)))


def context_runs(grams: np.ndarray, at: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser and one side of it: first index, length, and the anchor's place.

    ``grams`` are hashes of the grams of the whole slice, ``at`` the windows that lie inside a row.  A window's anchor is
    its minimiser (the leftmost, if its hash occurs twice) with as many units on its left as every window with such a
    minimiser has on one side, or else on its right: (first unit, whether it is the left side).  All of it lies in the
    window, so equal windows have equal anchors.
    """
    half = (window - gram + 1) // 2
    places = np.uint64((1 << 31) - 1)
    least = window_minimum(grams & ~places | np.arange(len(grams), dtype=np.uint64), window - gram + 1)[at]
    place = (least & places).astype(np.int64)
    left = at <= place - half
    begin, n = runs_of(at, row, place * 2 + left)
    place, left = place[begin], left[begin]
    return begin, n, np.where(left, place - half, place), left


def anchor_hash(context: np.ndarray, left: np.ndarray) -> np.ndarray:
    return mix(context + left.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))


def passing_runs(begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, known: AnchorFilter, whole: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first window, windows and key of the runs that travel; hot ones window by window."""
    passes = known.passes(anchor)
    begin, n, anchor = begin[passes], n[passes], anchor[passes]
    hot = known.is_hot(anchor)
    if not hot.any():
        return begin, n, anchor
    each = np.repeat(begin[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
    return (np.concatenate((begin[~hot], each)), np.concatenate((n[~hot], np.ones(len(each), np.int64))),
            np.concatenate((anchor[~hot], mix(whole(each) ^ np.uint64(0x2545F4914F6CDD1D)))))


class AnchorFilter:
    """Bit filters by bucket, and the hot anchors; ``state`` is plain arrays, for a broadcast."""

    def __init__(self, state: tuple) -> None:
        self.state = self.buckets, self.size, self.base, self.bits, self.hot_low = state

    @staticmethod
    def of(buckets: int, parts: list) -> AnchorFilter:
        size, base = np.full(buckets, 8, np.uint64), np.zeros(buckets, np.uint64)
        blobs, at = [np.zeros(1, np.uint8)], 1
        for bucket, bits, _ in parts:
            size[bucket], base[bucket] = len(bits) * 8, at * 8
            blobs.append(np.frombuffer(bits, np.uint8))
            at += len(bits)
        hot = [np.frombuffer(x, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, _, x in parts if x]
        return AnchorFilter((buckets, size, base, np.concatenate(blobs), np.sort(np.concatenate(hot)) if hot else NONE))

    def only_hot(self) -> AnchorFilter:
        """Without the bits, for tasks that only ask for hot anchors."""
        return AnchorFilter((self.buckets, self.size, self.base, np.zeros(1, np.uint8), self.hot_low))

    def passes(self, anchor: np.ndarray) -> np.ndarray:
        bucket, low = _address(anchor, self.buckets)
        out = np.ones(len(anchor), bool)
        for odd in _ODD:
            bit = self.base[bucket] + ((low * odd) >> np.uint64(20)) % self.size[bucket]
            out &= (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def is_hot(self, anchor: np.ndarray) -> np.ndarray:
        if not len(self.hot_low):
            return np.zeros(len(anchor), bool)
        bucket, low = _address(anchor, self.buckets)
        short = (bucket.astype(np.uint64) << np.uint64(32)) | low
        return self.hot_low[np.minimum(np.searchsorted(self.hot_low, short), len(self.hot_low) - 1)] == short


def _address(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((anchor >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64), anchor & np.uint64(0xFFFFFFFF)


def repeated_anchors(texts: DataFrame, anchors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], hot_share: float = HOT_SHARE) -> AnchorFilter:
    """Anchors that occur in two or more texts.  ``anchors(bytes, offsets)`` gives (row, anchor), each pair once or more.

    The driver receives one bit filter per bucket, together at most ``FILTER_BYTES``; no anchor is lost by that bound,
    as a full filter lets everything pass.  32 bits of an anchor are compared within its bucket, which can only let
    more pass; an anchor that repeats inside one text is counted once.
    """
    spark = texts.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = FILTER_BYTES // buckets

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def emit() -> pa.RecordBatch:
            every = np.concatenate(kept)
            bucket, low = _address(every, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            low, ends = low[order].astype("<u4"), np.cumsum(np.bincount(bucket, minlength=buckets))
            rows = [(b, low[e - n : e].tobytes()) for b, (e, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "anchors"])

        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                row, anchor = anchors(data, offsets)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                kept.append(anchor[once])
                size += len(kept[-1])
                if size > 4_000_000:
                    yield emit()
                    kept, size = [], 0
        if size:
            yield emit()

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_bucket.setdefault(b, []).append(np.frombuffer(blob.as_buffer(), "<u4"))
        for b, blobs in by_bucket.items():
            values = np.sort(np.concatenate(blobs))
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            count = np.diff(np.append(first, len(values)))
            repeated = values[first[count > 1]].astype(np.uint64)
            if not len(repeated):
                continue
            size = min(max(64, 16 * len(repeated)), max(64, limit * 8)) // 8 * 8
            bits = np.zeros(size, bool)
            for odd in _ODD:
                bits[((repeated * odd) >> np.uint64(20)) % np.uint64(size)] = True
            hot = values[first[count > max(64, hot_share * len(values))]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([hot.astype("<u4").tobytes()], pa.binary())], ["bucket", "bits", "hot"])

    blobs = texts.select("text").mapInArrow(listed, "bucket int, anchors binary")
    filters = blobs.repartition(buckets // 4, "bucket").mapInArrow(sorted_out, "bucket int, bits binary, hot binary")
    return AnchorFilter.of(buckets, [(r["bucket"], r["bits"], r["hot"]) for r in filters.collect()])


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """text, doc (null last), mark: a text under an id is known by its own hash too, as ids may repeat."""
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc")).withColumn("mark", F.xxhash64("text"))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob."""
    body = b"".join(x.tobytes() for x in arrays)
    head = ",".join(f"{x.dtype.str}{len(x)}" for x in arrays).encode()
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    body = pa.decompress(blob[12 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind in blob[12 : 12 + n].decode().split(","):
        dtype, length = np.dtype(kind[:3]), int(kind[3:])
        out.append(np.frombuffer(body, dtype, length, at))
        at += length * dtype.itemsize
    return out


def gather(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated data[begin : begin + length]."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by the keys, first places of the groups in that order, and the group of each row."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def travelling(texts: DataFrame, extract: Extract, anchors: AnchorFilter, fingerprint: Callable[[Runs], np.ndarray]) -> DataFrame:
    """bucket, load, content: for each load the distinct strings by bucket, and (bucket -1) where they came from."""
    shared = texts.sparkSession.sparkContext.broadcast(anchors.state)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = AnchorFilter(shared.value)
        task, loads, taken, parts = TaskContext.get().partitionId(), 0, 0, []

        def emit() -> pa.RecordBatch:
            key, prints, doc, mark, at, n, length = (np.concatenate([p[k] for p in parts]) for k in range(7))
            data = np.concatenate([p[7] for p in parts])
            order, first, number = groups(key, prints)
            head = order[first]
            low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            begin = np.cumsum(length) - length
            bucket, _ = _address(key[head], known.buckets)
            by_bucket = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=known.buckets))
            rows = []
            for b, (e, m) in enumerate(zip(ends, np.diff(ends, prepend=0))):
                if m:
                    own = by_bucket[e - m : e]
                    h = head[own]
                    rows.append((b, packed(key[h], prints[h], n[h].astype(np.int32), low[own], high[own], own.astype(np.int32), length[h].astype(np.int32), gather(data, begin[h], length[h]))))
            rows.append((-1, packed(number.astype(np.int32), doc, mark, at.astype(np.int32))))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([(task << 24) + loads] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "load", "content"])

        for batch in batches:
            docs, marks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, data, offsets in slices(batch.column(0)):
                runs = extract(data, offsets, known)
                taken += len(data)
                if len(runs.row):
                    length = runs.end - runs.begin
                    parts.append((runs.key, fingerprint(runs), docs[first + runs.row], marks[first + runs.row], runs.at, runs.n, length, gather(runs.data, runs.begin, length)))
                if taken >= LOAD_BYTES and parts:
                    yield emit()
                    taken, parts, loads = 0, [], loads + 1
        if parts:
            yield emit()

    return texts.select("text", "doc", "mark").mapInArrow(cut, "bucket int, load bigint, content binary")


#: (offsets, bytes, windows per string, lowest document per string, anchor per string) -> lowest document per window
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def lowest_documents(runs: DataFrame, solve: Solve) -> DataFrame:
    """answer, load, content: the lists of each load (answer false), and for the strings of a load that lose a window in
    one of its documents, the lowest documents (answer true)."""
    def solved(blobs: list[bytes], loads: list[int]) -> pa.RecordBatch:
        parts = [unpacked(b) for b in blobs]
        key, prints, n, low, high, own, length = (np.concatenate([p[k] for p in parts]) for k in range(7))
        load = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        data = np.concatenate([p[7] for p in parts])
        order, first, number = groups(key, prints)
        head = order[first]
        begin = np.cumsum(length.astype(np.int64)) - length
        lowest = np.minimum.reduceat(low[order], first)
        size = length[head].astype(np.int64)
        keys, total = key[head], np.cumsum(size)
        edges, answers = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)), []
        at = 0
        while at < len(keys):  # whole anchors, as many as fit into a chunk
            limit = np.searchsorted(total, total[at] - size[at] + CHUNK_BYTES, "right")
            end = int(edges[max(np.searchsorted(edges, limit, "right") - 1, np.searchsorted(edges, at, "right"))])
            part = slice(at, end)
            answers.append(solve(np.append(0, np.cumsum(size[part])), gather(data, begin[head[part]], size[part]), n[head[part]].astype(np.int64), lowest[part], keys[part]))
            at = end
        lows = np.concatenate(answers)
        starts = np.cumsum(n[head].astype(np.int64)) - n[head]
        least = np.minimum.reduceat(lows, starts)
        rows = []
        for k in range(len(parts)):
            r = np.flatnonzero(load == k)
            r = r[least[number[r]] < high[r]]
            if len(r):
                count = n[r].astype(np.int64)
                rows.append((loads[k], packed(own[r], n[r], gather(lows, starts[number[r]], count))))
        return pa.RecordBatch.from_arrays([pa.array([True] * len(rows), pa.bool_()), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["answer", "load", "content"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, loads = None, [], []
        for batch in batches:
            for b, load, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([load], pa.int64()), pa.array([blob.as_py()], pa.binary())], ["answer", "load", "content"])
                    continue
                if b != now and blobs:
                    yield solved(blobs, loads)
                    blobs, loads = [], []
                now = b
                blobs.append(blob.as_py())
                loads.append(load)
        if blobs:
            yield solved(blobs, loads)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.col("load"))).sortWithinPartitions("bucket", "load")
    return dealt.mapInArrow(by_bucket, "answer boolean, load bigint, content binary")


def removed_ranges(places: DataFrame, lows: DataFrame, window: int) -> DataFrame:
    """doc, mark, spans: the maximal ranges of units that windows of lower documents cover."""
    shape = "doc bigint, mark bigint, spans array<struct<begin: bigint, end: bigint>>"

    def ranges(loads: pa.Table, answers: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        if not len(loads) or not len(answers):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], ["doc", "mark", "spans"])
        number, doc, mark, at = unpacked(loads.column("content")[0].as_py())
        own, n, lows = (np.concatenate(x) for x in zip(*(unpacked(b.as_py()) for b in answers.column("content"))))
        n = n.astype(np.int64)
        count, begin = np.zeros((2, int(number.max()) + 1), np.int64)
        count[own], begin[own] = n, np.cumsum(n) - n
        hit = np.flatnonzero(count[number])
        each = count[number[hit]]
        run = np.repeat(hit, each)
        within = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
        gone = lows[np.repeat(begin[number[hit]], each) + within] < doc[run]
        run, start = run[gone], (at[run] + within)[gone]
        # Windows of one text in order; a new range begins where the last one does not reach.
        order = np.lexsort((start, mark[run], doc[run]))
        run, start = run[order], start[order].astype(np.int64)
        if not len(run):
            return ranges(loads.slice(0, 0), answers)
        text = np.ones(len(run), bool)
        text[1:] = (doc[run][1:] != doc[run][:-1]) | (mark[run][1:] != mark[run][:-1])
        new = text.copy()
        new[1:] |= start[1:] > start[:-1] + window
        first = np.flatnonzero(new)
        begins, ends = start[first], start[np.append(first[1:], len(start)) - 1] + window
        heads = np.flatnonzero(text)
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first, heads), len(first)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["begin", "end"]))
        return pa.table([pa.array(doc[run][heads]), pa.array(mark[run][heads]), lists], ["doc", "mark", "spans"])

    met = places.select("load", "content").groupBy("load").cogroup(lows.select("load", "content").groupBy("load")).applyInArrow(ranges, shape)
    return met.dropDuplicates(["doc", "mark"])  # one row for texts repeated under one id


def remove_repeats(docs: DataFrame, doc_id: str, text: str, window: int, extract: Extract, anchors, fingerprint, solve: Solve, kept) -> DataFrame:
    """The whole plan; ``kept(text bytes, begins, ends)`` gives (units, removed, kept bytes) of one text.

    Columns: doc_id, n_units, n_removed, spans (maximal removed ranges of units), kept (binary).
    """
    scratch = Scratch(docs.sparkSession)
    texts = identified(docs, doc_id, text)
    runs = travelling(texts, extract, repeated_anchors(texts, anchors), fingerprint)
    found = scratch.keep(lowest_documents(runs, solve))
    spans = removed_ranges(found.where("not answer"), found.where("answer"), window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, doc, spans in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                begins = ends = np.zeros(0, np.int64)
                if spans.is_valid:
                    begins, ends = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                n, removed, rest = kept(value.as_buffer().to_pybytes(), begins, ends)
                out.append((None if doc == NO_ID else doc, n, removed, [{"begin": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist())], rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["doc_id", "n_units", "n_removed", "spans", "kept"])

    return texts.join(spans, ["doc", "mark"], "left").select("text", "doc", "spans").mapInArrow(
        finish, "doc_id bigint, n_units bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")
