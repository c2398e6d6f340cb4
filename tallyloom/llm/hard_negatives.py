"""Hard negatives by exact inner products, pruned coordinate by coordinate inside buckets of similar length.

Rows are sorted by length and packed into *buckets*: a matrix, and for every coordinate the order of its values after
dividing by length.  An anchor that still needs a score of at least s from a bucket of lengths up to m needs a cosine of at
least t = s / (|anchor| m).  For each of its *focus coordinates*, those in which it is largest, the angle between a row
and that axis can then differ from the anchor's own by no more than arccos t.  That is a feasible range of the coordinate, a
slice of its sorted list; only rows in the slices of all focus coordinates are multiplied.  s rises while buckets are
visited, and a bucket whose t exceeds 1 is left out.

Two passes have this shape: the best rows of the anchor's own label, then for each of those the best rows of other labels
inside its score window.  Anchors travel in blocks to the buckets, each bucket exists once per pass, and what comes back is
a short list per anchor, so nothing grows with a label's or a bucket's size and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import packed, unpacked
from .tables import Scratch

#: Rows of a bucket, anchors of a block, and focus coordinates of an anchor.
BUCKET, BLOCK, FOCUS = 1024, 512, 4

#: Sums of products below this are exact in double precision.
EXACT = 2.0**52


def _narrow(matrix: np.ndarray) -> np.ndarray:
    top = int(max(abs(int(matrix.min())), abs(int(matrix.max())))) if matrix.size else 0
    return matrix.astype(next((t for t in (np.int8, np.int16, np.int32) if top < np.iinfo(t).max), np.int64))


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(float) ** 2).sum(1))


class Bucket:
    """Rows of similar length with a sorted list per coordinate."""

    def __init__(self, blob: bytes) -> None:
        self.id, self.tie, self.label, flat, order = unpacked(blob)
        self.matrix = flat.reshape(len(self.id), -1)
        self.order = order.reshape(self.matrix.shape[1], -1)
        self.lengths = _lengths(self.matrix)
        self.longest = float(self.lengths.max())
        self.unit = self.matrix / np.maximum(self.lengths, 1e-300)[:, None]
        self.values = np.take_along_axis(self.unit.T, self.order.astype(np.int64), 1)
        self.place = np.empty(len(self.id), np.int64)
        self.place[np.lexsort((self.tie, self.id))] = np.arange(len(self.id))
        self.floats = self.matrix.astype(float)
        self.largest = float(np.abs(self.floats).max())

    @staticmethod
    def blob(id_: np.ndarray, tie: np.ndarray, label: np.ndarray, matrix: np.ndarray) -> bytes:
        unit = matrix / np.maximum(_lengths(matrix), 1e-300)[:, None]
        return packed(id_, tie, label, _narrow(matrix).ravel(), np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16).ravel())

    def candidates(self, anchor: np.ndarray, length: float, least: float, focus: np.ndarray) -> np.ndarray:
        """Rows that may reach the score ``least``."""
        rows = len(self.id)
        if least <= 0 or length == 0:
            return np.arange(rows)
        # A hair's breadth more room than the exact range, for the rounding of lengths and angles.
        cosine = least / (length * self.longest) * (1 - 1e-9) if self.longest else np.inf
        if cosine > 1:
            return np.zeros(0, np.int64)
        reach, inside, asked = np.arccos(cosine) + 1e-7, np.zeros(rows, np.uint8), 0
        for f in focus:
            own = np.arccos(np.clip(anchor[f] / length, -1, 1))
            low, high = np.cos(min(own + reach, np.pi)), np.cos(max(own - reach, 0.0))
            begin = np.searchsorted(self.values[f], low - 1e-9, "left")
            end = np.searchsorted(self.values[f], high + 1e-9, "right")
            if end - begin < rows:
                inside[self.order[f, begin:end]] += 1
                asked += 1
        return np.flatnonzero(inside == asked) if asked else np.arange(rows)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond 64 bits they stop at the largest number of 64 bits."""
        if self.largest * float(np.abs(anchor.astype(float)).max()) * len(anchor) < EXACT:
            if 2 * len(rows) > len(self.id):
                return (self.floats @ anchor.astype(float)).astype(np.int64)[rows]
            return (self.floats[rows] @ anchor.astype(float)).astype(np.int64)
        exact = self.matrix[rows].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


class _Best:
    """The best (score, id, tie) of one anchor's windows so far; a window is a least and a greatest score."""

    def __init__(self, windows: list[tuple[int, int]], k: int) -> None:
        self.windows, self.k = windows, k
        self.kept: list[list[tuple[int, int, int]]] = [[] for _ in windows]

    def least(self) -> int:
        """No lower score can change anything."""
        return min(max(low, -kept[-1][0] if len(kept) == self.k else low) for (low, _), kept in zip(self.windows, self.kept))

    def offer(self, score: np.ndarray, bucket: Bucket, rows: np.ndarray) -> None:
        for w, (low, high) in enumerate(self.windows):
            kept = self.kept[w]
            floor = max(low, -kept[-1][0]) if len(kept) == self.k else low
            at = np.flatnonzero((score >= floor) & (score <= high))
            if not len(at):
                continue
            if len(at) > 4 * self.k:
                bound = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= bound]
            at = at[np.lexsort((bucket.place[rows[at]], -score[at]))][: self.k]
            found = [(-int(score[i]), int(bucket.id[rows[i]]), int(bucket.tie[rows[i]])) for i in at]
            self.kept[w] = sorted(kept + found)[: self.k]


#: An anchor that has no window yet takes every score.
ANY = ((-(1 << 63),), ((1 << 63) - 1,))


def _blocks(rows: DataFrame, size: int, number_of_rows: int) -> DataFrame:
    """number, content: rows in the order of length, ``size`` at a time; buckets, or blocks of anchors with their windows."""
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(shuffled, -(-number_of_rows // size)))
    asking = "lows" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, []

        def emit(table: pa.Table) -> pa.RecordBatch:
            matrix = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            own = [table.column(c).to_numpy() for c in ("id", "tie", "label")]
            if asking:
                lows, highs = (table.column(c).combine_chunks() for c in ("lows", "highs"))
                blob = packed(*own, _narrow(matrix).ravel(), lows.flatten().to_numpy(), highs.flatten().to_numpy(), lows.value_lengths().to_numpy().astype(np.int32))
            else:
                blob = Bucket.blob(*own, matrix)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["number", "content"])

        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= size:
                table = pa.Table.from_batches(waiting)
                yield emit(table.slice(0, size))
                number, waiting = number + 1, table.slice(size).to_batches()
        if sum(b.num_rows for b in waiting):
            yield emit(pa.Table.from_batches(waiting))

    order = (F.desc("length"), "id", "tie")
    columns = ["id", "tie", "label", "v", *(["lows", "highs"] if asking else [])]
    ordered = rows.select(*columns, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select(*columns).mapInArrow(pack, "number bigint, content binary")


def _search(buckets: DataFrame, blocks: DataFrame, same_label: bool, k: int, focus: int) -> DataFrame:
    """anchor, anchor_tie, window, score, id, tie: what each part of the buckets has to offer each anchor's windows."""
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, best = None, None, []

        def answers() -> pa.RecordBatch:
            out = [(int(anchors[0][a]), int(anchors[1][a]), w, -s, i, t) for a, b in enumerate(best) for w, kept in enumerate(b.kept) for s, i, t in kept]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], ["anchor", "anchor_tie", "window", "score", "id", "tie"])

        for batch in batches:
            for block, asked, content in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block != now:
                    if best:
                        yield answers()
                    now, anchors = block, unpacked(asked.as_py())
                    lows, highs, counts = anchors[4:]
                    matrix = anchors[3].reshape(len(anchors[0]), -1).astype(np.int64)
                    lengths, ends = _lengths(matrix), np.cumsum(counts)
                    axes = np.argsort(-np.abs(matrix.astype(float)), axis=1, kind="stable")[:, :focus]
                    best = [_Best(list(zip(lows[e - n : e].tolist(), highs[e - n : e].tolist())), k) for e, n in zip(ends, counts)]
                bucket = Bucket(content.as_py())
                for a in range(len(best)):
                    rows = bucket.candidates(matrix[a], lengths[a], best[a].least(), axes[a])
                    if not len(rows):
                        continue
                    own = bucket.label[rows] == anchors[2][a]
                    if same_label:
                        own &= (bucket.id[rows] != anchors[0][a]) | (bucket.tie[rows] != anchors[1][a])
                    rows = rows[own if same_label else ~own]
                    if len(rows):
                        best[a].offer(bucket.scores(rows, matrix[a]), bucket, rows)
        if best:
            yield answers()

    # Buckets are dealt by number, so that every part has long and short ones; blocks go to all parts.
    part = F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")
    dealt = buckets.select(part.alias("part"), "content")
    asking = blocks.select(F.col("number").alias("block"), F.col("content").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = asking.join(dealt, "part").select("block", "asked", "content")
    return met.mapInArrow(visit, "anchor bigint, anchor_tie bigint, window int, score bigint, id bigint, tie bigint")


def mine(vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, focus: int = FOCUS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, and v (array of whole numbers); anchors are the rows with ``asked``, a condition on
    ``vec_id``.  A score is the exact inner product with the anchor; higher ones come first, ties by smaller id.  An anchor's
    positives are its first ``positives`` other rows of the same label; for each of them the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score`` come back, all if fewer.

    Rows take no part if id, label, vector or any component is null, if the vector is empty, or if its size is not the most
    frequent one (the larger, of equally frequent ones).  Rows equal in id, label and vector count once; other rows with one
    id are rows of their own, ties between them go by a hash of label and vector.  A positive with a negative score admits
    nothing, one with score 0 only scores of 0.  Scores beyond 64 bits stop at the largest number.  An empty table, one
    label only, or anchors without positives give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where("id is not null and label is not null and size(v) > 0 and not exists(v, x -> x is null)")
    rows = scratch.keep(rows.withColumn("tie", F.xxhash64("label", "v")).dropDuplicates(["id", "tie"]).withColumn("length", F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.where(F.size("v") == (widths["width"] if widths else 0))
    total = widths["count"] if widths else 0
    buckets = scratch.keep(_blocks(rows, BUCKET, total))
    blocks = scratch.keep(_blocks(rows.where("asked").withColumns({name: F.array(*map(F.lit, x)).cast("array<bigint>") for name, x in zip(("lows", "highs"), ANY)}), BLOCK, total))
    first = Window.partitionBy("anchor", "anchor_tie", "window").orderBy(F.desc("score"), "id", "tie")
    lists = _search(buckets, blocks, True, positives, focus)
    found = scratch.keep(lists.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives).select("anchor", "anchor_tie", "place", "score", "id", "tie"))

    # Each positive opens a window of scores; 50 * s <= 100 * x <= 95 * s holds for whole x from ceil(50 s / 100) to floor(95 s / 100).
    bound = "cast({}(cast(score as decimal(20, 0)) * {} / 100) as bigint)"
    windows = found.where("score >= 0").select("anchor", "anchor_tie", F.struct("place", F.expr(bound.format("ceil", low)).alias("low"), F.expr(bound.format("floor", high)).alias("high")).alias("w"))
    windows = windows.where("w.low <= w.high").groupBy("anchor", "anchor_tie").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    open_ = rows.where("asked").join(windows, (F.col("id") == F.col("anchor")) & (F.col("tie") == F.col("anchor_tie"))).withColumns({"lows": F.col("windows.low"), "highs": F.col("windows.high")})
    asking = scratch.keep(_blocks(open_, BLOCK, total))
    lists = _search(buckets, asking, False, negatives, focus)
    ranked = lists.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    # Windows are numbered in the order of places among those that are open.
    places = windows.select("anchor", "anchor_tie", F.posexplode("windows").alias("window", "w")).select("anchor", "anchor_tie", "window", F.col("w.place").alias("place"))
    of = found.select("anchor", "anchor_tie", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = ranked.join(places.join(of, ["anchor", "anchor_tie", "place"]), ["anchor", "anchor_tie", "window"])
    return named.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

