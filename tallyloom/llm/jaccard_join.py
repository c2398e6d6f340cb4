"""Near duplicates by an exact Jaccard join of word n-gram sets in metric space.

The Jaccard distance is a metric, and so is the size of the symmetric difference.  Two kinds of pivots divide the sets:

*Shingle pivots.*  Whole documents are useless as first pivots here: nearly every document is at distance exactly 1
from any sampled one, and the triangle inequality then replicates it to all regions.  A set of one shingle is a point of
the same space, at distance 1 - 1/n from the sets that hold it and 1 from all others; ties among the shingles of a set
are broken by one global order (hashed, very frequent shingles last).  A document's Voronoi region is its first shingle.
The window follows from the triangle inequality on symmetric differences: a set within the radius misses at most
``n - ceil(t n)`` shingles of this one, so a boundary document is replicated to that many regions and one more, and to
no others.  Linked documents meet in a region.

*Document pivots.*  Groups of near copies fill whole regions, and most of their members are near, but not near enough, to each
other: comparing them pair by pair grows with the square of the group.  So a region that holds many documents with the same
few smallest hashes gets a document as pivot, the one in their middle.  The *exact difference* of every member to it is
measured and kept.  Members in its ball are linked to it.  The others of its cell recurse: they are joined as sets of
their differences, since what two documents share with the pivot cancels out.  By the triangle inequality their distance is
at most the sum of their differences, and it is small enough for a link only if the differences share a known number of
shingles; so the join takes prefixes of differences, the rarest shingles first, and copies with edits of their own meet
nowhere.  Boundary documents, outside the cell but within the radius of it, take part on one side.  A cell's documents have
then found all their links in that region and leave it.  This goes on until no region holds such a group
or a round settles next to nothing; what is left is compared directly.

The same inequality spares most distances: the hash slices of the universe are pivots too, and the difference of two
documents' distances to them, summed up (the difference of their shingle counts by slice), is at most the size of their
symmetric difference.  Regions hold ids, sizes and 16 such counts, a list of 64 is compared next, then the parities of
the shingles by slot, four slots and more a shingle: as many bits differ as slots hold an odd number of the symmetric
difference, which is nearly its size and never more.  Only what is left is measured on the texts.  Copies with one set are one document from the start.  A document is a text under an id; repeated
and null ids say nothing about likeness, so the sets are numbered and the numbers are joined, never the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import AnchorFilter, repeated_anchors
from .tables import Scratch, arrow_batches, filter_by_key, row_key, text_mark
from .texts import LOWER, SLICE_BYTES, block_hash, mix, slices, words

#: Words of a shingle, and the similarity in percent from which two documents link.
SHINGLE, PERCENT = 3, 90

#: A shingle goes to the end of the order when it holds this share of its bucket.
FREQUENT_SHARE = 0.001

#: Hash slices whose shingles are counted per document: as 64 bytes, and as 16 bytes for the join of a region.
SLICES, FEW = 64, 16

#: Members of a region with one likeness key from which they get a document as pivot; smallest hashes in the key.
CROWD, SMALLEST = 16, 4

#: Slots of a set's parities per shingle at least (a power of two), and at most for one set.
SLOTS, MOST_SLOTS = 4, 1 << 20

#: Bytes of an Arrow batch, which the JVM and a Python worker hold at once and more than once.
BATCH_BYTES = 4 << 20

#: Differences to a pivot are kept up to this share of both sets, in percent.
WINDOW = 60


_ODDS = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every n-gram of lower-cased words; a shorter text is one gram, one without words none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = block_hash(data, starts, ends)
    counts = np.diff(first)
    size = np.minimum(counts, n)
    grams = np.maximum(counts - n + 1, counts > 0)
    row = np.repeat(np.arange(len(counts)), grams)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    total = np.zeros(len(row), np.uint64)
    for k in range(n):
        inside = k < size[row]
        total[inside] = total[inside] * np.uint64(0x9FB21C651E98DF25) + hashes[at[inside] + k] + np.uint64(1)
    return row, mix(total)


def distinct_in_order(row: np.ndarray, gram: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles in the global order: frequent ones last, then by hash."""
    order = np.lexsort((gram, late, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many regions a set of n shingles goes to."""
    return n - (percent * n + 99) // 100 + 1


def _first(row: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the regions' shingles among sorted rows, their index in the set, and the size of each row's set."""
    n = np.bincount(row, minlength=rows)
    take = np.where(n > 0, _prefix(n, percent), 0)
    begin = np.cumsum(n) - n
    index = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    return np.repeat(begin, take) + index, index, n


def _assign(texts: DataFrame, size: int, percent: int, filters: Broadcast) -> DataFrame:
    """doc, mark, n, low, high (128 bits of the set), counts by slice, regions and places: the shingle pivots that others have too."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, known = (AnchorFilter(x) for x in filters.value)
        for batch in batches:
            for at, data, offsets in slices(batch.column(0)):
                row, gram = shingles(data, offsets, size)
                row, gram = distinct_in_order(row, gram, late.is_hot(gram))
                rows = len(offsets) - 1
                place, index, n = _first(row, rows, percent)
                some = np.flatnonzero(n)
                marks, likeness = np.zeros((2, rows), np.uint64), np.zeros(rows, np.uint64)
                if len(some):
                    heads = (np.cumsum(n) - n)[some]
                    for k in (0, 1):
                        marks[k, some] = np.add.reduceat(mix(gram ^ np.uint64(0x1234567 + 0x9E3779B97F4A7C15 * k)), heads)
                    for odd in _ODDS[:SMALLEST]:
                        likeness[some] = mix(likeness[some] + np.minimum.reduceat(gram * odd, heads))
                slices_ = np.bincount(row * SLICES + (gram >> np.uint64(58)).astype(np.int64), minlength=rows * SLICES).reshape(rows, SLICES)
                counts = np.minimum(slices_, 255).astype(np.uint8)
                few = np.minimum(slices_.reshape(rows, FEW, -1).sum(2), 255).astype(np.uint8).view(np.int64)
                lists = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * SLICES), pa.py_buffer(counts.tobytes())])
                passes = known.passes(gram[place])
                place, index = place[passes], index[passes]
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row[place], minlength=rows))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(at, rows), batch.column(2).slice(at, rows), pa.array(n.astype(np.int64)), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), lists, pa.array(few[:, 0].copy()), pa.array(few[:, 1].copy()), pa.array(likeness.view(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(gram[place].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32)))],
                    ["doc", "mark", "n", "low", "high", "counts", "few_0", "few_1", "likeness", "regions", "places"])

    return texts.select("text", "doc", "mark").mapInArrow(assign, "doc bigint, mark bigint, n bigint, low bigint, high bigint, counts binary, few_0 bigint, few_1 bigint, likeness bigint, regions array<bigint>, places array<int>")


def _close(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose counts by slice do not rule a link out."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLICES).astype(np.int64) for k in (4, 5))
            keep = pa.array((100 + percent) * np.abs(a - b).sum(1) <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = counts.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("counts_a"))
    right = counts.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("counts_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(compare, "a bigint, b bigint")


def _sets(part: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the texts of a column, each shingle of a row once, in order."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at, data, offsets in slices(part.column(column)):
        row, gram = shingles(data, offsets, size)
        row, gram = distinct_in_order(row, gram, np.zeros(len(row), bool))
        found.append((row + at, gram))
    row, gram = (np.concatenate(x) for x in zip(*found))
    return row, gram


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows (a, b, text_a, text_b) whose texts together stay below ``SLICE_BYTES``, unless one row alone holds more.

    The rows of a pivot stand together, so if its text is long, those of all rows near it are.
    """
    ends = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)))
    first, before = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first, before = last, int(ends[last - 1])


def _differences(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in both texts of a row and in either, and (row, shingle) of what only one of them has."""
    row, gram = (np.concatenate(x) for x in zip(*(_sets(part, column, size) for column in (2, 3))))
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    twice = np.zeros(len(row) + 1, bool)
    twice[1:-1] = (row[1:] == row[:-1]) & (gram[1:] == gram[:-1])
    both = np.bincount(row[twice[:-1]], minlength=part.num_rows)
    alone = ~(twice[:-1] | twice[1:])
    return both, np.bincount(row, minlength=part.num_rows) - both, row[alone], gram[alone]


#: (ids as ``doc``) -> text, doc of those sets
Texts = Callable[[DataFrame], DataFrame]


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b."""
    left = texts.join(pairs.select(F.col("a").alias("doc")).distinct(), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    # Pivots (a) are few and may be hot; the other side is fetched first, so that only ids cross before texts do.
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def parities(row: np.ndarray, gram: np.ndarray, rows: int) -> list[bytes]:
    """A bit per slot of each row's set: whether an odd number of its shingles fall there."""
    n = np.bincount(row, minlength=rows)
    slots = np.minimum(1 << np.ceil(np.log2(np.maximum(SLOTS * n, 64))).astype(np.int64), MOST_SLOTS)
    end = np.cumsum(slots)
    place = (end - slots)[row] + (gram & (slots[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=slots.sum()) & 1).astype(bool), bitorder="little").tobytes()
    return [odd[e - k : e] for e, k in zip((end // 8).tolist(), (slots // 8).tolist())]


def least_apart(one: bytes, other: bytes) -> int:
    """Slots in which the parities differ, at most the size of the symmetric difference; the longer list is folded to the shorter."""
    if len(one) < len(other):
        one, other = other, one
    a, b, half = int.from_bytes(one, "little"), int.from_bytes(other, "little"), 4 * len(one)
    while half >= 8 * len(other):
        a, half = (a >> half) ^ (a & ((1 << half) - 1)), half // 2
    return (a ^ b).bit_count()


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """doc, n, odd: the parities of each set."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(0)):
                rows = len(offsets) - 1
                row, gram = shingles(data, offsets, size)
                row, gram = distinct_in_order(row, gram, np.zeros(len(row), bool))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, rows), pa.array(np.bincount(row, minlength=rows)), pa.array(parities(row, gram, rows), pa.binary())], ["doc", "n", "odd"])

    return texts.select("text", "doc").mapInArrow(sketch, "doc bigint, n bigint, odd binary")


def _nearly(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose parities do not rule a link out; the parities travel, not the texts."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.fromiter(map(least_apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            keep = pa.array((100 + percent) * apart <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left, right = (sketches.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(compare, "a bigint, b bigint")


def _linked(pairs: DataFrame, texts_of: Texts, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those (a, b) whose texts reach the similarity, measured on their whole sets."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                both, every, _, _ = _differences(part, size)
                keep = pa.array((100 * both >= percent * every) & (every > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    texts = texts_of(_ids(pairs))
    sketches = scratch.keep(_sketches(texts, size))
    near = scratch.keep(_nearly(pairs, sketches, percent))
    some = texts.join(_ids(near), "doc", "left_semi").select("text", "doc")
    links = scratch.keep(_with_texts(near, some).mapInArrow(measure, "a bigint, b bigint").distinct(), near.count())
    scratch.free(texts, sketches, near)
    return links


def _apart(pairs: DataFrame, texts_of: Texts, size: int) -> DataFrame:
    """a (a pivot), b, total (sizes of both), apart (size of the symmetric difference) and its shingles; pairs beyond the window go.

    A difference is packed, eight bytes a shingle, and its shingles are named anew for each pivot, one to one.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                both, every, row, gram = _differences(part, size)
                apart, total = every - both, every + both
                near = 100 * apart <= WINDOW * total
                only = near[row]
                counts = np.bincount(row[only], minlength=part.num_rows)[near]
                names = mix(gram[only] ^ mix(part.column(0).to_numpy().view(np.uint64))[row[only]])
                ends = np.append(0, np.cumsum(8 * counts)).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(names.tobytes())])
                keep = pa.array(near)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(total[near]), pa.array(apart[near]), lists], ["a", "b", "total", "apart", "difference"])

    return _with_texts(pairs, texts_of(_ids(pairs))).mapInArrow(measure, "a bigint, b bigint, total bigint, apart bigint, difference binary")


def _pivots(active: DataFrame, scratch: Scratch) -> DataFrame:
    """region, p, n_p: for the largest crowd of every region that has one, the document in the middle of all with its key.

    Copies of one origin, each with edits of its own, lie about the origin, so the mean of their counts by slice is near the
    origin's, and so is the document whose counts are nearest to it.  Crowds of one key have one pivot in all regions, so
    that a group is measured once; it need not lie in the region.  Any choice gives the same links.
    """
    crowds = active.groupBy("region", "likeness").agg(F.count("*").alias("rows")).where(F.col("rows") >= CROWD)
    largest = scratch.keep(crowds.groupBy("region").agg(F.max(F.struct("rows", "likeness")).alias("most")).select("region", F.col("most.likeness").alias("likeness")))
    members = active.join(largest.select("likeness").distinct(), "likeness", "left_semi").select("likeness", "rep", "n", "few_0", "few_1").distinct()
    slices_ = [F.expr(f"(few_{k} >> {8 * b}) & 255") for k in (0, 1) for b in range(8)]
    means = members.groupBy("likeness").agg(*(F.avg(x).alias(f"mean_{i}") for i, x in enumerate(slices_)))
    off = reduce(lambda x, y: x + y, (F.abs(x - F.col(f"mean_{i}")) for i, x in enumerate(slices_)))
    near = members.join(means, "likeness").groupBy("likeness").agg(F.min(F.struct(off.alias("off"), "rep", "n")).alias("middle"))
    return scratch.keep(largest.join(near, "likeness").select("region", F.col("middle.rep").alias("p"), F.col("middle.n").alias("n_p")))


def _packed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of packed differences."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 8), np.frombuffer(data.tobytes(), np.uint64)


def _met(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``own`` (how many shingles of a difference surely no other difference to the pivot holds) and ``shared`` (the others)."""
    repeated = repeated_anchors(known.select(F.col("difference").alias("text")), _packed)
    state = known.sparkSession.sparkContext.broadcast(repeated.state)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = AnchorFilter(state.value)
        for batch in batches:
            for at, data, offsets in slices(batch.column(0)):
                rows = len(offsets) - 1
                row, gram = _packed(data, offsets)
                passes = others.passes(gram)
                counts = np.bincount(row[passes], minlength=rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(gram[passes].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, rows) for c in batch.columns[1:]), pa.array(np.diff(offsets) // 8 - counts), lists], [*batch.schema.names[1:], "own", "shared"])

    out = scratch.keep(known.select("difference", "p", "b", "apart", "over", "ball", "cell").mapInArrow(
        divide, "p bigint, b bigint, apart bigint, over bigint, ball boolean, cell boolean, own bigint, shared array<bigint>"))
    state.destroy()
    return out


def _asked(known: DataFrame, held: DataFrame | None, percent: int) -> DataFrame:
    """Documents whose prefix holds shingles of others, with ``alone`` (shingles of their own) and ``take`` (those of others).

    The rest meet nobody.  Two in the ball need not meet, as the pivot links them, nor two outside the cell, as neither is
    done here.  Linked documents are no farther from each other than a link allows, so one of them is too near the pivot,
    or too far from it, if no possible other is as far (``far``: the largest ``over`` that one linked to it can have).
    """
    far = f"{2 * (100 + percent)} * apart - over"
    bounds = known.groupBy("p").agg(
        F.min("over").alias("least"), F.min(F.when(~F.col("ball"), F.col("over"))).alias("least_out"), F.min(F.when(F.col("cell"), F.col("over"))).alias("least_in"),
        F.max(F.expr(far)).alias("most"), F.max(F.when(~F.col("ball"), F.expr(far))).alias("most_out"), F.max(F.when(F.col("cell"), F.expr(far))).alias("most_in"))
    low, high = (f"if(ball, {x}_out, if(cell, {x}, {x}_in))" for x in ("least", "most"))
    asked = known.join(bounds, "p").where(f"{low} <= {far} and over <= {high}")
    alone = F.col("own")
    if held is not None:
        asked = asked.join(held.where("held = 1").groupBy("p", "b").agg(F.count("*").alias("single")), ["p", "b"], "left")
        alone = alone + F.coalesce("single", F.lit(0))
    need = f"greatest(1, ceil((over + {low}) / (2 * {100 + percent})))"
    asked = asked.withColumn("alone", alone).withColumn("take", F.expr(f"cast(apart - {need} + 1 - alone as int)"))
    return asked.where("take > 0").select(*known.columns, "alone", "take")


def _cells(active: DataFrame, pivots: DataFrame, texts_of: Texts, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: links to pivots, candidate pairs inside the cells, and (region, rep) of the documents that are done there."""
    met = scratch.keep(active.join(pivots, "region").where(f"rep <> p and least(n, n_p) * {100 + WINDOW} >= greatest(n, n_p) * {100 - WINDOW}").select("region", "p", "rep"))
    measured = scratch.keep(_apart(met.select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct(), texts_of, size))
    # x in the cell (apart_x <= C (n_x + n_p)) and y linked to it: apart_y <= apart_x + (n_x + n_y) (1 - t) / (1 + t), and n_x <= n_y / t.
    # With C = t W - (1 - t) that is within the window W (n_y + n_p), for a similarity of t.
    cell = f"100 * 100 * apart <= {percent * WINDOW - 100 * (100 - percent)} * total"
    # Two documents link if 2 (100 + percent) times what their differences share is at least the sum of ``over``.
    known = measured.withColumnRenamed("a", "p").join(pivots.select("p", "n_p").distinct(), "p").withColumn("n", F.col("total") - F.col("n_p")).select(
        "p", "b", "apart", F.expr(f"{100 + percent} * apart - {100 - percent} * n").alias("over"), "difference", F.expr(f"{100 + percent} * apart <= {100 - percent} * total").alias("ball"), F.expr(cell).alias("cell"))
    known = scratch.keep(known)

    # Differences as sets of their own, rarest shingles first; those of one document only come before all others.
    met_others = _met(known, scratch)
    open_ = scratch.keep(_asked(met_others, None, percent).drop("alone", "take"))
    held = scratch.keep(open_.select("p", "b", F.explode("shared").alias("shingle")).groupBy("p", "shingle").agg(F.count("*").alias("held"), F.min("b").alias("b")))
    asked = scratch.keep(_asked(open_, held, percent))
    each = ["p", "b", "apart", "over", "ball", "cell", "alone", "take"]
    shared = asked.select(*each, F.explode("shared").alias("shingle")).join(held.where("held > 1").drop("b"), ["p", "shingle"])
    ordered = shared.groupBy(*each).agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    entries = scratch.keep(ordered.select(*each, F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("at", "s")).select(
        "p", "b", "apart", "over", "ball", "cell", (F.col("at") + F.col("alone")).alias("at"), F.col("s.shingle").alias("shingle")))
    scratch.free(met_others, open_, held, asked)
    other = entries.select("p", "shingle", *(F.col(c).alias(f"{c}_2") for c in ("b", "apart", "over", "ball", "cell", "at")))
    # What follows the shingle where two differences meet first must still hold the shingles that a link needs them to share.
    reach = f"2 * {100 + percent} * (1 + least(apart - at - 1, apart_2 - at_2 - 1)) >= over + over_2"
    found = entries.where("cell").join(other, ["p", "shingle"]).where(f"b <> b_2 and (b < b_2 or not cell_2) and not (ball and ball_2) and {reach}")
    pairs = found.select(F.least("b", "b_2").alias("a"), F.greatest("b", "b_2").alias("b")).distinct()
    links = known.where("ball").select(F.col("p").alias("a"), "b")
    done = met.join(known.where("cell").select("p", F.col("b").alias("rep")), ["p", "rep"]).select("region", "rep")
    own = pivots.select("region", F.col("p").alias("rep"))  # where the pivot is a member, it is done
    return links, pairs, scratch.keep(done.unionByName(own).distinct())


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (the smallest id reachable by links, itself included), mark and kept.

    A document's set holds the distinct n-grams of its words (A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+`` of the
    whole text); with fewer words the whole sequence is one shingle; without words, or null, it is empty and linked with
    nothing.  Two documents link when 100 * intersection >= percent * union.  A document is known by
    its id and a hash of its text: different texts under one id, or under none, are different documents, compared like any
    others.  Null ids come after all others.  ``kept`` marks the first document of each component (by id, then mark), in
    all rows that repeat it.  Shingles are compared by 64-bit
    hashes; documents with one set (128 bits and its size) are one document, the first of them.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):  # all that Python works on is written in here
        return _joined(docs, doc_id, text, size, percent)


def _joined(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("bigint").alias("doc"), text_mark(text).alias("mark"))
    key = row_key(F.col("doc"), F.col("mark"))

    def regions_by(late: AnchorFilter | None):
        state = late.state if late else None

        def anchors(data, offsets):
            row, gram = shingles(data, offsets, size)
            row, gram = distinct_in_order(row, gram, AnchorFilter(state).is_hot(gram) if state else np.zeros(len(row), bool))
            place, _, _ = _first(row, len(offsets) - 1, percent)
            return row[place], gram[place]

        return anchors

    frequent = repeated_anchors(texts, regions_by(None), FREQUENT_SHARE).only_hot()
    repeated = repeated_anchors(texts, regions_by(frequent), FREQUENT_SHARE)
    filters = spark.sparkContext.broadcast((frequent.state, repeated.state))
    rows = scratch.keep(_assign(texts, size, percent, filters))
    filters.destroy()
    empty = scratch.keep(rows.where("n = 0").select("doc", "mark", "n"))
    heads = scratch.keep(rows.where("n > 0").groupBy("n", "low", "high").agg(F.min(key).alias("head")))
    # Sets are numbered in the order of their first documents, so that the smallest number has the smallest id.
    classes = scratch.keep(heads.sort("head").withColumn("rep", F.monotonically_increasing_id()))
    known = scratch.keep(rows.where("n > 0").join(classes, ["n", "low", "high"]).select("doc", "mark", "n", "rep", "head", "counts", "few_0", "few_1", "likeness", "regions", "places"))
    scratch.free(rows, heads)
    heads = known.where(key == F.col("head"))

    # One row per set, however often its first document is repeated, so a region has a set once.
    members = heads.select("n", "rep", "few_0", "few_1", "likeness", "regions", "places").dropDuplicates(["rep"])
    members = members.select("n", "rep", "few_0", "few_1", "likeness", F.explode(F.arrays_zip("regions", "places")).alias("r"))
    members = members.select(F.col("r.regions").alias("region"), "rep", "n", "few_0", "few_1", "likeness", F.col("r.places").alias("place"))
    active = scratch.keep(_several(members.withColumn("component", F.col("rep")), "rep", scratch))
    links: list[DataFrame] = []
    wanted = scratch.keep(active.select(F.col("rep").alias("doc")).distinct())
    counts = scratch.keep(heads.select(F.col("rep").alias("doc"), "n", "counts").join(wanted, "doc", "left_semi").dropDuplicates(["doc", "n", "counts"]))
    whole, known = known, scratch.keep(known.select("doc", "mark", "n", "rep", "head"))
    scratch.free(whole, wanted)

    def sets(ids: DataFrame) -> DataFrame:
        some = known.where(key == F.col("head")).select("head", "rep").join(ids.withColumnRenamed("doc", "rep"), "rep", "left_semi")
        return scratch.keep(_texts_of(some, texts.select("text", key.alias("head")), scratch))

    # Sizes, and counts by slice: both differ by no more than the symmetric difference of linked sets.
    apart = " + ".join(f"abs(((few_{k} >> {8 * b}) & 255) - ((few_{k}_p >> {8 * b}) & 255))" for k in (0, 1) for b in range(8))
    admitted = f"least(n, n_p) * 100 >= {percent} * greatest(n, n_p) and (100 + {percent}) * ({apart}) <= (100 - {percent}) * (n + n_p)"
    ours = [F.col("rep").alias("p"), F.col("n").alias("n_p"), F.col("few_0").alias("few_0_p"), F.col("few_1").alias("few_1_p"), F.col("component").alias("component_p")]
    while not active.isEmpty():
        pivots = _pivots(active, scratch)
        if pivots.isEmpty():
            break
        to_pivots, pairs, done = _cells(active, pivots, sets, size, percent, scratch)
        close = scratch.keep(_close(pairs, counts, percent))
        links += [scratch.keep(to_pivots), _linked(close, sets, size, percent, scratch)]
        before, last, active = active.count(), active, scratch.keep(_several(active.join(done, ["region", "rep"], "left_anti"), "component", scratch))
        scratch.free(last)
        if 100 * (before - active.count()) < before:  # such a round costs more than comparing what it settles
            break

    if not active.isEmpty():
        # All links so far, joined up, so that what they connect is not compared again.
        reached = components(reduce(DataFrame.unionByName, links), scratch) if links else active.select(F.col("rep").alias("node"), "component").limit(0)
        last, active = active, active.drop("component").join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        active = scratch.keep(_several(active, "component", scratch))
        scratch.free(last)
        other = active.select("region", *ours, F.col("place").alias("place_p"))
        # In the first region two linked sets share, what follows must still hold the intersection they need.
        reach = f"(100 + {percent}) * (1 + least(n - place - 1, n_p - place_p - 1)) >= {percent} * (n + n_p)"
        near = active.join(other, "region").where(f"component < component_p and {admitted} and {reach}")
        pairs = scratch.keep(near.select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct())
        many = pairs.count()
        close = scratch.keep(_close(pairs, counts, percent).distinct(), many)
        links.append(_linked(close, sets, size, percent, scratch))

    if links:
        joined = components(reduce(DataFrame.unionByName, links), scratch)
        joined = joined.join(classes.select(F.col("rep").alias("component"), F.col("head").alias("first")), "component").select(F.col("node").alias("rep"), "first")
    else:
        joined = classes.select("rep", F.col("head").alias("first")).limit(0)
    final = known.join(joined, "rep", "left").select("doc", "mark", "n", F.coalesce("first", "head").alias("first"))
    final = final.unionByName(empty.select("doc", "mark", "n", key.alias("first")))
    return final.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~F.col("first.none"), F.col("first.id")).alias("component_id"), "mark", (key == F.col("first")).alias("kept"))


def _texts_of(heads: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """text, doc (the set's number) of each first document, once however often its row is repeated."""
    heads = scratch.keep(heads.groupBy("head", "rep").agg(F.count("*").alias("rows")))
    found = filter_by_key(texts, heads, "head", "inner").select("text", F.col("rep").alias("doc"), "rows")
    return found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["doc"])).select("text", "doc")


def _several(members: DataFrame, what: str, scratch: Scratch) -> DataFrame:
    """Members of the regions that hold more than one value."""
    open_ = members.groupBy("region").agg(F.min(what).alias("low"), F.max(what).alias("high")).where("low <> high").select("region")
    return members.join(scratch.keep(open_), "region", "left_semi")
