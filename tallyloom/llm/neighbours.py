"""Approximate nearest neighbours: a forest of random-projection trees, one shared queue, exact distances.

The trees are fitted to a bounded sample of the vectors; every vector is then sent down every tree.  A query descends
all trees at once: one priority queue holds the nodes of the whole forest by the margins crossed on their path, and gives
up leaves, nearest first, whatever tree they belong to.  Vectors and queries meet in the leaves, where distances are
computed on the original vectors and each leaf keeps the best few per query.

Equal vectors are one entry of the index with their smallest ids, so a vector that fills the table is no hot leaf; a leaf
with many different vectors is dealt over several tasks, to each of which its queries go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

#: Vectors the trees are fitted to, at most; trees; sample vectors of a leaf; leaves a query visits.
SAMPLE, TREES, LEAF, VISITS = 20_000, 16, 24, 500

#: Different vectors of a leaf that meet its queries in one task.
SHARE = 4_096


class Forest:
    """Trees in arrays: per node a direction, a threshold and two children; a child below zero is leaf ``-1 - child``."""

    def __init__(self, state: tuple) -> None:
        self.state = self.roots, self.directions, self.thresholds, self.children = state

    @staticmethod
    def grown(sample: np.ndarray, trees: int, leaf: int, seed: int = 11) -> Forest:
        random = np.random.default_rng(seed)
        roots, directions, thresholds, children = [], [], [], []
        for _ in range(trees):
            leaves = 0
            waiting: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
            while waiting:
                rows, parent, side = waiting.pop()
                name = None
                if len(rows) > leaf:
                    for _ in range(4):
                        a, b = random.choice(rows, 2, replace=False)
                        direction = sample[a] - sample[b]
                        on = sample[rows] @ direction
                        threshold = float(np.median(on))
                        low = on < threshold
                        if 0 < low.sum() < len(rows):
                            name = len(directions)
                            directions.append(direction / np.linalg.norm(direction))
                            thresholds.append(threshold / np.linalg.norm(direction))
                            children.append([0, 0])
                            waiting += [(rows[low], name, 0), (rows[~low], name, 1)]
                            break
                if name is None:
                    name, leaves = -1 - leaves, leaves + 1
                if parent < 0:
                    roots.append(name)
                else:
                    children[parent][side] = name
        d = sample.shape[1]
        return Forest((np.array(roots), np.array(directions).reshape(-1, d), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2)))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: (vectors, trees)."""
        out = np.zeros((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                node[inner] = self.children[at, ((vectors[inner] * self.directions[at]).sum(1) >= self.thresholds[at]).astype(int)]
            out[:, t] = -1 - node
        return out

    def visits(self, query: np.ndarray, most: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees: by the squared margins by which the path leaves the query's side."""
        margins = (self.directions * query).sum(1) - self.thresholds
        queue = [(0.0, t, int(root)) for t, root in enumerate(self.roots)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            off, tree, node = heapq.heappop(queue)
            while node >= 0:
                margin = float(margins[node])
                near = int(margin >= 0)
                heapq.heappush(queue, (off + margin * margin, tree, int(self.children[node, 1 - near])))
                node = int(self.children[node, near])
            found.append((tree, -1 - node))
        return found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def nearest(vectors: DataFrame, asked: F.Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, visits: int = VISITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row with ``asked`` (a condition on the id column).

    Nearness is Euclidean distance in double precision on the original vectors; ties go to the smaller id; a row is not
    its own neighbour, equal vectors of other rows are.  Vectors that are null, zero, or hold null or non-finite numbers
    take no part, nor do those whose length is not the most frequent one, nor rows without an id.  A table with no more
    than k other vectors gives them all.  Rows repeated with one id count once.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"), asked.alias("asked")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    kind = vectors.schema[embedding].dataType.simpleString()
    # Minus zero equals zero.
    usable = usable.withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0).otherwise(x)).cast(kind))
    widths = usable.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 1
    usable = usable.where(F.size("v") == width)

    index = scratch.keep(usable.groupBy("v").agg(F.min("id").alias("uid"), F.max(F.coalesce("asked", F.lit(False))).alias("asked")))
    owners = scratch.keep(usable.join(index.select("v", "uid"), "v").groupBy("id").agg(F.min("uid").alias("uid"), F.max(F.coalesce("asked", F.lit(False))).alias("asked")))
    ids = owners.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where(F.col("n") <= k + 1).select("uid", "id")

    some = index.select("uid", "v").orderBy(F.xxhash64("uid")).limit(sample).select("v").toPandas()["v"]
    forest = Forest.grown(np.array(some.tolist(), float).reshape(-1, width), trees, leaf)
    shared = spark.sparkContext.broadcast(forest.state)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wood = Forest(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                leaves = wood.leaves(_matrix(part.column("v"), width))
                row = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(leaves.shape[1]), len(leaves)).astype(np.int32)), pa.array(leaves.ravel().astype(np.int32)), part.column("uid").take(pa.array(row)), part.column("v").take(pa.array(row))], ["tree", "leaf", "uid", "v"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wood = Forest(shared.value)
        for batch in batches:
            matrix = _matrix(batch.column("v"), width)
            for at in range(0, batch.num_rows, 100):
                found = [(i, *spot) for i in range(at, min(at + 100, batch.num_rows)) for spot in wood.visits(matrix[i], visits)]
                row, tree, leaf_ = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf_.astype(np.int32)), batch.column("uid").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["tree", "leaf", "uid", "v"])

    shape = f"tree int, leaf int, uid bigint, v {kind}"
    rows = index.select("uid", "v").mapInArrow(placed, shape)
    queries = index.where("asked").select("uid", "v").mapInArrow(visiting, shape)
    # One row per leaf of the forest: as many as trees * sample / leaf size, whatever the table.
    deals = scratch.keep(index.select("uid", "v").mapInArrow(placed, shape).groupBy("tree", "leaf").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("deals")))
    rows = rows.join(F.broadcast(deals), ["tree", "leaf"]).withColumn("deal", F.pmod(F.xxhash64("uid"), F.col("deals")).cast("int")).drop("deals")
    queries = queries.join(F.broadcast(deals), ["tree", "leaf"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def measured(candidates: pa.Table, asked_: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["q", "uid", "score"])
        if not len(candidates) or not len(asked_):
            return empty
        uid, c = candidates.column("uid").to_numpy(), _matrix(candidates.column("v").combine_chunks(), width)
        q_ids, qs = asked_.column("uid").to_numpy(), _matrix(asked_.column("v").combine_chunks(), width)
        found = []
        for q_id, q in zip(q_ids, qs):
            score = np.sqrt(((c - q) ** 2).sum(1))
            best = np.lexsort((uid, score))[: k + 1] if len(uid) <= 4 * k else None
            if best is None:
                bound = np.partition(score, k)[k]
                near = np.flatnonzero(score <= bound)
                best = near[np.lexsort((uid[near], score[near]))][: k + 1]
            found.append((np.full(len(best), q_id), uid[best], score[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], ["q", "uid", "score"])

    keys = ["tree", "leaf", "deal"]
    met = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(measured, "q bigint, uid bigint, score double")
    met = met.groupBy("q", "uid").agg(F.min("score").alias("score"))
    nearest_first = Window.partitionBy("q").orderBy("score", "uid")
    met = scratch.keep(met.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1).drop("n"))
    spread = met.join(ids, "uid").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    lists = scratch.keep(spread.select("q", "id", "score"))
    askers = owners.where("asked").select(F.col("id").alias("query_id"), F.col("uid").alias("q"))
    answers = askers.join(lists, "q").where("query_id <> id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
