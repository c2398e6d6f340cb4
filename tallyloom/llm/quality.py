"""Quality scores from random-indexing word vectors and a small two-layer network.

Random indexing: every word has a fixed sparse index vector (a few +1 and -1 at hashed places), and a word's vector is
the sum of the index vectors of its neighbours over all documents.  Words are hashed to a fixed number of slots, so the
table of vectors has one size for any corpus: it is summed in whole numbers by each task, then by block of slots, and
sent to all executors to pool each document.  The network is plain numpy, fitted on the driver to a bounded sample of
labelled documents; its probabilities are calibrated by one temperature on labelled rows it was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, text_mark
from .texts import mix, prefix_hash, row_of, slices, substring_hash, words

#: Slots of the hashed vocabulary and numbers of a word vector: the table has SLOTS * (WIDTH + 1) numbers.
SLOTS, WIDTH = 1 << 15, 32

#: Neighbours on each side, and entries of an index vector.
REACH, ENTRIES = 2, 2

#: Slots that one row of a partial table holds.
BLOCK = 2048

#: Labelled documents that the network is fitted to, at most (the ones with the smallest hash).
SAMPLE = 20_000

#: Scores from here on count as good.
THRESHOLD = 0.3

#: Pooled vector, its length, mean likeness of neighbours, share of the commonest slots, log of the number of words.
FEATURES = WIDTH + 4


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word (its core and the signs around it apart from the letters), and the first word of each row."""
    starts, ends, first = words(data, offsets)
    return (substring_hash(prefix_hash(data), starts, ends) % np.uint64(SLOTS)).astype(np.int64), first


def index_vectors() -> np.ndarray:
    """Sparse index vector of every slot: (slots, entries) places with the sign folded in (place, or place + width for -1)."""
    slot = np.arange(SLOTS, dtype=np.uint64)
    return np.column_stack([(mix(slot * np.uint64(2 * e + 1) + np.uint64(77 * e + 1)) % np.uint64(2 * WIDTH)).astype(np.int64) for e in range(ENTRIES)])


def context_table(texts: DataFrame) -> np.ndarray:
    """(slots, width + 1): summed index vectors of the neighbours of each slot's words, and its number of words."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, any_row = index_vectors(), np.zeros((SLOTS, WIDTH + 1), np.int64), False
        places = np.where(index < WIDTH, index, index - WIDTH)
        signs = np.where(index < WIDTH, 1.0, -1.0)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                slot, first = _slots(data, offsets)
                any_row = True
                row = row_of(np.arange(len(slot)), first)
                total[:, WIDTH] += np.bincount(slot, minlength=SLOTS)
                sums = np.zeros(SLOTS * WIDTH)
                for apart in range(1, REACH + 1):
                    a, b = slot[:-apart], slot[apart:]
                    near = row[:-apart] == row[apart:]
                    a, b = a[near], b[near]
                    for e in range(ENTRIES):
                        sums += np.bincount(a * WIDTH + places[b, e], signs[b, e], SLOTS * WIDTH)
                        sums += np.bincount(b * WIDTH + places[a, e], signs[a, e], SLOTS * WIDTH)
                total[:, :WIDTH] += sums.reshape(SLOTS, WIDTH).astype(np.int64)
        if any_row:
            for b in range(0, SLOTS, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([total[b : b + BLOCK].astype(np.int32 if abs(total).max() < 1 << 31 else np.int64).tobytes()], pa.binary())], ["block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                buffer = blob.as_buffer()
                values = np.frombuffer(buffer, np.int32 if buffer.size == BLOCK * (WIDTH + 1) * 4 else np.int64)
                totals[b] = totals[b] + values if b in totals else values.astype(np.int64)
        for b, values in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["block", "sums"])

    shape = "block int, sums binary"
    blocks = SLOTS // BLOCK
    parts = texts.select("text").mapInArrow(partial, shape)
    # Two levels, so that no task adds up the tables of all tasks.
    for salted in (True, False):
        keys = ["block", F.spark_partition_id() % 16] if salted else ["block"]
        parts = parts.repartition(blocks * (4 if salted else 1), *keys).mapInArrow(added, shape)
    table = np.zeros((SLOTS, WIDTH + 1), np.int64)
    for row in parts.collect():  # as many rows as blocks
        table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(BLOCK, WIDTH + 1)
    return table


def word_vectors(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the slots, their weight in a pool (rarer words weigh more), and which slots are common."""
    counts = table[:, WIDTH].astype(float)
    vectors = table[:, :WIDTH].astype(float)
    vectors -= counts[:, None] * (vectors.sum(0) / max(counts.sum(), 1.0))  # what all words share tells nothing
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts / max(counts.sum(), 1.0)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32), (share > 1e-4).astype(np.float32)


def pooled(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """id, mark, features (float array) of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(word_vectors(table))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights, common = shared.value
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                slot, first = _slots(data, offsets)
                n = np.diff(first)
                out = np.zeros((len(n), FEATURES), np.float32)
                some = np.flatnonzero(n)
                if len(some):
                    heads, row = first[:-1][some], row_of(np.arange(len(slot)), first)
                    w = weights[slot]
                    total = np.maximum(np.add.reduceat(w, heads), 1e-9)
                    v = vectors[slot]
                    out[some, :WIDTH] = np.add.reduceat(v * w[:, None], heads) / total[:, None]
                    out[some, WIDTH] = np.linalg.norm(out[some, :WIDTH], axis=1)
                    alike = np.zeros(len(slot), np.float32)
                    alike[1:] = (v[1:] * v[:-1]).sum(1) * (row[1:] == row[:-1])
                    out[some, WIDTH + 1] = np.add.reduceat(alike, heads) / n[some]
                    out[some, WIDTH + 2] = np.add.reduceat(common[slot], heads) / n[some]
                    out[some, WIDTH + 3] = np.log1p(n[some])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), batch.column(2).slice(at, len(n)), lists], ["id", "mark", "features"])

    return texts.select("id", "text", "mark").mapInArrow(pool, "id bigint, mark bigint, features array<float>")


class Network:
    """Two layers, tanh and logistic, with standardised inputs and a temperature."""

    def __init__(self, weights: tuple) -> None:
        self.weights = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, a, b, c, d, _ = self.weights
        return np.tanh(((x - mean) / spread) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(float)) / self.weights[-1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss; a quarter of the rows is kept for the temperature."""
    random = np.random.default_rng(seed)
    if len(y) < 20 or y.min() == y.max():  # nothing to learn from: everything gets the share of good labels
        rate = float(np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99))
        return Network((0.0, 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.log(rate / (1 - rate)), 1.0))
    order = random.permutation(len(y))
    x, y = x[order].astype(float), y[order].astype(float)
    held = len(y) // 4
    mean, spread = x[held:].mean(0), x[held:].std(0) + 1e-6
    z, t = (x - mean) / spread, y
    p = [random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        rows = held + random.permutation(len(y) - held)
        for at in range(0, len(rows), batch):
            r = rows[at : at + batch]
            h = np.tanh(z[r] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[r]) / len(r)
            inner = error[:, None] * p[2] * (1 - h * h)
            gradients = [z[r].T @ inner + decay * p[0], inner.sum(0), h.T @ error + decay * p[2], error.sum()]
            step += 1
            for k, g in enumerate(gradients):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network((mean, spread, *p, 1.0))
    logits = net.logits(x[:held])
    losses = []
    for temperature in np.geomspace(0.2, 5, 60):
        q = np.clip(logits / temperature, -30, 30)
        losses.append((float(np.mean(np.logaddexp(0, q) - y[:held] * q)), float(temperature)))
    return Network((mean, spread, *p, min(losses)[1]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text divides by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted (1 from ``threshold`` on), mark (a hash of the text) for every row of ``docs``.

    Only ``text`` makes the score; word vectors come from all texts.  A null text is scored as empty.  At most ``sample``
    labelled documents are learned from; labels of held-out rows, null labels and labels without a document are not used,
    and of contradicting labels of one document the lowest counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", text_mark("text"))
    features = scratch.keep(pooled(texts, context_table(texts)))
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    chosen = features.join(known.groupBy("id").agg(F.min("y").alias("y")), "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("features", "y").toPandas()
    x = np.array(chosen["features"].tolist(), float).reshape(-1, FEATURES)
    weights = fit(x, chosen["y"].to_numpy(float)).weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.score(x))], ["id", "mark", "score"])

    scores = features.mapInArrow(scored, "id bigint, mark bigint, score double")
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "mark")
