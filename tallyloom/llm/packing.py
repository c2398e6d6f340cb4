"""Packing documents into sequences: few-document length patterns fitted to the length histogram.

Documents are tokenised once and cut into pieces; what is written is one short row per piece.  The histogram of
lengths (one number per possible length, whatever the corpus) is packed on the driver as *counts*: patterns of two to
four lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative
least squares and rounded down to what the histogram can supply, and the rest is packed best fit, longest first, also by
counts.  The result is a short list of slots: the k-th piece of a length goes to such a sequence at such an offset.

Which piece is the k-th of its length needs no sort: each task numbers its own pieces, and a running sum of the counts
per (length, task) gives where a task's numbers begin.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

CAPACITY = 2048

#: Vocabulary files below the folder of public tokenizers: the tokenizer, and the same vocabulary as merge ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Characters on which both readers of the vocabulary are known to cut alike (letters, digits, signs up to Cyrillic).
_OTHER = re.compile("[^\x00-ԯ‐-‧‰-⁞€]")

#: A run of white space too long for the fast reader, whose pattern backtracks over it (its stack ends at about a million).
LONG_RUN = 100_000
_BLANKS = re.compile(r"(?<!\s)\s{%d}" % (LONG_RUN + 1))


@functools.cache
def _readers(tokenizer: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    specials = {token.content: i for i, token in exact.get_added_tokens_decoder().items()}
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=specials), tuple(specials)


def token_ids(text: str, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> np.ndarray:
    """Ids of the tokenizer file (no special tokens added).

    The rank file holds the same vocabulary and its reader is several times faster; it is used where both readers cut
    the text alike.  Other characters, the strings of special tokens, and very long runs of white space go to the tokenizer
    itself.
    """
    exact, fast, specials = _readers(tokenizer, ranks)
    if (text.isascii() or not _OTHER.search(text)) and not any(s in text for s in specials) and not (len(text) > LONG_RUN and _BLANKS.search(text)):
        return fast.encode_to_numpy(text, disallowed_special=())
    return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but the first may be shorter."""
    first = length % capacity or min(capacity, length)
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, local (number among the task's pieces of that length), ids if asked for."""
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out, kept = [], []
                for doc, value in zip(batch.column(0).slice(at, 2000).to_pylist(), batch.column(1).slice(at, 2000).to_pylist()):
                    ids = np.append(token_ids(value, tokenizer, ranks), np.uint32(0)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        piece = ids[start : start + length]
                        out.append((doc, k, start, length, zlib.crc32(piece.tobytes()), task, int(seen[length])))
                        kept.append(piece.astype(np.int32) if with_ids else None)
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int32()))] if with_ids else columns, [*names, "ids"] if with_ids else names)

    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, local bigint"
    source = docs.select(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    return source.mapInArrow(tokenise, shape + (", ids array<int>" if with_ids else ""))


def patterns(counts: np.ndarray, capacity: int, tries: int = 40_000, seed: int = 3) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence exactly, from lengths that occur."""
    present = counts > 0
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < capacity)]
    if not len(lengths):
        return np.zeros((0, 4), np.int64)
    random = np.random.default_rng(seed)
    share = counts[lengths] / counts[lengths].sum()
    found = [np.column_stack((lengths, capacity - lengths, np.zeros((len(lengths), 2), np.int64)))]
    for free in (2, 3):
        some = random.choice(lengths, (tries, free), p=share)
        some[: tries // 2, 0] = random.choice(lengths, tries // 2)  # rare lengths too
        rest = capacity - some.sum(1)
        row = np.zeros((tries, 4), np.int64)
        row[:, :free], row[:, free] = some, rest
        found.append(row[rest > 0])
    every = np.sort(np.concatenate(found), axis=1)[:, ::-1]
    return np.unique(every[(present[every] | (every == 0)).all(1)], axis=0)


def repeat_counts(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that they add up to the histogram.

    Multiplicative updates keep every count non-negative and lower the squared error in each round.
    """
    goal = counts.astype(float)
    goal[0] = 0
    used = np.ones(len(rows))
    filled = rows > 0
    wanted = np.where(filled, goal[rows], 0).sum(1)
    for _ in range(rounds):
        made = np.bincount(rows.ravel(), np.repeat(used, 4), len(counts))
        made[0] = 0
        used *= wanted / np.maximum(np.where(filled, made[rows], 0).sum(1), 1e-12)
    return used


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their numbers that hold every piece of the histogram (``counts[length]``)."""
    left = counts.astype(np.int64).copy()
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(left, capacity)
    fitted = np.floor(repeat_counts(rows, left) + 1e-9).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    for k in np.argsort(-fitted, kind="stable"):
        if not fitted[k]:
            break
        lengths, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(fitted[k], (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            plan.append((tuple(int(x) for x in rows[k] if x), n))
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for counts of lengths; equal sequences are one entry with a number."""
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by free room
    room = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = length + int(room[length:].argmax())
            if not room[fits]:
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    open_[capacity - each * length].append(((length,) * each, whole))
                    room[capacity - each * length] = True
                if rest:
                    open_[capacity - rest * length].append(((length,) * rest, 1))
                    room[capacity - rest * length] = True
                break
            content, m = open_[fits].pop()
            room[fits] = bool(open_[fits])
            each = min(fits // length, n)
            take = min(m, n // each)
            if take < m:
                open_[fits].append((content, m - take))
                room[fits] = True
            free = fits - each * length
            open_[free].append((content + (length,) * each, take))
            room[free] = True
            n -= take * each
    return [entry for entries in open_ for entry in entries]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first k, first sequence, offset) in order: the k-th piece of a length, where it goes."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for content, n in plan:
        offset = 0
        for length in content:
            k = taken.get(length, 0)
            out.append((length, k, sequence, offset))
            taken[length] = k + n
            offset += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset, and the ids if
    asked for.  A document's tokens are those of its whole text (null: none) and a closing id 0; only longer documents
    are cut.  Rows repeated with one id are packed each.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    made = scratch.keep(pieces(docs, doc_id, text, capacity, tokenizer, ranks, with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # at most one row per possible length
        counts[row["length"]] = row["count"]
    table = slots(plan_sequences(counts, capacity))
    shared = spark.sparkContext.broadcast(table)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        order = where[:, 0] * (1 << 44) + where[:, 1]
        for batch in batches:
            length, k = batch.column("length").to_numpy(), batch.column("k").to_numpy()
            slot = np.searchsorted(order, length * (1 << 44) + k, "right") - 1
            columns = [c for c in batch.schema.names if c != "k"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(where[slot, 2] + k - where[slot, 1]), pa.array(where[slot, 3])], [*columns, "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = made.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    numbered = made.join(begins, ["length", "task"]).select(*[c for c in made.columns if c not in ("task", "local")], (F.col("begin") + F.col("local")).alias("k"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("k").schema)
    return numbered.mapInArrow(placed, f"{shape}, sequence_id bigint, offset bigint")
