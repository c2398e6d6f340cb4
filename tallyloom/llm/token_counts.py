"""Token counts of a unigram vocabulary, by dynamic programming shared along a trie of words.

A word's tokens are the pieces with the highest sum of log-probabilities.  The best score of a prefix depends on the
prefix alone, so words that begin alike share it: each task puts the distinct words of a load of texts into a trie and
walks it once, computing the forward score of every node from the nodes above it, and storing the number of tokens where
a word ends.  Walking the words in sorted order visits the trie depth first; the path from the root is all the state.
Texts then only look up their words.  Nothing is shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import slices, words

#: Vocabulary file below the folder of public tokenizers.
VOCABULARY = "piece_bpe_32k.model"

#: Stands for the blank before a word.
MARK = "▁"

#: Bytes of text whose words share one trie.
LOAD_BYTES = 16 << 20

#: How much less likely than the rarest piece a character outside the vocabulary is (log).
UNKNOWN = 10.0


@functools.cache
def vocabulary(name: str = VOCABULARY) -> dict[str, float]:
    """Pieces and log-probabilities.  The file ranks its pieces; a piece of rank r gets a probability in proportion to 1 / r."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(r + 1) - total for r, piece in enumerate(pieces)}


def trie_counts(sorted_words: list[str], scores: dict[str, float], mark: str = MARK) -> list[int]:
    """Number of tokens of each of the distinct words, given in order; each is preceded by the mark.

    A character that no piece covers counts as its UTF-8 bytes.  Of equal scores the last piece that is longest wins.
    """
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - UNKNOWN
    best, tokens = [0.0], [0]  # forward scores and token counts along the path from the root
    before, out = "", []
    for word in sorted_words:
        path = mark + word
        shared, end = 0, min(len(before), len(path))
        while shared < end and before[shared] == path[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for at in range(shared + 1, len(path) + 1):
            top, from_, single = -math.inf, 0, False
            for begin in range(max(0, at - longest), at):
                score = scores.get(path[begin:at])
                if score is not None and best[begin] + score > top:
                    top, from_ = best[begin] + score, begin
            number = tokens[from_] + 1 if top > -math.inf else 0
            single = path[at - 1] not in scores
            if single and best[at - 1] + unknown > top:
                top, number = best[at - 1] + unknown, tokens[at - 1] + len(path[at - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            tokens.append(number)
        out.append(tokens[len(path)])
        before = path
    return out


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens of every row: words ``[^\\x20\\x09-\\x0D]+`` of the whole text, each with a mark before it.

    A null or blank text has no words and no tokens.  Rows repeated with one id are counted each; other columns of
    ``docs`` are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = vocabulary(vocabulary_file)
        waiting, size = [], 0

        def load() -> Iterator[pa.RecordBatch]:
            column = pa.chunked_array([w for _, w, _ in waiting]).dictionary_encode().combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            distinct = [w.decode() for w in column.dictionary.to_pylist()]
            order = sorted(range(len(distinct)), key=distinct.__getitem__)
            tokens = np.zeros(len(distinct), np.int64)
            tokens[order] = trie_counts([distinct[i] for i in order], scores)
            each = np.append(0, np.cumsum(tokens[column.indices.to_numpy()]))
            at = 0
            for ids, w, first in waiting:
                bounds = each[at + first]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(np.diff(bounds))], ["doc_id", "n_words", "n_tokens"])
                at += len(w)

        for batch in batches:
            for begin, data, offsets in slices(batch.column(1)):
                starts, ends, first = words(data, offsets)
                lengths = ends - starts
                total = np.append(0, np.cumsum(lengths))
                letters = data[np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)]
                column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(letters)])
                waiting.append((batch.column(0).slice(begin, len(offsets) - 1), column, first))
                size += len(data)
                if size >= LOAD_BYTES:
                    yield from load()
                    waiting, size = [], 0
        if waiting:
            yield from load()

    source = docs.select(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    return source.mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint")
