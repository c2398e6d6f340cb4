"""Repeated words and bytes against brute force; suffix arrays against sorting."""

import random

import numpy as np
import pytest

from tallyloom.llm.repeats import packed, unpacked
from tallyloom.llm.substring_dedup import remove_repeated_words
from tallyloom.llm.suffix_array import common_prefixes, suffix_array
from tallyloom.llm.suffix_dedup import remove_repeated_bytes


def gone(units, window):
    """Which units of each (id, sequence) a window of a smaller id covers."""
    lowest = {}
    for i, u in units:
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            lowest[w] = min(i, lowest.get(w, i))
    out = []
    for i, u in units:
        flags = bytearray(len(u))
        for k in range(len(u) - window + 1):
            if lowest[tuple(u[k : k + window])] < i:
                flags[k : k + window] = b"\1" * window
        out.append(flags)
    return out


def corpus(seed, n=40):
    """Random texts that share passages, repeat themselves, and hold blanks of all kinds."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ß"[:5].replace(" ", "d")) for _ in range(r.randint(1, 4)))
    passages = [[word() for _ in range(r.randint(5, 60))] for _ in range(6)]
    blanks = [" ", "  ", "\n", "\t \r", "\x0b\x0c"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randint(1, 30))]
            if r.random() < 0.2:
                words += [word()] * r.randint(1, 60)
        texts.append(r.choice(["", " ", "\n"]) + "".join(w + r.choice(blanks) for w in words))
    texts += [texts[3], texts[5], "", "   ", "a", texts[3] + "x", " ".join(["nbsp"] * 20), "\x1c".join("q" * 30)]
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_words_against_brute_force(spark, seed):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    units = sorted((i, t.encode().split()) for i, t in zip(ids, texts))
    flags = gone(units, 13)
    want = sorted((i, len(u), sum(f), b" ".join(w for w, x in zip(u, f) if not x)) for (i, u), f in zip(units, flags))
    got = sorted((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in remove_repeated_words(docs).collect())
    assert got == want
    assert any(r[2] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_bytes_against_brute_force(spark, seed):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    units = sorted((i, t.encode()) for i, t in zip(ids, texts))
    flags = gone(units, 50)
    want = sorted((i, len(u), sum(f), bytes(b for b, x in zip(u, f) if not x), sum(x and not y for x, y in zip(f, b"\0" + f))) for (i, u), f in zip(units, flags))
    got = sorted((r.doc_id, r.n_units, r.n_removed, bytes(r.kept), len(r.spans)) for r in remove_repeated_bytes(docs).collect())
    assert got == want
    assert any(r[2] for r in got)


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_nulls_ties_and_clashing_names(spark, remove):
    passage = " ".join(f"word{k}" for k in range(30))
    rows = [(5, passage, 1, "a"), (5, passage, 2, "b"), (7, "head " + passage, 3, "c"), (None, passage, 4, "d"), (None, passage, 5, "e"), (1, None, 6, "f"), (2, "", 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long, spans string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_units > 0, r.n_removed == 0, len(r.kept)) for r in remove(docs).collect()))
    whole = len(passage)
    # Rows with one id leave each other alone; a null id comes after all others; null and empty texts stay empty.
    assert [g[:4] for g in got] == [(False, 1, False, True), (False, 2, False, True), (False, 5, True, True), (False, 5, True, True), (False, 7, True, False), (True, 0, True, False), (True, 0, True, False)]
    assert [g[4] for g in got][2:4] == [whole, whole] and got[4][4] <= 5 and got[5][4] == got[6][4] == 0


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_empty_table(spark, remove):
    assert remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_very_frequent_passage_and_long_text(spark, remove):
    """One passage in every document (its anchors are split), and a text longer than a slice."""
    r = random.Random(4)
    common = " ".join(f"c{k}" for k in range(40))
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(20)) + " " + common + f" tail{i}" for i in range(300)]
    texts.append(" ".join(f"x{k}" for k in range(400_000)) + " " + common)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in remove(docs).drop("kept").collect()}
    assert got[0].n_removed == 0
    if remove is remove_repeated_words:
        assert all(got[i].n_removed == 40 and len(got[i].spans) == 1 for i in range(1, 301))
    else:
        assert all(got[i].n_removed >= len(common) and len(got[i].spans) == 1 for i in range(1, 301))


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for trial in range(400):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 5))
        text = r.integers(0, k, n).astype(np.uint16)
        order = suffix_array(text, k)
        want = sorted(range(n), key=lambda i: text[i:].tolist())
        assert order.tolist() == want
        cuts = np.unique(np.r_[np.flatnonzero(r.random(n) < 0.2), n])
        room = cuts[np.searchsorted(cuts, np.arange(n))] - np.arange(n)
        prefix = common_prefixes(text, order, room)
        for a, b in zip(want, want[1:]):
            same = 0
            while max(a, b) + same < n and text[a + same] == text[b + same]:
                same += 1
            assert prefix[b] == min(same, room[b])


def test_blob_round_trip():
    arrays = [np.arange(5), np.zeros(0, np.int32), np.arange(3, dtype=np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpacked(packed(*arrays))))
