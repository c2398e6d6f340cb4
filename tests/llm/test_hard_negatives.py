"""Hard negatives against sorting all rows; the feasible ranges against all inner products."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyloom.llm import catalog, hard_negatives
from tallyloom.llm.hard_negatives import Bucket, mine


def plain(rows, asked, positives=5, negatives=3, low=50, high=95):
    """rows: distinct (id, label, vector) in the order in which ties are broken."""
    out = []
    for a, (i, label, v) in enumerate(rows):
        if not asked(i):
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j, b, k) for b, (j, k, w) in enumerate(rows) if b != a]
        scored = sorted((s, j, b, k) for s, j, b, k in scored)
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, d=6, labels=4, spread=40):
    r = random.Random(seed)
    centres = [[r.randint(-200, 200) for _ in range(d)] for _ in range(labels)]
    return [(i, k, [c + r.randint(-spread, spread) for c in centres[k]]) for i in range(n) for k in [r.randrange(labels)]]


def frame(spark, rows):
    return spark.createDataFrame([(i, k, v, 1, "x") for i, k, v in rows], "vec_id long, label long, v array<long>, score long, tie string").repartition(3)


@pytest.mark.parametrize("seed, d, spread, bucket, block", [(1, 6, 40, 32, 8), (2, 3, 400, 16, 4), (3, 20, 150, 1024, 512)])
def test_against_sorting_all(spark, monkeypatch, seed, d, spread, bucket, block):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vectors(seed, 300, d, spread=spread)
    rows += [(1000 + i, k, v) for i, k, v in rows[:40]] + [(2000 + i, (k + 1) % 4, v) for i, k, v in rows[:40]] + [(3000, 1, [0] * d), (3010, 1, [0] * d), (3020, 2, [0] * d)]
    got = sorted(map(tuple, mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_other_numbers_of_partners_and_windows(spark):
    rows = vectors(7, 120)
    got = sorted(map(tuple, mine(frame(spark, rows), F.col("vec_id") % 7 == 0, positives=2, negatives=9, low=-40, high=130).collect()))
    assert got == plain(rows, lambda i: i % 7 == 0, 2, 9, -40, 130)


def test_nulls_widths_repeated_rows_and_large_numbers(spark):
    big = 3 << 40
    rows = [(10, 1, [big, big, -big]), (11, 1, [big, big, 1]), (12, 2, [big, big // 2, 1]), (13, 2, [1, 0, 0]), (20, 1, [5, 0, 0]), (21, 2, [4, 0, 0]), (22, 1, [5, 1, 0])]
    odd = [(None, 1, [9, 9, 9]), (30, None, [9, 9, 9]), (40, 1, None), (50, 1, []), (60, 1, [1, 2]), (70, 2, [1, None, 3])]
    docs = spark.createDataFrame(rows + rows[:2] + odd, "vec_id long, label long, v array<long>")
    assert sorted(map(tuple, mine(docs, F.col("vec_id") % 10 == 0).collect())) == plain(rows, lambda i: i % 10 == 0)
    # Two vectors under one id are rows of their own.
    twice = [(10, 1, [6, 0]), (10, 1, [8, 0]), (11, 1, [7, 0]), (12, 2, [5, 0]), (12, 2, [4, 1])]
    got = mine(spark.createDataFrame(twice, "vec_id long, label long, v array<long>"), F.col("vec_id") == 10).collect()
    assert {(x.positive_id, x.positive_score) for x in got} == {(10, 48), (11, 42), (11, 56)} and {x.negative_id for x in got} == {12}


def test_empty_table_and_one_label(spark):
    rows = vectors(9, 20, labels=1)
    assert mine(frame(spark, rows), F.col("vec_id") == 0).count() == 0
    assert mine(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("d, spread", [(4, 30), (64, 60)])
def test_feasible_ranges_lose_no_row_and_prune(d, spread):
    r = np.random.default_rng(d)
    matrix = r.integers(-spread, spread, (500, d)) + r.integers(-100, 100, d) * r.integers(0, 2, (500, 1))
    bucket = Bucket(Bucket.blob(np.arange(500), np.zeros(500, np.int64), np.zeros(500, np.int64), matrix))
    left = 0
    for a in range(0, 500, 10):
        exact = matrix @ matrix[a]
        for least in (0, int(np.sort(exact)[-5]), int(exact[a] * 0.6), int(exact[a]) * 3):
            rows = bucket.candidates(matrix[a], float(np.linalg.norm(matrix[a])), least, np.argsort(-np.abs(matrix[a]))[:4])
            assert set(np.flatnonzero(exact >= max(least, 1))) <= set(rows)
            left += len(rows)
            assert (bucket.scores(rows, matrix[a]) == exact[rows]).all()
    assert left < 0.8 * 200 * 500


def test_query_on_small_table(spark, tmp_path):
    """The contract: rows that take no part, moved labels, whole components."""
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, i % 10, [r.gauss(c, 0.3) for c in centres[i % 10]]) for i in range(400)]
    rows += [(450, None, [1.0] * 8), (500, 1, None), (550, 1, [math.nan] * 8), (600, 1, [math.inf] + [1.0] * 7), (650, 1, [None] + [1.0] * 7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    usable = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * float(np.float32(x))) for x in v]) for i, k, v in rows[:400]]
    got = catalog.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(usable, lambda i: i % 50 == 0)
