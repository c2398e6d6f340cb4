"""Packing, token counts, quality, neighbours, revisits, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import packing, quality, token_counts
from tallyloom.llm.neighbours import Forest, nearest
from tallyloom.llm.revisits import canonical_url, captures_of, resolve
from tallyloom.llm.tables import Scratch
from tallyloom.llm.token_counts import MARK, count_tokens, trie_counts, vocabulary

SF = "/root/testdata/sf0.001"


# Packing


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_every_piece(seed):
    r = np.random.default_rng(seed)
    n = (0, 40, 20_000)[seed]
    lengths = np.minimum(np.exp(r.normal(5.5, 1.2, n)).astype(int) + 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan_sequences(counts, 2048)
    held = Counter()
    for content, times in plan:
        assert sum(content) <= 2048
        for x in content:
            held[x] += times
    assert held == Counter(lengths.tolist())
    bound = -(-int(lengths.sum()) // 2048)
    assert sum(times for _, times in plan) <= bound * 1.002 + 2


def test_least_squares_finds_exact_counts():
    counts = np.zeros(11, int)
    counts[[3, 7, 4, 6]] = 50, 50, 30, 30
    rows = packing.patterns(counts, 10, tries=50)
    used = packing.repeat_counts(rows, counts, 3000)
    made = np.bincount(rows.ravel(), np.repeat(used, 4), 11)
    assert np.abs(made[1:] - counts[1:]).max() < 0.5


TEXTS = ["", " ", "a", "It's  twelve o'clock\n\nsaid 12 men!", "naïve façade — Ünïcödé €5", "Привет, мир", "日本語 text 😀", "x" * 9000,
         "tab\tand\r\nline \x0b\x0c\x85 \xa0 end", "<|endoftext|> inside", "don't’t ’s", "word " * 5000, "\x00\x01"]


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(0)
    some = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    mixed = ["".join(r.choice(["a", "é", " ", "\n", "1", "ж", "'s", "!", "½", "ª", "–", "’", "\t", "\xa0", "ǅ", "͵", "ԯ"]) for _ in range(60)) for _ in range(300)]
    single = [f"a{chr(c)}b {chr(c)}{chr(c)} c" for c in range(1, 0x530)]
    for text in TEXTS + some + mixed + single:
        assert packing.token_ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text[:50]


def test_very_long_white_space(spark):
    """Runs on which the fast reader's pattern overflows, alone, within text, and of mixed characters."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [" " * 2_000_000, "a b" + "\n\t " * 500_000 + "c d", " " * packing.LONG_RUN + "a", "a" + " " * (packing.LONG_RUN + 1), "word " * 50_000]
    for text in texts:
        assert packing.token_ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, texts[0]), (2, "a b")], "doc_id long, text string")
    got = packing.pack(docs, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x.doc_id: x.n for x in got} == {1: len(packing.token_ids(texts[0])) + 1, 2: 3}


def test_pack_round_trip(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2, "y"), (None, None, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, ids string").repartition(3)
    got = packing.pack(docs).toPandas()
    for doc, text in list(enumerate(TEXTS))[:3] + list(enumerate(TEXTS))[4:]:
        own = got[got.doc_id == doc].sort_values("piece")
        ids = [int(x) for part in own.ids for x in part]
        assert ids == [*packing.token_ids(text).tolist(), 0]
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert (own.length[1:] == 2048).all() and (len(own) == 1 or len(ids) > 2048)
        for crc, part in zip(own.ids_crc32, own.ids):
            assert crc == zlib.crc32(np.array(part, "<u4").tobytes())
    assert len(got[got.doc_id == 3]) == 2 and got[got.doc_id.isna()].length.tolist() == [1]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    assert packing.pack(docs.limit(0)).count() == 0


# Token counts


def test_trie_against_the_unigram_model():
    from tokenizers import Tokenizer, models

    scores = vocabulary()
    pieces = [("<unk>", 0.0), *[(f"<0x{b:02X}>", -100.0) for b in range(256)], *scores.items()]
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    r = random.Random(0)
    words = {"".join(r.choice("aeintrsdéßñ日x\x1c") for _ in range(r.randint(1, 12))) for _ in range(1500)} | {"the", "then", "theory", "a", "token", "tokens"}
    words = sorted(words)
    got = trie_counts(words, scores)
    want = []
    for w in words:
        ids = model.encode(MARK + w, add_special_tokens=False).ids
        want.append(len(ids))
    assert got == want


def test_trie_against_brute_force():
    r = random.Random(1)
    scores = {MARK: -3.0} | {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): -r.uniform(0.5, 6) for _ in range(14)}

    def best(path):
        if not path:
            return 0.0, 0
        found = []
        for k in range(1, len(path) + 1):
            if path[:k] in scores:
                s, n = best(path[k:])
                found.append((scores[path[:k]] + s, n + 1))
        if path[0] not in scores:
            s, n = best(path[1:])
            found.append((min(scores.values()) - token_counts.UNKNOWN + s, n + len(path[0].encode())))
        return max(found)

    words = sorted({"".join(r.choice("aabbé") for _ in range(r.randint(1, 9))) for _ in range(150)})
    assert trie_counts(words, scores) == [best(MARK + w)[1] for w in words]


def test_count_tokens(spark):
    rows = [(1, "the then\nthe", 1), (1, "the then\nthe", 2), (None, None, 3), (2, " ", 4), (3, "é" * 500, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = {(x.doc_id, x.n_words): x.n_tokens for x in count_tokens(docs).collect()}
    the, then = trie_counts(["the", "then"], vocabulary())
    assert got[1, 3] == 2 * the + then and got[None, 0] == 0 and got[2, 0] == 0 and got[3, 1] > 0
    assert count_tokens(docs).count() == 5 and count_tokens(docs.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_rows(spark):
    """Accuracy on rows whose labels were never used, and scores that do not depend on labels of held-out rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels)
    joined = scored.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (joined.predicted == joined.quality).mean() > 0.95
    assert (joined[joined.quality == 1].predicted == 1).mean() > 0.98
    assert (joined[joined.quality == 0].predicted == 0).mean() > 0.7
    held = zlib.crc32(b"7") % 5 == 0
    assert scored.where("doc_id = 7").first().held_out == held


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, None, "y"), (None, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 3 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_network_learns_and_is_calibrated():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (r.random(4000) < p).astype(float)
    score = quality.fit(x[:3000], y[:3000]).score(x[3000:])
    for low in (0.0, 0.4, 0.7):
        inside = (score >= low) & (score < low + 0.3)
        assert abs(score[inside].mean() - y[3000:][inside].mean()) < 0.1


# Neighbours


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, a in rows:
        out[q] = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in rows if i != q)[:k]
    return out


def test_neighbours_of_a_small_table(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]  # a very common vector
    odd = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 2.0, 3.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 1.0]), (305, [1.0, 2.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + odd + rows[:5]], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = nearest(table, F.col("vec_id") % 10 == 0).toPandas()
    want = brute_nearest(rows, 10)
    assert set(got.query_id) == {i for i in want if i % 10 == 0}
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert list(zip(own.score, own.vec_id)) == want[q]
    few = nearest(table.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6
    assert nearest(table.limit(0), F.lit(True)).count() == 0


def test_leaves_dealt_over_tasks_and_recall(spark, monkeypatch):
    from tallyloom.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARE", 7)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(table, F.col("vec_id") % 100 == 0, visits=150).toPandas()
    rows = table.select("vec_id", "embedding").toPandas()
    matrix, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    found = 0
    for q, own in got.groupby("query_id"):
        distance = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(1))
        distance[ids == q] = np.inf
        found += len(set(own.vec_id) & set(ids[np.lexsort((ids, distance))[:10]]))
    assert found / len(got) >= 0.9


def test_forest_covers_everything():
    r = np.random.default_rng(2)
    points = np.repeat(r.normal(size=(60, 3)), 3, axis=0)
    forest = Forest.grown(points, 3, 5)
    leaves = forest.leaves(points)
    every = {(t, leaf) for row in leaves for t, leaf in enumerate(row)}
    assert every <= set(forest.visits(points[0], 10**6))
    assert {(t, leaf) for t, leaf in enumerate(leaves[0])} <= set(forest.visits(points[0], 10))


# Revisits


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Example.com:80/A/?b=2&a=1&utm_source=x#frag": "example.com/A?a=1&b=2", "https://example.com": "example.com", "example.com/x//": "example.com/x", "": "", None: None,
             "http://www2.e.org/?": "e.org", "http://e.org:8080/p?q": "e.org:8080/p?q"}
    frame = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert all(x.got == x.want for x in frame.withColumn("got", canonical_url(F.col("url"))).collect())


def brute_resolve(rows):
    """(state, ref) of each (id, kind, key, at, etag, modified)."""
    out = {}
    for i, kind, key, at, etag, modified in rows:
        before = [(a, j, e, m) for j, k, u, a, e, m in rows if k == "response" and u == key and a < at]
        if kind == "response":
            out[i] = ("response", None)
        elif not before:
            out[i] = ("orphan", None)
        else:
            _, j, e, m = max(before, key=lambda x: x[:2])
            plain = lambda x: x.removeprefix("W/")
            differ = plain(e) != plain(etag) if e and etag else bool(m and modified and m != modified)
            out[i] = ("changed" if differ else "resolved", j)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_resolve_against_brute_force(spark, seed):
    """One URL holds half of all captures, many at the same time, over several ranges."""
    r = random.Random(seed)
    rows = []
    for i in range(400):
        key = "hot.org/x" if r.random() < 0.5 else f"h{r.randint(0, 30)}.org"
        rows.append((i, r.choice(["response", "revisit", "revisit", "revisit"]), key, r.randint(0, 150), r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "mon", "tue"])))
    frame = spark.createDataFrame([(i, k, "https://www." + u, a, {n: v for n, v in (("ETag", e), ("Last-Modified", m), ("Date", str(i)), ("X-A", str(i))) if v}) for i, k, u, a, e, m in rows],
                                  "record_id long, kind string, url string, at long, headers map<string,string>").repartition(5)
    got = {x.record_id: x for x in resolve(frame).collect()}
    want = brute_resolve(rows)
    assert {i: (x.state, x.ref_id) for i, x in got.items()} == want
    for i, x in got.items():
        source = x.ref_id if x.state == "resolved" else i
        assert x.headers["x-a"] == str(source) and x.headers["date"] == str(i)


def test_resolve_cases(spark):
    rows = [(1, "response", "a.org", 1, None, 0), (2, "revisit", "A.org#x", 2, None, 0), (2, "revisit", "a.org", 2, {"ETAG": "1", "etag": "2"}, 0), (3, None, "a.org", 3, None, 0), (4, "revisit", None, 3, None, 0),
            (5, "revisit", "a.org", None, None, 0), (6, "metadata", "a.org", 9, None, 0), (None, "revisit", "b.org", 1, None, 0)]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, headers map<string,string>, state int")
    got = sorted(((x.record_id or 0, x.state, x.ref_id) for x in resolve(frame).collect()), key=repr)
    assert got == [(0, "orphan", None), (1, "response", None), (2, "resolved", 1), (2, "resolved", 1), (3, "ignored", None), (4, "ignored", None), (5, "ignored", None), (6, "ignored", None)]
    assert resolve(frame.limit(0)).count() == 0
    assert captures_of(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_key", F.lit("kept")).withColumn("mark", F.lit(None).cast("string"))
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    before, scratch = docs.toPandas(), Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        written = scratch.keep(stage(spark, docs, SF))
        assert written.columns == docs.columns, name
        after = written.toPandas()
        key = lambda f: Counter(zip(f.doc_id.fillna(-1), f.text, f["_key"]))
        assert set(key(after)) <= set(key(before)), name
        if name == "exact_dedup":
            plain = after.text.str.replace(r"[\x20\x09-\x0D]+", "", regex=True)
            assert plain.is_unique and set(plain) == set(before.text.str.replace(r"[\x20\x09-\x0D]+", "", regex=True))
        if name == "mix":
            assert max(key(after).values()) <= 3
            words = after.text.map(lambda t: len(t.encode().split())).sum()
            assert abs(words / before.text.map(lambda t: len(t.encode().split())).sum() - 1) < 0.25
        docs, before = written, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert (pieces.piece == 0).sum() == len(before)


def test_near_dedup_stage_against_brute_force(spark):
    """Spread edits on both sides of the stage's limit; many pairs lie between it and that of op1."""
    r = random.Random(5)
    texts = []
    for edits in (0, 2, 4, 5, 6, 6, 7, 8, 12):
        text = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        near = list(text)
        for k in range(edits):
            near[20 + k * 260 // max(edits, 1)] = f"x{k}"
        texts += [" ".join(text), " ".join(near)]
    rows = list(zip(r.sample(range(1000), len(texts)), texts))

    def similar(a, b, n):
        a, b = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    pairs = list(zip(rows[::2], rows[1::2]))
    assert sum(similar(a[1], b[1], 5) >= 0.8 and similar(a[1], b[1], 3) < 0.9 for a, b in pairs) >= 2
    parent = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and similar(a, b, 5) >= 0.8:
                x, y = parent[i], parent[j]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.distinct(spark, docs, SF).collect()) == sorted(i for i in parent if parent[i] == i)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
