"""Periodic runs against trying every period; secrets against plain counting."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import catalog
from tallyloom.llm.periodic_runs import collapse_runs, common_lengths, runs_of_texts, sorted_ranks
from tallyloom.llm.secret_scan import find_secrets, looks_live


def every_run(words, least=12):
    """(start, length, period): for each period the maximal stretches that have it; of equal stretches the smallest."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_against_every_period(least):
    r = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = [r.randrange(r.choice([1, 2, 3, 8, 50])) for _ in range(r.randint(0, 60))]
            if r.random() < 0.6 and w:
                w = w[:20] + w[: r.randint(1, 12)] * r.randint(1, 8) + w[20:]
            texts.append(w)
        assert runs_of_texts([np.array(t, np.int64) for t in texts], least) == [every_run(t, least) for t in texts]


def test_suffixes_and_common_prefixes_of_words():
    r = random.Random(5)
    for _ in range(200):
        w = [r.randrange(3) for _ in range(r.randint(1, 80))] + [9]
        order = sorted(range(len(w)), key=lambda i: w[i:])
        assert np.argsort(sorted_ranks(np.array(w))).tolist() == order
        want = [next(k for k in range(len(w)) if w[a + k : a + k + 1] != w[b + k : b + k + 1]) for a, b in zip(order, order[1:])]
        assert common_lengths(np.array(w), np.array(order[:-1]), np.array(order[1:])).tolist() == want


def test_long_and_adversarial_texts():
    """One word for ever, a run of many periods, a Fibonacci word, and a passage with many left words stay cheap."""
    assert runs_of_texts([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    assert runs_of_texts([np.tile(np.arange(700), 200)]) == [[(0, 140_000, 700)]]
    assert runs_of_texts([np.concatenate([np.r_[100 + k, np.arange(20)] for k in range(5_000)])]) == [[]]
    many = np.concatenate([np.r_[100 + k, np.tile([1, 2], 25)] for k in range(2_000)])
    assert runs_of_texts([many]) == [[(51 * k + 1, 50, 2) for k in range(2_000)]]
    a, b = [0], [0, 1]
    while len(b) < 3_000:
        a, b = b, b + a
    assert runs_of_texts([np.array(b[:900])]) == [every_run(b[:900])]


def texts_with_runs(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé😀") for _ in range(r.randint(1, 3)))
    blanks = [" ", "\n", "\t ", "\x0b", "\x0c\r"]
    out = []
    for _ in range(60):
        words = [word() for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            words += words[: r.randint(1, 9)] * r.randint(2, 9)
        out.append("".join(w + r.choice(blanks) for w in words))
    return out + ["", " \n", None, "nbsp word " * 20, "\x1c " * 13]


def test_collapsed_texts_against_brute_force(spark):
    texts = texts_with_runs(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for x in collapse_runs(docs).collect():
        words = (texts[x.doc_id] or "").encode().split()
        runs = every_run(words)
        assert (x.n_words, [tuple(q) for q in x.runs], bytes(x.kept)) == (len(words), runs, b" ".join(collapsed(words, runs)))


def test_run_query_against_brute_force(spark, tmp_path):
    """The whole contract, with the rewriting of one text in ten, null ids and texts, repeated rows and clashing names."""
    texts = texts_with_runs(4) * 3
    rows = [(k, t, k, "x") for k, t in enumerate(texts)] + [(None, texts[0], 1, "y"), (7, texts[7], 2, "z"), (7, texts[7], 2, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, _, _ in rows:
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = every_run(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()))
    got = catalog.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({x for x in want if x[1]}) > 20


def test_runs_of_an_empty_table_and_a_long_text(spark):
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{k}" for k in range(900_000)) + " again" * 30 + "\n" + " ".join(f"v{k % 50}" for k in range(200_000))
    (x,) = collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in x.runs] == [(900_000, 30, 1), (900_030, 200_000, 50)] and x.n_words == 1_100_030


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(rows, owners=3, repositories=6):
    """Spans of every row by the words of the contract, and candidates by counting (owner, repository) pairs in a dictionary."""
    found, held = [], {}
    for _, text, source, lang in rows:
        text = text or ""
        base = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
        base += [("access", m.start(), m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
        base += [("hex", m.start(), m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
        more = [("live", m.start(), m.end(), m.group()) for m in re.finditer("[A-Za-z0-9+/_=-]+", text)
                if looks_live(m.group()) and not any(s < m.end() and m.start() < e for _, s, e, _ in base)]
        found.append(base + more)
        for _, _, _, v in base + more:
            held.setdefault(v, set()).add((source, lang))
    few = {v for v, who in held.items() if len({s for s, _ in who}) <= owners and len(who) <= repositories}
    kinds = ["assign", "access", "hex", "live"]
    out = []
    for (i, *_), spans in zip(rows, found):
        spans = sorted((s, kinds.index(k), k, e, "plain" if not looks_live(v) else "live" if v in few else "example") for k, s, e, v in spans if k != "live" or v in few)
        out.append((i, [(s, k, e, verdict) for s, _, k, e, verdict in spans]))
    return out


def test_secrets_against_plain_counting(spark):
    r = random.Random(8)
    value = lambda n: "".join(r.choice("abcdefXYZ0123456789+/") for _ in range(n))
    shared = [value(30) for _ in range(8)]
    pieces = [lambda: f'token = "{value(r.randint(5, 20))}"', lambda: "PassWord:" + value(9), lambda: "api_KEY' :  'abc.def-ghi", lambda: "AKIA" + "A1B2" * r.randint(1, 5), lambda: "apikey=short",
              lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(28, 44))), lambda: r.choice(shared), lambda: value(25), lambda: "tokén é😀", lambda: "ſecret=12345678", lambda: "toKen=12345678",
              lambda: "secret=" + r.choice(shared), lambda: "word " * r.randint(1, 5), lambda: "a" * 40, lambda: "AKIAKIA" + "Z" * 9]
    rows = []
    for i in range(300):
        text = "".join(r.choice(pieces)() + r.choice([" ", "\n", ",", "é", ""]) for _ in range(r.randint(0, 8)))
        rows.append((i, text, r.choice([None, "s1", "s2", "s3", "s4", "s5"]), r.choice([None, "en", "de"])))
    rows += [(None, rows[3][1], "s1", "en"), (5, rows[5][1], "s1", "en"), (5, rows[5][1], "s1", "en"), (6, None, None, None), (8, "", "s1", "en")]
    docs = spark.createDataFrame([(*x, 1, "a") for x in rows], "doc_id long, text string, source string, lang string, row long, spans string").repartition(5)
    got = sorted(((x.doc_id, [(s.start, s.kind, s.end, s.verdict) for s in x.spans]) for x in find_secrets(docs).collect()), key=repr)
    want = sorted(plain_spans(rows), key=repr)
    assert got == want
    seen = {(k, v) for _, spans in want for _, k, _, v in spans}
    assert {k for k, _ in seen} == {"assign", "access", "hex", "live"} and {v for _, v in seen} == {"live", "example", "plain"}


def test_copies_under_one_owner_stay_specific_and_empty_table(spark):
    live, sample = "zq8" + "A1b2C3d4E5f6G7h8J9k0", "yq7" + "A1b2C3d4E5f6G7h8J9k0"
    rows = [(k, f"key {live} end", "one", "en") for k in range(50)] + [(100 + k, f"key {sample} end", f"owner{k}", "en") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x.spans for x in find_secrets(docs).collect()}
    assert all([tuple(s)[:4] for s in got[k]] == [(4, "live", 27, "live")] and got[k][0].owners == 1 for k in range(50))
    assert all(not got[100 + k] for k in range(4))
    assert find_secrets(docs.limit(0)).count() == 0
