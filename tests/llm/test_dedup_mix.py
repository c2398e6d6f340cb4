"""Exact dedup, the Jaccard join, and mixing."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyloom.llm.components import components
from tallyloom.llm.exact_dedup import exact_duplicates
from tallyloom.llm import jaccard_join
from tallyloom.llm.jaccard_join import jaccard_components
from tallyloom.llm.mixing import mix, targets
from tallyloom.llm.substring_dedup import remove_repeated_words
from tallyloom.llm.tables import Scratch, decided
from tallyloom.llm.texts import SLICE_BYTES

BLANKS = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups["".join(c for c in t or "" if c not in BLANKS)].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for plain, members in groups.items():
        first = min(members)
        out += [(m[4], first[4], len(members), m[3] == first[3], hashlib.sha256(plain.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, key_bits", [(16_384, ()), (5, ()), (3, (2, 4))])
def test_exact_against_brute_force(spark, block, key_bits):
    """Also with tiny blocks (many pairing levels) and keys so narrow that the naming is repeated."""
    r = random.Random(2)
    texts = ["".join(r.choice("ab \né😀") for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [t + " " for t in texts[:15]] + [" ".join(t) for t in texts[5:25]] + ["", " ", None, "x" * 100, "x" * 99 + " x"]
    rows = list(zip(r.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_duplicates(docs, block=block, key_bits=key_bits).collect()), key=repr)
    assert got == brute_exact(rows)


def test_exact_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b", 1, 1), (1, "a b", 2, 2), (None, "ab ", 3, 3), (2, "ab", 4, 4), (3, None, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, _key long")
    got = exact_duplicates(docs).collect()
    assert sum(x.kept for x in got if x.group_size == 4) == 1 and {x.keep_id for x in got if x.group_size == 4} == {1}
    kept = decided(docs, exact_duplicates(docs).select("doc_id", "mark", "kept"))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3]
    assert exact_duplicates(docs.limit(0)).count() == 0


def brute_jaccard(rows, percent=90):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("seed, crowd", [(0, 2), (1, 16), (2, 3)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, crowd):
    """Chains of edits, copies, short texts and a passage in many texts; with pivots for tiny groups too."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    r = random.Random(seed)
    word = lambda: f"W{r.randint(0, 400)}"
    common = [word() for _ in range(25)]
    rows = []
    for _ in range(25):
        text = [word() for _ in range(r.choice([1, 2, 3, 10, 40, 120]))] + (common if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 1, 2, 6])):
            rows.append(" ".join(text) if r.random() < 0.7 else "\n".join(text).lower())
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = word()
    rows += ["", " \n", None, "ONE", "one", "a b", "A B"]
    rows = list(zip(r.sample(range(1000), len(rows)), rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(docs).collect())
    assert got == brute_jaccard(rows)
    assert any(a != c for a, _, c in got)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch, size, percent):
    """Copies of one text with none to many edits of their own: links on both sides of the limit, few pairs compared."""
    r = random.Random(size)
    base = [f"w{r.randint(0, 2000)}" for _ in range(150)]
    texts = []
    for k in range(500):
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            text[r.randrange(150)] = f"e{r.randint(0, 10**9)}"
        texts.append(text)
        if k % 10 == 0:
            texts.append([*text[:-1], f"e{k}"])  # a near copy of an edited copy
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    compared = []
    for name in ("_linked", "_apart"):
        def spied(pairs, *rest, inner=getattr(jaccard_join, name)):
            compared.append(pairs.count())
            return inner(pairs, *rest)

        monkeypatch.setattr(jaccard_join, name, spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in jaccard_components(docs, size=size, percent=percent).collect()}
    sets = [frozenset(tuple(t[k : k + size]) for k in range(len(t) - size + 1)) for t in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, one in enumerate(sets):
        for b in range(a):
            if 100 * len(one & sets[b]) >= percent * len(one | sets[b]):
                links += one != sets[b]
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in range(len(rows))} and 100 < len(set(got.values())) < 450
    assert links > 3_000 and sum(compared) < 10 * len(rows), compared


def test_parities_bound_the_symmetric_difference():
    """Never above it, and near it, also between lists of different lengths."""
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (10, 40), (300, 300), (300, 330), (511, 520), (1000, 1300), (3, 5000)):
        for share in (0, 0.5, 0.95):
            both = r.integers(0, 1 << 63, int(share * min(n, m)), dtype=np.uint64)
            one, other = (np.concatenate((both, r.integers(0, 1 << 63, k - len(both), dtype=np.uint64))) for k in (n, m))
            row = np.repeat([0, 1, 2], [n, m, 0])
            odd = jaccard_join.parities(row, np.concatenate((one, other)), 3)
            apart = n + m - 2 * len(both)
            low = jaccard_join.least_apart(odd[0], odd[1])
            assert low == jaccard_join.least_apart(odd[1], odd[0]) <= apart and len(odd[2]) == 8 and not any(odd[2])
            assert share < 0.9 or low >= 0.85 * apart or apart > n
    assert jaccard_join.least_apart(odd[0], odd[0]) == 0


def test_texts_of_pairs_that_cannot_link_stay_where_they_are(spark, monkeypatch):
    """Copies with three edits each pass the counts, but fail the limit: only what the parities leave has its texts moved."""
    r = random.Random(11)
    rows, sets = [], []
    for _ in range(12):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
        for _ in range(12):
            text = list(base)
            for _ in range(r.choice([2, 3, 3, 3])):
                text[r.randrange(200)] = f"e{r.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
            sets.append(frozenset(tuple(text[k : k + 5]) for k in range(196)))
    asked, moved = [], []
    for name, seen in (("_linked", asked), ("_with_texts", moved)):
        def spied(pairs, *rest, inner=getattr(jaccard_join, name), seen=seen):
            seen.append(pairs.count())
            return inner(pairs, *rest)

        monkeypatch.setattr(jaccard_join, name, spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in jaccard_components(docs, size=5, percent=80).collect()}
    links = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    assert got == dict(enumerate(first))
    assert sum(asked) > 5 * len(links) and sum(moved) < 2 * len(links), (asked, moved, len(links))


def test_copies_with_edits_of_their_own_ask_for_nobody(spark, monkeypatch):
    """Differences to the pivot that are a document's own cover its prefix: what it shares with the crowd is not joined."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for k in range(400):
        text = list(base)
        for place in r.sample(range(200), 8):
            text[place] = f"e{r.randint(0, 10**9)}"
        rows.append((k, " ".join(text)))
    seen = []

    def spied(known, held, percent, inner=jaccard_join._asked):
        out = inner(known, held, percent)
        seen.append((known.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_asked", spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert all(x.doc_id == x.component_id for x in jaccard_components(docs).collect())
    assert sum(k for k, _ in seen) >= 390 and sum(x for _, x in seen) < 0.05 * sum(k for k, _ in seen), seen


def test_differences_that_meet_nobody_are_not_spread_out(spark, monkeypatch):
    """Rows made of differences: next to none for copies with edits of their own, and twice as many at most for twice the copies."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for k in range(400):
        text = list(base)
        for place in r.sample(range(200), r.choice([0, 8, 8, 8])):
            text[place] = f"e{r.randint(0, 10**9)}"
        texts.append([*text[:-1], f"z{k}"])
    size, percent = 3, 90
    made, inner = [], Scratch.keep

    def spied(self, df, rows=None):
        back = inner(self, df, rows)
        if "held" in df.columns and "p" in df.columns:
            made.append(back.agg({"held": "sum"}).first()[0] or 0)
        return back

    monkeypatch.setattr(Scratch, "keep", spied)
    found = []
    for n in (200, 400):
        made.clear()
        docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts[:n])], "doc_id long, text string").repartition(3)
        got = {x.doc_id: x.component_id for x in jaccard_components(docs, size=size, percent=percent).collect()}
        sets = [frozenset(tuple(t[k : k + size]) for k in range(len(t) - size + 1)) for t in texts[:n]]
        first = list(range(n))
        for _ in range(4):
            for a in range(n):
                for b in range(a):
                    if first[a] != first[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        first[a] = first[b] = min(first[a], first[b])
        assert got == dict(enumerate(first)) and made
        found.append(sum(made))
    assert found[1] < 30 * 400 and found[1] <= 3 * found[0] + 400, found


def test_texts_that_python_works_on_at_once_are_bounded_by_bytes(spark, monkeypatch):
    """A pivot's rows stand together, so 256 rows of long texts are one text 256 times; and a batch of 10,000 long texts is large."""
    r = random.Random(6)
    long = [pa.array(["x" * r.choice([3, 300, 90_000, 2_000_000]) for _ in range(300)]) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), *long], ["a", "b", "text_a", "text_b"])
    parts = list(jaccard_join._parts(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    held = [sum(len(x.as_py()) for k in (2, 3) for x in part.column(k)) for part in parts]
    assert all(n <= SLICE_BYTES or part.num_rows == 1 for n, part in zip(held, parts)) and any(part.num_rows > 1 for part in parts)

    name, seen, inner = "spark.sql.execution.arrow.maxBytesPerBatch", [], Scratch.keep

    def spied(self, df, rows=None):
        seen.append(int(spark.conf.get(name).rstrip("b")))
        return inner(self, df, rows)

    monkeypatch.setattr(Scratch, "keep", spied)
    before = spark.conf.get(name)
    assert jaccard_components(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).count() == 2
    assert max(seen) <= 4 << 20 and spark.conf.get(name) == before


def test_jaccard_of_long_words_made_to_collide(spark):
    """Two words of 1,024 letters, each the other's complement, have one hash in any polynomial modulo 2**64."""
    bits = ["a"]
    for _ in range(10):
        bits.append("".join("b" if c == "a" else "a" for c in "".join(bits)))
    one = "".join(bits)
    other = "".join("b" if c == "a" else "a" for c in one)
    assert len(one) == 1024
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    tail = " " + " ".join(f"t{k}" for k in range(12))
    got = {x.doc_id: x.n_removed for x in remove_repeated_words(spark.createDataFrame([(1, one + tail), (2, other + tail), (3, one + tail)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_jaccard_null_ids_and_empty(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(None, text, 1), (9, text, 2), (9, text, 3), (4, "", 4)], "doc_id long, text string, component_id long")
    got = sorted(((x.doc_id is None, x.doc_id, x.component_id, x.n_shingles) for x in jaccard_components(docs).collect()), key=repr)
    assert got == [(False, 4, 4, 0), (False, 9, 9, 48), (False, 9, 9, 48), (True, None, 9, 48)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_texts_under_one_id_or_none(spark):
    """Brute force over (id, text): null and repeated ids link nothing, and near copies under one of them are found."""
    r = random.Random(8)
    fresh = lambda: [f"w{r.randint(0, 3000)}" for _ in range(80)]
    edited = lambda words: [*words[:-1], f"z{r.randint(0, 10**6)}"]
    near = [fresh() for _ in range(5)]
    rows = [(5, near[0]), (None, edited(near[0])), (None, fresh()), (None, fresh())]  # one null id links to 5, two are clean
    rows += [(None, near[1]), (None, edited(near[1])), (7, near[2]), (7, edited(near[2])), (7, fresh())]  # near copies under null and under 7
    rows += [(1, near[3]), (8, edited(near[3])), (8, near[4]), (9, edited(near[4])), (2**63 - 1, fresh())]  # 1 and 9 link to two texts of 8
    rows = [(i, " ".join(t)) for i, t in rows]
    rows += [rows[4], (3, ""), (None, ""), (None, None)]
    numbers = {x: k for k, x in enumerate(sorted({(i is None, i or 0, t or "") for i, t in rows}))}
    found = brute_jaccard([(k, x[2]) for x, k in numbers.items()])
    back = {k: x for x, k in numbers.items()}
    first = {back[k]: back[c] for k, _, c in found}
    want = sorted(((i, (lambda c: None if c[0] else c[1])(first[i is None, i or 0, t or ""])) for i, t in rows), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((x.doc_id, x.component_id) for x in jaccard_components(docs).collect()), key=repr) == want
    kept = sorted(((x.doc_id, x.text) for x in corpus_pipeline.distinct(spark, docs, "").collect()), key=repr)
    heads = {c for c in first.values() if c[2]}
    groups = defaultdict(list)
    for x, c in first.items():
        groups[c[0], c[1], {back[k][2]: back[n][2] for k, _, n in found}[x[2]]].append(x)
    assert len(kept) == len(heads) + 3 and len({t for _, t in kept if t}) == len(heads)
    for members in groups.values():
        some = [(None if none else i, t) for none, i, t in members if t]
        low = min(((i is None, i or 0) for i, _ in some), default=None)
        stay = [x for x in kept if x in some]
        assert not some or (len(stay) == 1 and (stay[0][0] is None, stay[0][0] or 0) == low)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def reshared(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, total, full = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | full
        full |= {s: 3 * sizes[s] for s in over}


def test_targets_against_resharing(spark):
    r = random.Random(1)
    for k in range(6):
        sizes = {f"s{i}": r.choice([0, 1, 5, 1000, r.randint(1, 10**6)]) for i in range(r.randint(1, 12))} | ({None: r.randint(1, 1000)} if k % 2 else {})
        sizes["s0"] += 1
        got = {x.source: x.target for x in targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(reshared(sizes))


def test_mix_comes_near_its_targets(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([0, 1, 7, 50, 300, 2000]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(docs).collect()
    assert sorted(x.doc_id for x in got) == list(range(600))
    assert all(x.size == len(rows[x.doc_id][1].split()) and x.taken == x.copies * x.size and 0 <= x.copies <= 3 for x in got)
    for source in ("a", "b", "c", None):
        own = [x for x in got if x.source == source]
        assert sum(x.size for x in own) == own[0].source_size
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
    assert sum({x.source: x.target for x in got}.values()) == pytest.approx(sum(x.size for x in got))
    again = mix(docs.repartition(7)).collect()
    assert {x.doc_id: x.copies for x in again} == {x.doc_id: x.copies for x in got}


def test_mix_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "a b", None, 2), (1, "a b", None, 3)], "doc_id long, text string, source string, rank long")
    got = Counter((x.doc_id, x.size, x.source_size, x.target, x.copies) for x in mix(docs).collect())
    assert got == Counter({(None, 0, 4, 4.0, 0): 1, (1, 2, 4, 4.0, 1): 2})
    assert mix(docs.limit(0)).count() == 0
    assert [x.taken for x in mix(docs.where("doc_id is null")).collect()] == [0]
