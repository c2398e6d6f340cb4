"""Counter normaliser: literal cases, slot independence and the brute-force walk."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import counters, lineage
from tallyloom.operators.counters import FIELDS, step
from tallyloom.plans import derived, views

SAMPLE = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>"
LINE = f"thread_id string, line_no bigint, line_type string, cum {SAMPLE}, last {SAMPLE}"


def v(i=None, c=None, o=None, r=None, t=None):
    return (i, c, o, r, t)


def walk(events):
    state, out = None, []
    for cum, last in events:
        state, delta = step(state, cum, last)
        out.append(delta)
    return out


def test_growth_prefers_the_events_own_usage():
    out = walk([
        (v(80, 50, 20, 10, 100), v(80, 50, 20, 10, 100)),
        (v(120, 70, 25, None, 145), v(40, 20, 5, 0, 45)),
        (v(130, 60, 27, 2, 157), v(10, 0, 2, 0, 12)),
        (v(130, 60, 27, 2, 157), v(10, 0, 2, 0, 12)),
        (v(140, 75, 30, 12, 170), v(10, 5, 3, 2, 13)),
        (v(80, 40, 20, 5, 100), v(8, 4, 2, 1, 10)),
        (v(90, 45, 22, 5, 112), v(10, 5, 2, 0, 12)),
    ])
    assert out[0][4] == 100
    assert out[1] == (40, 20, 5, 0, 45)
    assert (out[2][4], out[2][1]) == (12, 0)
    assert out[3] is None
    assert (out[4][1], out[4][4]) == (5, 13)
    assert (out[5][4], out[5][0]) == (10, 8)
    assert out[6][4] == 12


def test_sixty_restarts():
    events = [(v(1800, 1500, 200, 50, 2000), v(8, 6, 2, 1, 10))]
    for _ in range(60):
        events.append((v(900, 750, 100, 25, 1000), v(8, 6, 2, 1, 10)))
        events.append((v(1800, 1500, 200, 50, 2000), v(8, 6, 2, 1, 10)))
    assert sum(d[4] for d in walk(events) if d) == 1210


def test_without_cumulative_and_without_own_usage():
    assert walk([(None, v(25, 20, 3, 1, 28))]) == [(25, 20, 3, 1, 28)]
    assert walk([(v(1000, 800, 100, 50, 1100), None), (v(1010, 0, 105, 0, 1115), None)])[1] == (10, 0, 5, 0, 15)
    assert walk([(v(5, 0, 0, 0, -1), v(1, 0, 1, 0, 2)), (v(0, 0, 0, 0, 0), None)]) == [(1, 0, 1, 0, 2), None]


def _random_log(seed, threads=4, lines=400):
    rng = random.Random(seed)
    for thread in range(threads):
        level = [rng.randint(0, 50) for _ in range(5)]
        for line in range(lines):
            kind = rng.random()
            if kind < 0.08:
                level = [rng.randint(0, 30) for _ in range(5)]
            elif kind < 0.2:
                level = [max(0, x + rng.randint(-20, 10)) for x in level]
            else:
                level = [x + rng.randint(0, 12) for x in level]
            cum = None if rng.random() < 0.1 else tuple(None if rng.random() < 0.1 else x for x in level)
            if cum and rng.random() < 0.05:
                cum = (*cum[:4], -1)
            own = None if rng.random() < 0.4 else tuple(rng.randint(0, 4) for _ in range(5))
            yield (f"t{thread}", line * 3 + 1, "token_count" if rng.random() < 0.9 else "turn_context", cum, own)


@pytest.mark.parametrize("width", [1, 5, 64, 10_000])
def test_slots_do_not_change_the_result(spark, rows, width):
    log = list(_random_log(3))
    want = []
    for thread in sorted({r[0] for r in log}):
        state = None
        for _, line, kind, cum, own in (r for r in log if r[0] == thread):
            if kind != "token_count" or (cum is None and own is None):
                continue
            state, delta = step(state, cum, own)
            if delta:
                want.append((thread, line, *delta))
    out = counters.normalise(spark.createDataFrame(log, LINE), width).select("thread_id", "line_no", *FIELDS)
    assert rows(out) == sorted(want, key=repr)


def test_slot_effect_matches_a_walk_from_any_state():
    rng = random.Random(11)
    for trial in range(60):
        samples = [r[3] for r in _random_log(trial, 1, 25)]
        effect = counters.SlotEffect()
        for s in samples:
            effect.add(s)
        for _ in range(20):
            start = tuple(rng.randint(0, 200) for _ in range(5))
            state = start
            for s in samples:
                if counters.is_usable(s):
                    state = counters.advance(state, s)
            assert counters.apply_effect(start, effect.rows(), effect.peak, effect.seen) == state


def _events(spark, **threads):
    data = [(t, n, "token_count", cum, last) for t, events in threads.items() for n, (cum, last) in enumerate(events)]
    return spark.createDataFrame(data, LINE)


def test_inherited_prefix_and_baseline(spark, one, rows):
    def event(total, last):
        return v(i=total, t=total), v(i=last, t=last)

    parent = [event(100, 100), event(160, 60), event(240, 80), event(300, 60)]
    child = [event(100, 100), event(160, 60), event(240, 80), event(275, 35)]
    stranger = [event(90, 90)]
    numbered = lineage.number_deltas(counters.normalise(_events(spark, p=parent, c=child, s=stranger, lost=child)))
    parents = spark.createDataFrame([("c", "p"), ("s", "p"), ("lost", "gone")], "thread_id string, parent_id string")
    prefixes = lineage.inherited_prefix(numbered, parents)
    assert rows(prefixes, "thread_id", "prefix") == [("c", 3), ("lost", 0), ("s", 0)]
    assert rows(lineage.fork_baselines(numbered, prefixes)) == [("c", 240)]
    kept = lineage.drop_inherited(numbered, prefixes).groupBy("thread_id").agg(F.sum("total_tokens"))
    assert rows(kept) == [("c", 35), ("lost", 275), ("p", 300), ("s", 90)]
    threads = spark.createDataFrame([("c", 200), ("p", 300)], "thread_id string, tokens_used bigint")
    assert rows(lineage.adjust_threads(threads, lineage.fork_baselines(numbered, prefixes)), "thread_id", "tokens_used") == [("c", 0), ("p", 300)]
    counts = lineage.event_counts(numbered, prefixes)
    assert rows(counts)[0] == ("c", 1)


def test_model_carry_forward(spark, rows):
    lines = spark.createDataFrame(
        [("a", 1, "token_count", None), ("a", 2, "turn_context", " m1 "), ("a", 3, "token_count", None),
         ("a", 4, "turn_context", None), ("a", 5, "token_count", None), ("a", 6, "turn_context", "m2"), ("a", 7, "token_count", None)],
        "thread_id string, line_no bigint, line_type string, model string",
    )
    threads = spark.createDataFrame([("a", "own")], "thread_id string, model string")
    out = lineage.carry_model(lines, threads).where("line_type = 'token_count'")
    assert rows(out, "line_no", "model") == [(1, "own"), (3, "m1"), (5, "own"), (7, "m2")]
    bare = lineage.carry_model(lines).where("line_type = 'token_count'")
    assert rows(bare, "line_no", "model") == [(1, None), (3, "m1"), (5, None), (7, "m2")]


def test_step_sits_directly_on_a_window(spark):
    """The planner itself keeps a slot's lines together and in order: no repartition it may undo."""
    log = spark.createDataFrame(list(_random_log(1, 2, 40)), LINE)
    plan = counters.normalise(log, 8)._jdf.queryExecution().sparkPlan().toString()
    nodes = [line.strip(" :+-") for line in plan.splitlines()]
    steps = [at for at, node in enumerate(nodes) if node.startswith("MapInArrow")]
    assert len(steps) == 3
    for at in steps:
        below = next(n for n in nodes[at + 1:] if not n.startswith("Project"))
        assert below.startswith("Window"), below


def test_many_long_sessions_do_not_depend_on_slots(spark):
    """Enough rows for several Arrow batches per task and for joins planned both ways."""
    base = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("thread_id"), F.col("id").alias("line_no"),
        F.lit("token_count").alias("line_type"), (F.abs(F.xxhash64("id")) % 5000).alias("h"))
    total = F.col("line_no") % 9000 * 3 + F.col("h") % 700
    vector = lambda t: F.struct(*[F.floor(t * w).alias(n) for n, w in zip(FIELDS, (0.9, 0.5, 0.1, 0.02, 1.0))])
    log = base.select("thread_id", "line_no", "line_type", F.when(F.col("h") % 11 != 0, vector(total)).alias("cum"),
                      F.when(F.col("h") % 4 == 0, vector(F.col("h") % 50)).alias("last"))
    seen = set()
    for broadcast, width in (("-1", 1 << 40), ("-1", 3000), ("10MB", 3000), ("10MB", 17_000)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            out = counters.normalise(log, width)
            seen.add(tuple(out.agg(F.count("*"), F.sum("total_tokens"), F.sum(F.xxhash64("thread_id", "line_no", *FIELDS) % 1_000_003)).first()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 1


def test_short_slots_share_batches():
    """As many batches leave the slot step as come in, however short the slots are."""
    vector = {n: 5 for n in counters.FIELDS}
    rows = [{"thread_id": f"t{n}", "_slot": 0, "_n": 1, "cum": vector} for n in range(50)]
    kind = pa.struct([(n, pa.int64()) for n in counters.FIELDS])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("thread_id", pa.string()), ("_slot", pa.int64()), ("_n", pa.int32()), ("cum", kind)]))
    out = list(counters._effects([batch, batch]))
    assert len(out) <= 3 and [r["thread_id"] for b in out for r in b.to_pylist()] == [r["thread_id"] for r in rows] * 2
    assert all(r["peak"] == [5] * 5 for b in out for r in b.to_pylist())


def test_fixture_log_reads_events_once(spark, tmp_path):
    """The log is built from stages that are written, not from events scanned again for every ordered step."""
    data = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), n % 3, "signup" if n % 9 == 0 else "click", 1.5, '{"k": %d}' % (n % 20)) for n in range(60)]
    spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    log = views.counter_log(spark, str(tmp_path))
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "props" not in plan
    lines = derived.session_log_lines(spark, str(tmp_path))
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # Lines of k = 3 and 13 are written twice.
    assert log.where("line_type = 'token_count'").count() == 60 + 3 + 3
