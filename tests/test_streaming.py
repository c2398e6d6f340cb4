"""Streaming runs end in the same tables as the batch operators, whatever the batches, retries and merges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import counters, usage
from tallyloom.plans import views
from tallyloom.streaming import connection, jobs, levels, live, tables
from tallyloom.streaming import counters as stream_counters

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)
EVENT = "thread_id string, event_seq bigint, method string, status string, flag string, turn_id string, name string, hidden boolean, ts timestamp"


# ------------------------------------------------------------------ levels


def sums(spark, path, fan):
    return levels.LevelledTable(spark, path, "key bigint, total bigint", lambda rows: rows.groupBy("key").agg(F.sum("total").alias("total")), fan)


def test_levels_stay_few_and_whole(spark, rows, tmp_path):
    """Folders do not grow with batches; every retry, also of a batch that is merged already, changes nothing."""
    table, most = sums(spark, str(tmp_path / "t"), 2), 0
    assert table.current().count() == 0
    for n in range(20):
        part = spark.createDataFrame([(n % 3, 1), (7, n)], "key bigint, total bigint")
        table.append(n, part)
        if n % 5 == 0:
            table.append(n, part)  # tried again
        most = max(most, len(list((tmp_path / "t").iterdir())))
        if n % 4 == 3:
            assert {r.key: r.total for r in table.before(n).collect()}.get(7, 0) == sum(range(n))
    assert most <= 2 * 5 + 2 and len(table._cover()) <= 6
    assert rows(table.current()) == [(0, 7), (1, 7), (2, 6), (7, sum(range(20)))]
    table.append(3, spark.createDataFrame([(3 % 3, 1), (7, 3)], "key bigint, total bigint"))  # long merged: ignored
    assert rows(table.current()) == [(0, 7), (1, 7), (2, 6), (7, sum(range(20)))]


def test_an_incomplete_folder_is_not_read(spark, rows, tmp_path):
    table = sums(spark, str(tmp_path / "t"), 4)
    table.append(0, spark.createDataFrame([(1, 5)], "key bigint, total bigint"))
    table.append(1, spark.createDataFrame([(1, 6)], "key bigint, total bigint"))
    (tmp_path / "t" / "0-1-1" / "_SUCCESS").unlink()
    assert rows(table.current()) == [(1, 5)]


# -------------------------------------------------------------- connection


def reduced(events):
    """The records by walking the rows one by one: {thread: (state, name, turn, time, real time)}."""
    records, connected, open_list = {}, False, None
    for thread, _, method, status, flag, turn, name, hidden, ts in events:
        if method == connection.LIST_START:
            # The whole snapshot counts from its start, so its rows are looked up ahead.
            open_list = {r[0] for r in events if r[2] == live.LIST and not r[7] and started(events, r[1]) == started(events, _)}
            records = {t: r for t, r in records.items() if t in open_list}
            connected = True
        elif method == live.DISCONNECT:
            connected = False
            records = {t: ("disconnected" if s in ("running", "waitingInput") else s, n, u, at, False) for t, (s, n, u, at, _) in records.items()}
        elif thread is not None and method != live.CONNECT and not (method == live.LIST and hidden):
            state = {"turn/started": "running", "turn/completed": {"completed": "completed", "failed": "failed"}.get(status, "recorded")}.get(method)
            if method in (live.LIST, "thread/status/changed"):
                state = {"active": "waitingInput" if flag == "waitingOnUserInput" else "running", "idle": "idle"}.get(status, "recorded")
            if method == "item/completed":
                state = "failed" if status == "failed" else None
            if state:
                old = records.get(thread, (None,) * 5)
                records[thread] = (state, name or old[1], turn or old[2], ts or old[3], connected and state not in ("recorded", "disconnected"))
    return records


def started(events, seq):
    return sum(e[2] == connection.LIST_START and e[1] <= seq for e in events)


def connection_log(seed, n=160, threads=6):
    r = random.Random(seed)
    log = []
    for k in range(n):
        thread = f"t{r.randrange(threads)}"
        kind = r.random()
        at = T0 + datetime.timedelta(seconds=k)
        if kind < 0.05:
            log.append((None, k, connection.LIST_START, None, None, None, None, None, None))
        elif kind < 0.09:
            log.append((None, k, r.choice([live.DISCONNECT, live.CONNECT]), None, None, None, None, None, None))
        elif kind < 0.3:
            log.append((thread, k, live.LIST, r.choice(["active", "idle", "notLoaded"]), None, None, r.choice([None, f"name {k}"]), r.random() < 0.2, r.choice([None, at])))
        elif kind < 0.6:
            log.append((thread, k, "turn/started", None, None, f"turn {k}", None, None, at))
        elif kind < 0.8:
            log.append((thread, k, "turn/completed", r.choice(["completed", "failed", "else"]), None, r.choice([None, f"turn {k}"]), None, None, at))
        elif kind < 0.9:
            log.append((thread, k, "thread/status/changed", "active", r.choice([None, "waitingOnUserInput"]), None, None, None, at))
        else:
            log.append((thread, k, "item/completed", r.choice(["failed", "completed"]), None, None, None, None, at))
    return log


@pytest.mark.parametrize("seed", range(2))
def test_one_stream_against_walking_the_rows(spark, tmp_path, seed):
    """Lists, losses and notifications in random batches, some of them tried again, with merges in between."""
    log, r = connection_log(seed), random.Random(seed)
    threads = connection.LiveThreads(spark, str(tmp_path / "live"), fan=2)
    edges = sorted(r.sample(range(1, len(log)), 4)) + [len(log)]
    begin = 0
    for n, end in enumerate(edges):
        shuffled = r.sample(log[begin:end], end - begin)
        for _ in range(1 + (n % 2)):
            threads.keep()(spark.createDataFrame(shuffled, EVENT), n)
        begin = end
        if n in (2, 4):
            # What counts as listed must be known: a list may go on in later batches.
            want = reduced(log[:end])
            got = {x.thread_id: (x.state, x.name, x.turn_id, x.updated_at, x.is_realtime) for x in threads.current().collect()}
            assert got == want


def test_real_time_only_after_the_list_that_follows_a_reconnect(spark, tmp_path):
    threads = connection.LiveThreads(spark, str(tmp_path / "live"))

    def told(*events):
        threads.keep()(spark.createDataFrame([(t, n, m, s, None, None, None, False, T0) for t, n, m, s in events], EVENT), told.batch)
        told.batch += 1
        return {x.thread_id: (x.state, x.is_realtime) for x in threads.current().collect()}

    told.batch = 0
    assert told(("a", 1, "turn/started", None)) == {"a": ("running", False)}  # never connected
    assert told((None, 2, connection.LIST_START, None), ("a", 3, live.LIST, "active"), ("b", 4, live.LIST, "idle")) == {"a": ("running", True), "b": ("idle", True)}
    assert told((None, 5, live.DISCONNECT, None)) == {"a": ("disconnected", False), "b": ("idle", False)}
    assert told((None, 6, live.CONNECT, None), ("c", 7, "turn/started", None)) == {"a": ("disconnected", False), "b": ("idle", False), "c": ("running", False)}
    assert told((None, 8, connection.LIST_START, None), ("b", 9, live.LIST, "active")) == {"b": ("running", True)}
    assert told((None, 10, connection.LIST_START, None)) == {}


def test_live_state_phases(spark):
    seen = {(x.phase, x.is_realtime) for x in jobs.run_live_state(spark, SF).collect()}
    assert ("listed", True) in seen and ("end", True) in seen and ("lost", True) not in seen and ("opened", True) not in seen


# ---------------------------------------------------------------- counters


def test_counters(spark, rows):
    columns = ("thread_id", "line_no", *counters.FIELDS)
    assert rows(jobs.run_counters(spark, SF, lines_per_slot=8), *columns) == rows(counters.normalise(views.counter_log(spark, SF)), *columns)


def test_hot_session_over_slots_and_batches(spark, rows, tmp_path):
    """A session with most lines, cut into many slots and batches with restarts, equals one walk over the whole log."""
    r = random.Random(4)
    vector = lambda v: None if v is None else tuple(v)
    data, total = [], [0] * 5
    for n in range(400):
        total = [0] * 5 if r.random() < 0.05 else [t + r.randrange(4) for t in total]
        cum = None if r.random() < 0.1 else [t if r.random() > 0.1 else None for t in total]
        data.append(("hot", n, "token_count", vector(cum), vector([1, None, 2, 0, 3]) if r.random() < 0.2 else None, T0))
        if n % 9 == 0:
            data.append((f"s{n % 4}", n, "token_count", vector([n] * 5), None, T0))
    parts = ", ".join(f"{f}:bigint" for f in counters.FIELDS)
    shape = f"thread_id string, line_no bigint, line_type string, cum struct<{parts}>, last struct<{parts}>, ts timestamp"
    log = spark.createDataFrame(data, shape)
    stream = stream_counters.CounterStream(spark, str(tmp_path / "c"), lines_per_slot=7, fan=2)
    for n, (low, high) in enumerate(zip([0, 90, 91, 200, 333], [90, 91, 200, 333, 400])):
        part = log.where((F.col("line_no") >= low) & (F.col("line_no") < high)).repartition(3)
        for _ in range(1 + n % 2):  # every other batch is tried twice
            stream.keep()(part, n)
    columns = ("thread_id", "line_no", *counters.FIELDS)
    assert rows(stream.deltas(), *columns) == rows(counters.normalise(log), *columns)
    assert len(list((tmp_path / "c" / "states").iterdir())) <= 8


# -------------------------------------------------------------- daily mart


def test_daily_mart_retries_late_rows_and_zones(spark, rows, tmp_path):
    columns = ("day", "tokens", "cost_usd")
    ledger = views.usage_events(spark, SF)
    want = rows(usage.daily(ledger), *columns)
    assert rows(jobs.run_daily(spark, SF), *columns) == want
    mart = tables.DailyMart(spark, str(tmp_path / "mart"), fan=2)
    part = lambda n: ledger.where(F.col("seq") % 4 == n)
    for n in (0, 1, 1, 2):  # batch 1 is tried twice
        mart.append(n, part(n))
    # A correction: the rows of batch 2 are withdrawn, so the days they touch are counted anew.
    corrected = ledger.where(F.col("seq") % 4 < 2)
    mart.rebuild(3, corrected, part(2))
    assert rows(mart.current(), *columns) == rows(usage.daily(corrected), *columns)
    for n, k in ((4, 2), (5, 3)):
        mart.append(n, part(k))
    assert rows(mart.current(), *columns) == want
    mart.rezone(6, ledger.where(F.col("seq") % 4 < 4), "Asia/Shanghai")
    assert rows(mart.current(), *columns) == rows(usage.daily(ledger, "Asia/Shanghai"), *columns) != want
    assert len(list((tmp_path / "mart").iterdir())) <= 8
    touched = ledger.where("ts >= timestamp'2024-01-29'")
    fresh = rows(tables.rebuild_days(ledger, touched), *columns)
    assert fresh == [r for r in want if str(r[0]) >= "2024-01-29"]
