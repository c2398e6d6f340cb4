"""Quota, board, schedules, live state, trend and day keys: literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import measures as ms
from tallyloom.functions import names as nm
from tallyloom.functions import times as tm
from tallyloom.functions import tokens as tok
from tallyloom.operators import board, quota, trend, usage
from tallyloom.streaming import connection, live

WINDOW = "struct<used_percent:double,window_mins:int,resets_at:timestamp>"
SNAP = f"runtime string, snapshot_id bigint, captured_at timestamp, primary {WINDOW}, secondary {WINDOW}"
T0 = dt.datetime(2026, 7, 1)


@pytest.mark.parametrize("slots,ok,kinds", [
    ([300, 10080], True, {"fiveHour", "sevenDay"}), ([10080, 300], True, {"fiveHour", "sevenDay"}), ([43800], True, {"monthly"}), ([43200, None], True, {"monthly"}),
    ([300, 300], False, set()), ([1440], False, set()), (["null"], False, set()), ([], True, set()), ([300, 1440], False, set())])
def test_quota_windows(spark, one, slots, ok, kinds):
    def window(m):
        return None if m is None else (25.0, None if m == "null" else m, T0)

    first, second = ([window(m) for m in slots] + [None, None])[:2]
    row = one(quota.understand(spark.createDataFrame([("r", 1, T0, first, second)], SNAP)))
    assert row["ok"] is ok
    assert {k for k in quota.KINDS if row[k] is not None} == kinds


def test_failed_reads_keep_confirmed_windows(spark, rows):
    good = (25.0, 300, T0)
    data = [("r", 1, T0, None, (9.0, 1440, T0)), ("r", 2, T0 + dt.timedelta(minutes=5), good, None), ("r", 3, T0 + dt.timedelta(minutes=9), good, good),
            ("r", 4, T0 + dt.timedelta(hours=9), None, None), ("r", 5, T0 + dt.timedelta(hours=10), good, good)]
    out = quota.carry_history(quota.understand(spark.createDataFrame(data, SNAP)))
    assert rows(out, "snapshot_id", "status", F.col("fiveHour.used_percent").alias("u")) == [
        (1, "unavailable", None), (2, "available", 25.0), (3, "stale", 25.0), (4, "available", None), (5, "unavailable", None)]


def test_pairwise_reconcile_marks_once(spark, one):
    committed = quota.understand(spark.createDataFrame([("r", 1, T0, (25.0, 300, T0), None)], SNAP)).withColumns(
        {"status": F.lit("stale"), "label": F.lit("src · stale")})
    failed = quota.understand(spark.createDataFrame([("r", 2, T0, (1.0, 1440, T0), None)], SNAP)).withColumns(
        {"status": F.lit("localOnly"), "label": F.lit("new")})
    row = one(quota.reconcile(committed, failed))
    assert (row["status"], row["label"], row["fiveHour"].used_percent) == ("stale", "src · stale", 25.0)


def _next(spark, rule, now):
    df = spark.createDataFrame([("s", "n", "cron", rule)], "schedule_id string, name string, kind string, rrule string")
    row = board.cadence(board.next_runs(df, now)).collect()[0]
    return row.next_run_at, row.cadence


@pytest.mark.parametrize("rule,now,want,cadence", [
    ("DTSTART;TZID=Asia/Shanghai:20260101T090000\nRRULE:FREQ=DAILY;INTERVAL=1", "2026-12-31 23:30:00", "2027-01-01 01:00:00", "daily 09:00"),
    ("DTSTART;TZID=Asia/Shanghai:20260629T090000\nRRULE:FREQ=WEEKLY;BYDAY=MO,WE,FR;INTERVAL=1", "2026-07-16 02:00:00", "2026-07-17 01:00:00", "weekly MO,WE,FR 09:00"),
    ("RRULE:FREQ=WEEKLY;BYHOUR=11;BYMINUTE=0;BYDAY=MO,WE,FR", "2026-07-16 02:00:00", None, "weekly MO,WE,FR 11:00"),
    ("DTSTART;TZID=Asia/Shanghai:20260716T090000\nRRULE:FREQ=MINUTELY;INTERVAL=30", "2026-07-16 02:00:00", None, "minutely 30"),
    ("DTSTART;TZID=Nowhere/Zone:20260716T090000\nRRULE:FREQ=DAILY", "2026-07-16 02:00:00", None, "daily"),
    ("DTSTART;TZID=UTC:20260716T0900\nRRULE:FREQ=WEEKLY", "2026-07-16 09:00:00", "2026-07-23 09:00:00", "weekly 09:00"),
    ("DTSTART;TZID=UTC:20260720T090000\nRRULE:FREQ=DAILY", "2026-07-16 09:00:00", "2026-07-20 09:00:00", "daily 09:00"),
    ("DTSTART;TZID=America/Los_Angeles:20260101T023000\nRRULE:FREQ=DAILY", "2026-03-08 08:00:00", "2026-03-08 10:00:00", "daily 02:30"),
    ("DTSTART;TZID=UTC:20260101T090000\nRRULE:FREQ=DAILY;INTERVAL=2", "2026-07-16 09:00:00", None, "daily 09:00"),
])
def test_next_run(spark, rule, now, want, cadence):
    at, text = _next(spark, rule, now)
    assert at == (dt.datetime.fromisoformat(want) if want else None) and text == cadence


def test_day_keys(spark, one):
    event = F.to_timestamp(F.lit("2026-09-04 17:30:00"))
    la = "America/Los_Angeles"
    row = one(spark.range(1).select(
        tm.day_key(event).alias("utc"), tm.day_key(event, "Asia/Shanghai").alias("cn"),
        *[((F.unix_seconds(tm.day_start(F.date_add(F.lit(d).cast("date"), 1), la)) - F.unix_seconds(tm.day_start(F.lit(d).cast("date"), la))) / 3600).alias(d)
          for d in ("2026-03-08", "2026-11-01", "2026-06-01")]))
    assert tuple(row.values()) == ("2026-09-04", "2026-09-05", 23, 25, 24)


def test_25000_events_are_conserved(spark):
    events = spark.range(25_000).select(F.timestamp_seconds(1_767_225_600 + F.col("id") * 37).alias("ts"))
    assert events.groupBy(tm.day_key("ts", "America/Los_Angeles")).count().agg(F.sum("count")).first()[0] == 25_000


def test_parse_instant(spark, rows):
    texts = ["2026-07-01T00:00:00Z", "2026-07-01T00:00:00.250Z", "1782864000", "1782864000000", "0", "-5", "junk", None]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tm.parse_instant("t").alias("v"))
    base = dt.datetime(2026, 7, 1)
    assert [v for _, v in rows(out)] == [base, base.replace(microsecond=250_000), base, base, None, None, None, None]


def test_text_tokens(spark, rows):
    out = spark.createDataFrame([("",), (" \n",), ("abcd",), ("漢字ab",), ("한글",)], "t string").select("t", ms.text_tokens("t").alias("n"))
    assert dict(map(tuple, out.collect())) == {"": 0, " \n": 1, "abcd": 2, "漢字ab": 3, "한글": 2}


@pytest.mark.parametrize("detailed,approximate,want", [(119_100_000_000, 2_000_000_000, True), (2_382_000_000, 2_465_000_000, False), (2_000_000_000, 0, False)])
def test_source_guard(spark, detailed, approximate, want):
    assert spark.range(1).select(usage.is_suspicious(F.lit(detailed), F.lit(approximate))).first()[0] is want


MODEL_DAYS = [(f"m{i}", f"m{i}", dt.date(2026, 6, 1) + dt.timedelta(days=d), (10 - i) * (d + 1), (i + 1) * (d + 1) / 10) for i in range(10) for d in range(32)]


@pytest.fixture
def model_days(spark):
    df = spark.createDataFrame(MODEL_DAYS, "model_id string, model string, day date, tokens bigint, cost double")
    zero = F.lit(0).cast("bigint")
    return df.select("*", F.col("cost").cast("decimal(38,9)").alias("cost_usd"), F.col("tokens").alias("total_tokens"),
                     *[zero.alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")]).drop("cost")


def test_ten_models_become_eight_and_others(model_days, rows):
    out = trend.area_series(model_days, "2026-07-02 12:00:00", 32)
    assert out.select("series_id").distinct().count() == 9 and out.count() == 9 * 32
    other = out.where("is_aggregate").orderBy("day").first()
    assert (other.tokens, other.cost_usd) == (3, 1.9)
    per_day = out.groupBy("day").agg(F.sum("tokens").alias("t")).orderBy("day").collect()
    assert [r.t for r in per_day] == [55 * (d + 1) for d in range(32)]
    assert trend.area_series(model_days, "2026-07-02 12:00:00", 30).select("day").distinct().count() == 30
    assert trend.area_series(model_days, "2026-07-02 12:00:00", 30, quality="approximate").where("cost_usd is not null").count() == 0


def test_price_order_and_default(spark, rows):
    data = [("gpt-5.5-pro",), ("GPT-5.5",), ("gpt-5.4-mini",), ("gpt-5.4",), ("gpt-5",), ("gpt-5x",), (None,)]
    df = spark.createDataFrame(data, "m string").select("m", tok.model_price("m", "input", "log").cast("double").alias("p"))
    assert dict(map(tuple, df.collect())) == {"gpt-5.5-pro": 30, "GPT-5.5": 5, "gpt-5.4-mini": 0.75, "gpt-5.4": 2.5, "gpt-5": 1.25, "gpt-5x": 5, None: 5}


EVENT = "thread_id string, event_seq bigint, method string, status string, flag string, turn_id string, name string, ts timestamp"


def test_live_states_and_disconnect(spark, rows):
    data = [("a", 1, "turn/started", None, None, "t1", None, T0), ("b", 2, "thread/status/changed", "active", "waitingOnUserInput", None, None, T0),
            ("c", 3, "turn/completed", "failed", None, "t2", None, T0), ("d", 4, "item/completed", "completed", None, None, None, T0),
            ("e", 5, "thread/status/changed", "notLoaded", None, None, None, T0), ("a", 6, "item/completed", "failed", None, None, None, T0)]
    events = spark.createDataFrame(data, EVENT)
    states = live.fold_events(events)
    assert rows(live.downgrade(states, True), "thread_id", "state", "turn_id", "is_realtime") == [
        ("a", "failed", "t1", True), ("b", "waitingInput", None, True), ("c", "failed", "t2", True), ("e", "recorded", None, False)]
    assert rows(live.downgrade(states, False), "thread_id", "state", "is_realtime") == [
        ("a", "failed", False), ("b", "disconnected", False), ("c", "failed", False), ("e", "recorded", False)]


def test_merge_order_does_not_matter(spark, rows):
    data = [("a", 1, "turn/started", None, None, "t1", None, T0), ("a", 2, "turn/completed", "completed", None, "t2", "n", T0),
            ("a", 3, "thread/status/changed", "idle", None, None, None, T0), ("b", 2, "turn/started", None, None, "x", None, T0)]
    fold = lambda part: connection.fold(spark.createDataFrame(part, EVENT).withColumns({"generation": F.lit(0), "hidden": F.lit(False)}))
    parts, columns = [fold([r]) for r in data], ("thread_id", "state", "name", "turn_id", "event_seq", "listed_to")
    whole = rows(fold(data), *columns)
    assert whole == rows(live.fold_events(spark.createDataFrame(data, EVENT)).withColumn("listed_to", F.lit(None)), *columns)
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
        out = parts[order[0]]
        for i in order[1:]:
            out = connection.combine(out.unionByName(parts[i]))
        assert rows(out, *columns) == whole


def test_tool_estimates_go_with_rejected_usage(spark, rows):
    tools = spark.createDataFrame([("shell", 3, 40, 0.5), ("other", 1, None, None)], "tool_name string, call_count bigint, estimated_tokens bigint, estimated_cost_usd double")
    choice = lambda *flags: spark.createDataFrame([(f,) for f in flags], "suspicious boolean")
    assert rows(usage.null_tool_estimates(tools, choice(False, True))) == [("other", 1, None, None), ("shell", 3, None, None)]
    assert rows(usage.null_tool_estimates(tools, choice(False, False))) == rows(tools) == rows(usage.null_tool_estimates(tools, choice()))


def test_statuses_of_all_runtimes(spark, rows):
    """Every status in its precedence: with and without snapshot, file and usage."""
    slot = "struct<used_percent:double,window_mins:int,resets_at:timestamp>"
    snaps = quota.understand(spark.createDataFrame(
        [("old", 1, T0 - dt.timedelta(hours=1), (25.0, 300, None), None), ("good", 2, T0, (25.0, 300, None), None), ("good", 1, T0 - dt.timedelta(hours=9), None, None), ("empty", 3, T0, None, None)],
        f"runtime string, snapshot_id bigint, captured_at timestamp, primary {slot}, secondary {slot}"))
    runtimes = spark.createDataFrame([("old", True, True), ("good", True, True), ("empty", True, False), ("usage", False, True), ("nothing", False, False), ("file", True, False)], "runtime string, exists boolean, has_usage boolean")
    now = str(T0 + dt.timedelta(minutes=15))
    assert rows(quota.latest_status(snaps, now, runtimes), "runtime", "status") == [
        ("empty", "localOnly"), ("file", "localOnly"), ("good", "available"), ("nothing", "unavailable"), ("old", "stale"), ("usage", "snapshotNeeded")]
    assert rows(quota.latest_status(snaps, now), "runtime", "status") == [("empty", "localOnly"), ("good", "available"), ("old", "stale")]


def test_board_attention_order(spark, one):
    items = spark.createDataFrame([("i1", "t1", "late", T0 + dt.timedelta(hours=1), "failed"), ("i2", "t2", "early", T0, "failed"), ("i3", "t3", "wait", T0, "waitingInput")],
                                  "item_id string, thread_id string, title string, updated_at timestamp, runtime_state string")
    statuses = spark.createDataFrame([("r", "stale", T0 - dt.timedelta(days=1)), ("s", "available", T0)], "runtime string, status string, since timestamp")
    assert one(board.attention(items, statuses))["title"] == "early"
    assert one(board.attention(items.where("runtime_state <> 'failed'"), statuses))["title"] == "r"


def test_two_hour_window(spark, rows):
    now = F.to_timestamp(F.lit("2026-07-01 12:00:00"))
    df = spark.createDataFrame([(dt.datetime(2026, 7, 1, 10),), (dt.datetime(2026, 7, 1, 9, 59, 59),), (None,)], "t timestamp")
    assert rows(df.select(nm.activity_column("t", now))) == [("active",), ("pending",), ("pending",)]
