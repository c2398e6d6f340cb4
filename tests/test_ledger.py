"""Raw files to ledger, work intervals and snapshot, end to end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.operators import board, intervals, quota, usage
from tallyloom.plans import ledger
from tallyloom.sources import logs, sinks

from test_sources import token, write

AS_OF = "2026-07-01 12:00:00"


def counts(i, c, o, t):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 0, "total_tokens": t}


@pytest.fixture
def files(tmp_path):
    first = [token("2026-07-01T01:00:00Z", counts(1000, 500, 100, 1100), counts(1000, 500, 100, 1100)),
             token("2026-07-01T02:00:00Z", counts(3000, 1500, 300, 3300), counts(2000, 1000, 200, 2200))]
    write(tmp_path / "logs/parent.jsonl", [
        {"timestamp": "2026-07-01T00:00:00Z", "type": "turn_context", "payload": {"model": "gpt-5.4"}}, *first,
        {"timestamp": "2026-07-01T02:00:01Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "cat /home/u/s/SKILL.md"}},
        {"timestamp": "2026-07-01T02:00:02Z", "type": "event_msg", "payload": {"type": "task_complete", "turn_id": "t", "completed_at": 1_782_871_200, "duration_ms": 1_800_000}},
    ])
    write(tmp_path / "logs/child.jsonl", [
        {"timestamp": "2026-07-01T03:00:00Z", "type": "session_meta", "payload": {"id": "child", "forked_from_id": "parent"}}, *first,
        token("2026-07-01T04:00:00Z", counts(3500, 1500, 300, 3800), None)])
    write(tmp_path / "tr/-w-app/s.jsonl", [
        {"timestamp": "2026-07-01T05:00:00Z", "cwd": "/w/app", "message": {"id": "m", "model": "claude-haiku", "usage": {"input_tokens": 10, "output_tokens": 5}}},
        {"timestamp": "2026-07-01T06:00:00Z", "subtype": "turn_duration", "durationMs": 60_000}])
    write(tmp_path / "tr/-w-app/s/subagents/agent-x.jsonl", [{"timestamp": "2026-07-01T05:00:00Z", "usage": 1}, {"timestamp": "2026-07-01T05:30:00Z", "usage": 1}])
    return tmp_path


@pytest.fixture
def threads(spark):
    t = dt.datetime(2026, 7, 1)
    return spark.createDataFrame(
        [("parent", "Build", "/w/app", None, 3300, t, t + dt.timedelta(hours=2), "user"), ("child", "Fork", "/w/lib", "gpt-5", 3800, t, t + dt.timedelta(hours=4), "subagent")],
        "thread_id string, title string, cwd string, model string, tokens_used bigint, created_at timestamp, updated_at timestamp, thread_source string")


def test_ledger_drops_inherited_usage(spark, files, threads, rows):
    out, baselines = ledger.log_ledger(logs.scan_session_logs(spark, str(files / "logs")), threads)
    assert rows(out, "thread_id", "total_tokens", "model", "project_path", F.col("cost_usd").cast("double")) == [
        ("child", 500, "gpt-5", "/w/lib", 0.000625), ("parent", 1100, "gpt-5.4", "/w/app", 0.002875), ("parent", 2200, "gpt-5.4", "/w/app", 0.00575)]
    assert rows(baselines) == [("child", 3300)]
    both = ledger.read_everything(spark, str(files / "logs"), str(files / "tr"), threads)
    assert rows(both.groupBy("runtime").agg(F.sum("total_tokens"))) == [("log", 3800), ("transcript", 15)]


def test_ledger_from_a_store_of_parsed_files(spark, files, threads, rows, tmp_path):
    """A second run reads the changed file only and gives what reading everything gives."""
    def both(store=None):
        out = ledger.read_everything(spark, str(files / "logs"), str(files / "tr"), threads, store)
        return rows(out, "runtime", "thread_id", "total_tokens", "model", "project_path", "ts")

    store = str(tmp_path / "store")
    assert both(store) == both()
    with open(files / "tr/-w-app/s.jsonl", "a") as file:
        file.write(json.dumps({"timestamp": "2026-07-01T07:00:00Z", "message": {"id": "n", "usage": {"input_tokens": 4, "output_tokens": 2}}}) + "\n")
    after = both(store)
    assert after == both() and ("transcript", "s", 6) in {r[:3] for r in after}


def test_snapshot_from_files(spark, files, threads, rows, tmp_path):
    records = logs.scan_session_logs(spark, str(files / "logs"))
    events, _ = ledger.log_ledger(records, threads)
    calls = logs.call_lines(records)
    loads = spark.createDataFrame([("parent", "/home/u/s/SKILL.md", dt.datetime(2026, 7, 1, 2))], "thread_id string, skill_path string, ts timestamp")
    catalog = spark.createDataFrame([("/home/u/s/SKILL.md", 40, 9)], "skill_path string, byte_count bigint, token_estimate bigint")
    edges = spark.createDataFrame([("parent", "child")], "parent_thread_id string, child_thread_id string")
    work, workers = ledger.log_work(logs.scan_session_logs(spark, str(files / "logs"), logs.WORK_TYPES), threads, edges, AS_OF)
    assert rows(workers, "worker_id", "worker_kind", "parent_id") == [("log:main:parent", "main", None), ("log:subagent:child", "subagent", "log:main:parent")]
    more, others = ledger.transcript_work(logs.scan_transcripts(spark, str(files / "tr"), pattern='"timestamp"'))
    assert rows(more, "worker_id", "quality", "start_at") == [
        ("transcript:main:s", "fact", dt.datetime(2026, 7, 1, 5, 59)), ("transcript:subagent:x", "derived", dt.datetime(2026, 7, 1, 5))]
    assert rows(others, "worker_id", "worker_kind", "parent_id") == [("transcript:main:s", "main", None), ("transcript:subagent:x", "subagent", "transcript:main:s")]
    whole = intervals.project_contributions(work.unionByName(more).withColumn("period", F.lit("all")), workers.select("worker_id", "project_name").unionByName(others.select("worker_id", "project_name")))
    assert {r.project_name for r in whole.collect()} >= {r.project_name for r in others.collect()}
    items = board.schedule_items(spark.createDataFrame([("a", "n", "cron", None)], "schedule_id string, name string, kind string, rrule string"), AS_OF)
    snaps = quota.understand(spark.createDataFrame(
        [("log", 1, dt.datetime(2026, 7, 1), (25.0, 300, None), None)],
        "runtime string, snapshot_id bigint, captured_at timestamp, primary struct<used_percent:double,window_mins:int,resets_at:timestamp>, secondary struct<used_percent:double,window_mins:int,resets_at:timestamp>"))
    document = ledger.snapshot(events, calls, loads, catalog, work.unionByName(more), AS_OF, board=board.column_summary(items), quota=snaps)
    sinks.write_snapshot(document, str(tmp_path / "out"))
    data = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert data["schemaVersion"] == 2 and data["refreshedAt"] == "2026-07-01T12:00:00.000Z"
    assert data["detailedUsage"]["today"]["tokens"]["visibleTotalTokens"] == 3800 and data["detailedUsage"]["parsedFileCount"] == 2
    assert [p["name"] for p in data["projects"]] == ["app", "lib"] and data["toolUsages"][0]["name"] == "shell"
    assert data["skillUsages"][0]["staticByteCount"] == 40 and len(data["dailyBuckets"]) == 7
    assert data["quotaWindows"][0]["fiveHour"]["remainingPercent"] == 75 and data["quotaWindows"][0]["monthly"] is None
    assert data["taskBoard"]["totalCount"] == 1 and data["usageTrend"]["sevenDayTokens"] == 3800
    assert {r["period"] for r in data["leadership"]} == {"today", "sevenDays", "twentyEightDays"}


def test_ledger_table_is_partitioned_by_day(spark, files, threads, tmp_path):
    events, _ = ledger.log_ledger(logs.scan_session_logs(spark, str(files / "logs")), threads)
    ledger.write_ledger(events, str(tmp_path / "ledger"))
    table = spark.read.parquet(str(tmp_path / "ledger"))
    plan = table.where("day = date'2026-07-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and table.count() == 3


def test_release_removes_own_tables(spark):
    session.materialise(spark.range(3))
    assert session.release(spark) >= 1


@pytest.fixture
def dated(spark, tmp_path):
    """Logs whose names hold a time and the id, one with a blank, a fork, a log no thread names, an old transcript."""
    first = [token("2026-07-01T01:00:00Z", counts(900, 400, 90, 990), counts(900, 400, 90, 990)),
             token("2026-07-01T02:00:00Z", counts(1700, 700, 170, 1870), counts(800, 300, 80, 880))]
    names = {"a1": "day one/rollout-2026-07-01T01-00-00-a1.jsonl", "b2": "rollout-2026-07-01T03-00-00-b2.jsonl"}
    write(tmp_path / "logs" / names["a1"], first)
    write(tmp_path / "logs" / names["b2"], [{"timestamp": "2026-07-01T03:00:00Z", "type": "session_meta", "payload": {"id": "b2", "forked_from_id": "a1"}}, *first,
                                            token("2026-07-01T04:00:00Z", counts(2000, 800, 200, 2200), None)])
    write(tmp_path / "logs/rollout-unknown.jsonl", first)
    write(tmp_path / "tr/-w-x/old.jsonl", [{"timestamp": "2026-04-01T05:00:00Z", "cwd": "/w/x", "message": {"id": "m", "model": "claude-haiku", "usage": {"input_tokens": 7, "output_tokens": 2}}}])
    import os

    os.utime(tmp_path / "tr/-w-x/old.jsonl", (1_775_000_000, 1_775_000_000))
    t = dt.datetime(2026, 7, 1)
    threads = spark.createDataFrame([(i, f"T {i}", f"/w/{i}", "gpt-5", 1870, t, t, "user", str(tmp_path / "logs" / n)) for i, n in names.items()],
                                    "thread_id string, title string, cwd string, model string, tokens_used bigint, created_at timestamp, updated_at timestamp, thread_source string, log_path string")
    return tmp_path, threads


def test_logs_belong_to_threads_by_path(spark, dated, rows):
    folder, threads = dated
    out, baselines, events = ledger.log_usage(logs.scan_session_logs(spark, str(folder / "logs")), threads)
    assert rows(out, "thread_id", "total_tokens", "model", "project_path") == [("a1", 880, "gpt-5", "/w/a1"), ("a1", 990, "gpt-5", "/w/a1"), ("b2", 330, "gpt-5", "/w/b2")]
    assert rows(baselines) == [("b2", 1870)]
    assert rows(events) == [("a1", 2), ("b2", 1)]
    top = usage.rollup_windows(out, AS_OF, events=events).where("usage_window = 'lifetime'").first()
    assert (top.parsed_files, top.token_events, top.total_tokens) == (2, 3, 2200)


def test_old_transcripts_count(spark, dated, rows):
    folder, threads = dated
    both = ledger.read_everything(spark, str(folder / "logs"), str(folder / "tr"), threads)
    assert rows(both.groupBy("runtime").agg(F.sum("total_tokens"))) == [("log", 2200), ("transcript", 9)]


def test_work_leaves_old_files_out(spark, dated):
    folder, threads = dated
    edges = spark.createDataFrame([], "parent_thread_id string, child_thread_id string")
    assert ledger.read_work(spark, str(folder / "logs"), str(folder / "tr"), threads, edges, AS_OF)[0].count() == 0
