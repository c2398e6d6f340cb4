"""Scans of small file trees: session logs, transcripts, documents, schedules, skill files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.operators import board, counters, rankings, skills, transcripts, worktime
from tallyloom.operators import ordered, quota
from tallyloom.sources import documents, increments, logs
from tallyloom.sources import threads as thread_source


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else "\n".join(json.dumps(t) if isinstance(t, dict) else t for t in text) + "\n")
    return path


def token(ts, total=None, last=None):
    info = {}
    if total is not None:
        info["total_token_usage"] = total
    if last is not None:
        info["last_token_usage"] = last
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_session_log_scan(spark, tmp_path, rows):
    counts = {"input_tokens": 10, "cached_input_tokens": "4", "output_tokens": 2, "reasoning_output_tokens": 1, "total_tokens": 12}
    write(tmp_path / "s1.jsonl", [
        {"timestamp": "2026-07-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s1", "forked_from_id": "s0"}},
        {"timestamp": "2026-07-01T00:00:01.500Z", "type": "turn_context", "payload": {"model": "gpt-5.4"}},
        token("2026-07-01T00:00:02.000Z", counts, counts),
        '{"type":"token_count", broken',
        {"timestamp": "x", "type": "response_item", "payload": {"type": "message"}},
        {"timestamp": "2026-07-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "cat ~/.agents/skills/a/SKILL.md"}},
        token("not a time", counts),
        '{"type":"token_count","payload":{"type":"token_count","info":"' + "x" * (4 * 1024 * 1024) + '"}}',
    ])
    records = logs.scan_session_logs(spark, str(tmp_path))
    assert rows(records.orderBy("line_no"), "type") == [("function_call",), ("session_meta",), ("token_count",), ("token_count",), ("turn_context",)]
    lines = logs.counter_lines(records)
    assert lines.where("line_type = 'token_count'").count() == 1
    deltas = counters.normalise(lines)
    assert rows(deltas, "thread_id", "total_tokens", "cached_input_tokens") == [("s1", 12, 4)]
    calls = skills.extract_loads(logs.call_lines(records), "/home/u")
    assert rows(calls, "tool_name", "skill_path") == [("shell", "/home/u/.agents/skills/a/SKILL.md")]


def test_line_numbers_grow_when_files_are_split(spark, tmp_path):
    for name in ("a", "b", "c"):
        write(tmp_path / f"{name}.jsonl", [{"type": "token_count", "n": n, "pad": "x" * (n % 50)} for n in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        lines = logs.scan_lines(spark, str(tmp_path), "token_count").withColumn("n", F.get_json_object("value", "$.n").cast("int"))
        assert lines.rdd.getNumPartitions() > 10
        data = lines.select("file_path", "line_no", "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(data) == 9000
    for name in {r.file_path for r in data}:
        mine = sorted((r.line_no, r.n) for r in data if r.file_path == name)
        assert [n for _, n in mine] == list(range(3000)) and len({k for k, _ in mine}) == 3000


def test_transcript_lines_to_ledger(spark, tmp_path, one, rows):
    """A message with every kind of token, told twice; one that takes model, folder and the file's time; a line without marks."""
    told = {"type": "assistant", "cwd": "/srv/shop/", "timestamp": "2025-11-03T18:20:07.125Z",
            "message": {"id": "order-7", "model": "claude-opus-4", "content": [{"type": "text"}, {"type": "tool_use", "id": "q1", "name": "Grep"}, {"type": "tool_use", "id": "q2", "name": "Edit"}],
                        "usage": {"output_tokens": 64, "input_tokens": 21, "cache_read_input_tokens": 9000, "cache_creation_input_tokens": 15}}}
    bare = {"uuid": "order-8", "attributionSkill": "audit", "message": {"usage": {"output_tokens": 0, "input_tokens": "12"}}}
    path = tmp_path / "-srv-shop" / "late-shift.jsonl"
    write(path, [told, {"type": "user", "text": "hello"}, {k: v for k, v in told.items() if k != "timestamp"}, bare])
    written = dt.datetime(2025, 12, 24, 6, 30, tzinfo=dt.timezone.utc)
    os.utime(path, (written.timestamp(), written.timestamp()))
    lines = logs.scan_transcripts(spark, str(tmp_path))
    ledger = transcripts.ledger(lines)
    full = one(ledger.where("message_id = 'order-7'"))
    assert [full[c] for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")] == [9036, 9015, 64, 9100]
    assert float(full["cost_usd"]) == pytest.approx((21 * 15 + 9015 * 1.5 + 64 * 75) / 1e6)
    taken = one(ledger.where("message_id = 'order-8'"))
    assert (taken["project_path"], taken["model"], taken["ts"], taken["total_tokens"]) == ("/srv/shop/", "claude-opus-4", written.replace(tzinfo=None), 12)
    assert ledger.count() == 2 and {r.thread_id for r in ledger.collect()} == {"late-shift"}
    assert rows(logs.transcript_calls(lines), "tool_name") == [("Edit",), ("Edit",), ("Grep",), ("Grep",)]
    assert rows(logs.transcript_skill_loads(lines), "skill_name") == [("audit",)]


def test_sessions_count_their_own_usage(spark, tmp_path, rows):
    """A resumed session holds messages of another file, one session has no usage, one no folder; the latest come first."""
    def line(n, message=None, tokens=0, **more):
        return {"timestamp": f"2026-02-01T00:00:{n:02d}Z", "message": {"id": message, "usage": {"input_tokens": tokens}, **({"model": more["model"]} if "model" in more else {})}, **({"cwd": more["cwd"]} if "cwd" in more else {})}

    write(tmp_path / "plain" / "first.jsonl", [line(1, "m1", 5, cwd="/w/a/", model="claude-sonnet-4"), line(2, "m1", 9), line(3, "m2", 7), line(4, cwd="/w/b", model="claude-haiku-4")])
    write(tmp_path / "plain" / "again.jsonl", [line(10, "m1", 5), line(11, "m3", 1), line(12, None, 2), line(13, None, 2)])
    write(tmp_path / "-w-c" / "idle.jsonl", [line(5, "m9", 0)])
    for name in ("plain/first", "plain/again", "-w-c/idle"):
        os.utime(tmp_path / f"{name}.jsonl", (1_700_000_000, 1_700_000_000))
    got = rankings.transcript_threads(logs.scan_transcripts(spark, str(tmp_path))).drop("updated_at", "archived", "file_path").collect()
    assert [tuple(x) for x in got] == [("again", "plain", 10, None, "plain"), ("idle", "c", 0, None, "/w/c"), ("first", "b", 12, "claude-haiku-4", "/w/b")]
    assert rankings.transcript_threads(logs.scan_transcripts(spark, str(tmp_path)), 1).count() == 1
    both = rankings.merge_threads(spark.createDataFrame([("log", "x", dt.datetime(2026, 1, 1)), ("transcript", "y", None), ("log", "z", dt.datetime(2026, 3, 1))], "runtime string, thread_id string, updated_at timestamp"), 2)
    assert [x.thread_id for x in both.collect()] == ["z", "x"]


def test_task_documents_and_board(spark, tmp_path, rows):
    write(tmp_path / "one.json", json.dumps({"status": "in_progress", "subject": "first", "updatedAt": "2026-07-01T00:00:00Z", "cwd": "/w/app"}))
    write(tmp_path / "two.json", json.dumps({"status": "weird", "updated_at": 1_782_000_000}))
    write(tmp_path / "bad.json", "nope")
    items = board.task_items(documents.parse_tasks(documents.scan_files(spark, str(tmp_path))))
    assert rows(items, "title", "detail", "column_kind", "display_state", "runtime_state") == [
        ("first", "app", "active", "running", "running"), ("two", "", "pending", "unknown", "recorded")]


def test_limit_documents_are_parsed_once(spark, rows):
    entry = '{"limitId":"main","primary":{"usedPercent":7,"windowDurationMins":300},"secondary":null}'
    credits = '"rateLimitResetCredits":{"availableCount":1,"credits":[{"id":"b","status":"available","expiresAt":9},{"id":"a","status":"available"}]}'
    docs = spark.createDataFrame([
        (1, '{"rateLimitsByLimitId":{"main":' + entry + '},' + credits + '}'), (2, '{"rateLimits":' + entry + '}'),
        (3, '{"rateLimits":[1]}'), (4, "nope"), (5, None)], "n int, value string")
    read = documents.read_limit_documents(docs, "main")
    shown = quota.reset_credits(read).select("n", "limit_id", "total_count", F.transform("details", lambda c: c["id"]).alias("ids"))
    assert rows(shown) == [(1, "main", 1, ["b", "a"]), (2, "main", None, [])]
    for used in (read, documents.parse_tasks(docs.select(F.col("n").cast("string").alias("path"), F.lit(None).cast("timestamp").alias("modified_at"), "value"))):
        assert used._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_status_snapshot(spark, tmp_path, one):
    write(tmp_path / "snap.json", json.dumps({"schemaVersion": 1, "capturedAt": "2026-07-07T07:00:00.000Z", "rateLimits": {
        "fiveHour": {"usedPercentage": 25, "resetsAt": "2026-07-07T10:00:00.000Z"}, "sevenDay": {"usedPercentage": 140}}}))
    snap = documents.parse_status_snapshots(documents.scan_files(spark, str(tmp_path)))
    slots = {r.slot: r for r in quota.slot_rows(snap).collect()}
    assert slots["primary"].remaining_percent == 75 and slots["primary"].resets_at == dt.datetime(2026, 7, 7, 10)
    assert slots["secondary"].used_percent == 100 and slots["secondary"].kind == "sevenDay"
    assert one(quota.latest_status(quota.understand(snap), "2026-07-07 07:15:00"))["status"] == "available"
    assert one(quota.latest_status(quota.understand(snap), "2026-07-07 07:15:01"))["status"] == "stale"


def test_stats_cache_and_skill_counters(spark, tmp_path, rows, one):
    write(tmp_path / "stats" / "a.json", json.dumps({"todayTokens": 5, "seven_day_tokens": "40", "totalCostUSD": 1.5}))
    write(tmp_path / "stats" / "b.json", json.dumps({"todayTokens": 0}))
    row = one(documents.parse_stats_cache(documents.scan_files(spark, str(tmp_path / "stats"))))
    assert (row["today_tokens"], row["seven_day_tokens"], row["lifetime_tokens"], row["cost_usd"]) == (5, 40, 40, 1.5)
    write(tmp_path / "g" / "c.json", json.dumps({"skillUsage": {"a": 3, "b": {"loadCount": 0, "lastLoadedAt": 1_782_000_000_000}, "c": "x", "d": {}, "e": None}}))
    counters_ = documents.parse_skill_counters(documents.scan_files(spark, str(tmp_path / "g")))
    assert rows(counters_, "skill_name", "load_count") == [("a", 3), ("b", 1), ("d", 1)]


def test_schedule_files(spark, tmp_path, rows):
    write(tmp_path / "x" / "automation.toml", 'id = "job"\nname = "say \\"hi\\""\n# note\nstatus = "active"\nrrule = "DTSTART;TZID=UTC:20260101T090000\\nRRULE:FREQ=DAILY"\n')
    write(tmp_path / "y" / "automation.toml", 'status = "PAUSED"\n')
    write(tmp_path / "z" / "automation.toml", 'status = ACTIVE\nkind = heartbeat\n')
    out = documents.parse_schedules(documents.scan_files(spark, str(tmp_path), "automation.toml"))
    assert rows(out, "schedule_id", "name", "kind", "rrule") == [
        ("job", 'say "hi"', "cron", "DTSTART;TZID=UTC:20260101T090000\nRRULE:FREQ=DAILY"), ("z", "z", "heartbeat", None)]


def test_changed_and_deleted_files(spark, tmp_path, rows):
    for name in ("a", "b", "c"):
        write(tmp_path / f"{name}.jsonl", "1\n")
    before = increments.fingerprints(spark, str(tmp_path))
    manifest = spark.createDataFrame(before.collect(), before.schema)
    write(tmp_path / "b.jsonl", "1\n2\n")
    (tmp_path / "c.jsonl").unlink()
    write(tmp_path / "d.jsonl", "1\n")
    listing = increments.fingerprints(spark, str(tmp_path))
    stem = lambda df: sorted(r.file_path[-7] for r in df.collect())
    changed = increments.changed_files(listing, manifest)
    assert stem(changed) == ["b", "d"]
    parsed = manifest.select("file_path", F.lit("old").alias("v"))
    fresh = changed.select("file_path", F.lit("new").alias("v"))
    merged = increments.merge_parsed(parsed, fresh, listing, changed)
    assert sorted((r.file_path[-7], r.v) for r in merged.collect()) == [("a", "old"), ("b", "new"), ("d", "new")]


def test_modified_after_prunes_files(spark, tmp_path):
    write(tmp_path / "old.jsonl", '{"usage"}\n')
    write(tmp_path / "new.jsonl", '{"usage"}\n')
    os.utime(tmp_path / "old.jsonl", (1_700_000_000, 1_700_000_000))
    os.utime(tmp_path / "new.jsonl", (1_783_000_000, 1_783_000_000))
    bound = thread_source.prune_after(spark, "2026-07-20 00:00:00")
    assert bound == "2026-06-16T00:00:00"
    assert logs.scan_lines(spark, str(tmp_path), "usage", modified_after=bound).count() == 1


def test_skill_files_and_resolution(spark, tmp_path, rows):
    home, repo = tmp_path / "home", tmp_path / "repo"
    personal = write(home / ".claude/skills/review/SKILL.md", "personal review")
    project = write(repo / ".claude/skills/review/SKILL.md", "project review")
    only = write(repo / ".claude/skills/deep/SKILL.md", "deep")
    nested = write(repo / "apps/web/.claude/skills/deploy/SKILL.md", "nested deploy")
    plugin = write(home / ".claude/plugins/marketplaces/community/plugins/sample/skills/audit/SKILL.md", "plugin audit")
    legacy = write(home / ".claude/commands/legacy.md", "legacy command")
    folders = [str(home / ".claude"), str(repo / ".claude"), f"{repo}/apps/*/.claude"]
    catalog = documents.scan_skill_files(spark, folders)
    sizes = {r.skill_path: (r.byte_count, r.token_estimate) for r in catalog.collect()}
    assert sizes[str(personal)] == (15, 4) and str(project) in sizes
    cwd = str(repo / "packages/app")
    asked = [("review", cwd), ("deep", cwd), ("apps/web:deploy", str(repo)), ("sample:audit", str(repo)), ("legacy", cwd),
             ("../unsafe", str(repo)), ("missing", str(repo)), ("missing", "/"), ("/review/", None)]
    requests = spark.createDataFrame([(n, None, p) for n, p in asked], "skill_name string, explicit_path string, project_path string")
    roots = spark.createDataFrame([(str(repo),)], "path string")
    out = {(r.skill_name, r.project_path): r.resolved_path for r in skills.resolve_names(requests, catalog, roots, str(home)).collect()}
    assert out[("review", cwd)] == str(personal) and out[("/review/", "")] == str(personal)
    assert out[("deep", cwd)] == str(only)
    assert out[("apps/web:deploy", str(repo))] == str(nested)
    assert out[("sample:audit", str(repo))] == str(plugin)
    assert out[("legacy", cwd)] == str(legacy)
    assert out[("../unsafe", str(repo))] is None and out[("missing", str(repo))] is None and out[("missing", "/")] is None
    personal.unlink()
    again = skills.resolve_names(requests, documents.scan_skill_files(spark, folders), roots, str(home))
    assert {r.skill_name: r.resolved_path for r in again.collect()}["review"] == str(project)


def test_installed_versions_replace_old_plugin_paths(spark, rows):
    base = "/home/u/.codex/plugins/cache/openai-x/plug"
    loads = spark.createDataFrame([(f"{base}/1.0/skills/a/SKILL.md",), ("/opt/gone/SKILL.md",), ("/home/u/x/SKILL.md",), ("/srv/is/SKILL.md",)], "skill_path string")
    catalog = spark.createDataFrame(
        [(f"{base}/2.0/skills/a/SKILL.md", dt.datetime(2026, 1, 2)), (f"{base}/3.0/skills/a/SKILL.md", dt.datetime(2026, 1, 1)),
         ("/srv/is/SKILL.md", dt.datetime(2026, 1, 1))], "skill_path string, modified_at timestamp")
    assert rows(skills.adopt_installed(loads, catalog, "/home/u")) == sorted(
        [(f"{base}/2.0/skills/a/SKILL.md",), ("/home/u/x/SKILL.md",), ("/srv/is/SKILL.md",)], key=repr)


def test_turn_events_of_a_log_become_intervals(spark, tmp_path, rows):
    write(tmp_path / "t1.jsonl", [
        {"timestamp": "2026-07-01T00:00:00Z", "type": "event_msg", "payload": {"type": "task_started", "turn_id": "x", "started_at": 1_782_864_000}},
        {"timestamp": "2026-07-01T00:00:00Z", "type": "event_msg", "payload": {"type": "task_complete", "turn_id": "x", "completed_at": 1_782_864_060.5, "duration_ms": 5}},
        {"timestamp": "2026-07-01T00:00:00Z", "type": "event_msg", "payload": {"type": "task_complete", "turn_id": "y", "completed_at": 1_782_864_100, "duration_ms": 2500}},
    ])
    marks = logs.turn_marks(logs.scan_session_logs(spark, str(tmp_path), logs.WORK_TYPES)).selectExpr(
        "*", "timestamp'2026-07-01 00:00:00' as created_at", "'main' as worker_kind", "cast(null as string) as automation_id")
    out = worktime.pair_turns(marks, "2026-07-02 00:00:00", ordered.line_slot("line_no"), ["line_no"])
    start = dt.datetime(2026, 7, 1)
    assert rows(out, "interval_id", "start_at", "end_at") == [
        ("t1:x", start, start + dt.timedelta(seconds=60, milliseconds=500)),
        ("t1:y", start + dt.timedelta(seconds=97, milliseconds=500), start + dt.timedelta(seconds=100))]


def test_titles_paths_and_sources(spark, one):
    row = one(spark.range(1).select(
        nm.title(F.lit("  "), F.lit("a\n b")).alias("t"), nm.title(F.lit("x" * 49), F.lit(None)).alias("long"), nm.title(F.lit(None), F.lit("")).alias("none"),
        nm.standard_path(F.lit("/a/./b/../c//d")).alias("p"), nm.decode_directory(F.lit("-tmp-x")).alias("d"), nm.project_id(F.lit(" "), F.lit("log")).alias("id"),
        nm.skill_source(F.lit("/home/u/q/SKILL.md"), "/home/u").alias("home")))
    assert tuple(row.values()) == ("a b", "x" * 45 + "...", "Untitled", "/a/c/d", "/tmp/x", "log:uncategorized", "~/q/SKILL.md")


def test_a_huge_line_is_passed_over(spark, tmp_path, rows):
    import json

    good = {"timestamp": "2026-07-01T01:00:00Z", "type": "turn_context", "payload": {"model": "m"}}
    huge = {**good, "payload": {"model": "x" * (logs.MAX_LINE_BYTES + 10)}}
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in (good, huge, good)) + "\n")
    assert rows(logs.scan_session_logs(spark, str(tmp_path)), "type", "payload.model") == [("turn_context", "m")] * 2


def test_a_huge_skill_file_is_listed_only(spark, tmp_path, rows):
    (tmp_path / "big.md").write_bytes(b"a" * (documents.MAX_SKILL_BYTES + 1))
    (tmp_path / "small.md").write_text("four")
    assert rows(documents.scan_skill_files(spark, str(tmp_path)), "byte_count", "token_estimate") == [(4, 2), (None, None)]


def test_refresh_reads_changed_files_only(spark, tmp_path, rows):
    """Append, change, delete, a file put back with an old time, odd names, and nothing at all; each equals a full parse."""
    root, store = tmp_path / "day 1", increments.FileStore(spark, str(tmp_path / "store"), buckets=8)
    line = lambda m: {"timestamp": "2026-07-01T01:00:00Z", "type": "turn_context", "payload": {"model": m}}
    opened = []

    def scan(session, path, **options):
        opened.append(sorted(os.path.basename(p) for p in path) if isinstance(path, list) else path)
        return logs.scan_session_logs(session, path, **options)

    def check():
        opened.clear()
        # Line numbers only order the lines of a file.
        lines = lambda df: [(f, m) for f, _, m in sorted(map(tuple, df.select("file_path", "line_no", "payload.model").collect()))]
        got = lines(store.refresh(str(root), scan))
        full = logs.scan_session_logs(spark, str(root)).withColumn("file_path", logs.plain_path("file_path"))
        assert got == lines(full) == lines(store.current())
        return [m for _, m in got]

    def put(name, models, at):
        write(root / name, [line(m) for m in models])
        os.utime(root / name, (at, at))

    def written(version):
        folder = tmp_path / "store" / "rows" / f"version={version}"
        return {d for d in os.listdir(folder) if d.startswith("bucket=")} if folder.exists() else set()

    put("a.jsonl", ["a"], 1_780_000_000)
    put("b.jsonl", ["b"], 1_780_000_000)
    for k in range(12):
        put(f"x{k}.jsonl", ["x"], 1_780_000_000)
    assert check() == ["a", "b", *["x"] * 12]
    put("c[1].jsonl", ["c", "d"], 1_780_000_100)
    assert check() == ["a", "b", "c", "d", *["x"] * 12] and opened == [["c\\[1\\].jsonl"]] and len(written(1)) == 1
    put("a.jsonl", ["a2", "a3"], 1_780_000_200)
    (root / "b.jsonl").unlink()
    assert check() == ["a2", "a3", "c", "d", *["x"] * 12] and opened == [["a.jsonl"]] and len(written(2)) <= 2
    put("c[1].jsonl", ["old"], 1_770_000_000)
    assert check() == ["a2", "a3", "old", *["x"] * 12] and opened == [["c\\[1\\].jsonl"]]
    before = store.versions()
    assert check() == ["a2", "a3", "old", *["x"] * 12] and opened == [] and store.versions() == before and len(before) == 2
    named = store._parts(store.manifest(before[-1])) | store._parts(store.manifest(before[-2]))
    assert all((v, int(d[7:])) in named for v in range(4) for d in written(v))  # nothing else is left
    for name in list(os.listdir(root)):
        (root / name).unlink()
    assert check() == []


def test_a_failed_refresh_leaves_the_last_version(spark, tmp_path, rows):
    store = increments.FileStore(spark, str(tmp_path / "store"), buckets=4)
    write(tmp_path / "in" / "a.jsonl", [{"type": "turn_context", "payload": {"model": "a"}}])
    store.refresh(str(tmp_path / "in"), logs.scan_session_logs)
    write(tmp_path / "in" / "b.jsonl", [{"type": "turn_context", "payload": {"model": "b"}}])

    def broken(session, path):
        raise OSError("lost")

    with pytest.raises(OSError):
        store.refresh(str(tmp_path / "in"), broken)
    assert rows(store.current(), "payload.model") == [("a",)]
    assert rows(store.refresh(str(tmp_path / "in"), logs.scan_session_logs), "payload.model") == [("a",), ("b",)]

