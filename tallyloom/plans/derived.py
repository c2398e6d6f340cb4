"""Inputs that Spark derives from the given tables for operators on other shapes:
log and document texts, varied names, fork and board situations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.tokens import with_cost
from tallyloom.plans import views
from tallyloom.session import materialise

BOARD_AS_OF = views.ORDERS_AS_OF

# Fixed values of the fixtures: spellings that exercise the ordered rules.
MODEL_SPELLINGS = (
    "GPT-5.5-Pro", "gpt-5.5-2026", "chat-latest", " gpt-5.4-mini ", "gpt-5.4-nano-x", "openai/gpt-5.4-pro",
    "gpt-5.4", "gpt-5.3-codex", "gpt-5.2-chat", "gpt-5-codex-mini", "gpt-5", "gpt-4o", "Claude-Opus-4",
    "claude-sonnet-4", "claude-3-haiku", "", "   ", None,
)
TOOL_SPELLINGS = (
    "exec_command", "write_stdin", "Bash", "apply_patch", "MultiEdit", "Write", "web_search", "page_snapshot",
    "view_image", "figma_get", "read_docs", "Grep", "mcp__x", "list_resources", "update_plan", "TodoWrite",
    "Task", "create_goal", "WebFetch", "other",
)
STATUS_SPELLINGS = (
    "in_progress", "Active", " running ", "pending", "failed", "ERROR", "blocked", "scheduled", "completed",
    "done", "success", "weird", None,
)


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values)).cast("int") + 1)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _iso(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# ---------------------------------------------------------------- texts of logs


def session_log_lines(spark: SparkSession, d: str) -> DataFrame:
    """F1f as raw log lines: counters, metadata, turn contexts, tool calls of both kinds, noise and broken JSON."""
    log = materialise(views.fork_log(spark, d))
    stamp = _iso("ts")
    # Counters as text here and there: readers must accept both.
    counters = {c: F.col(f"cum.{c}") for c in views.COUNTER_FIELDS}
    own = {c: F.col(f"last.{c}").cast("string") for c in views.COUNTER_FIELDS}
    info = F.struct(
        F.when(F.col("cum").isNotNull(), F.struct(*[c.alias(n) for n, c in counters.items()])).alias("total_token_usage"),
        F.when(F.col("last").isNotNull(), F.struct(*[c.alias(n) for n, c in own.items()])).alias("last_token_usage"),
    )
    token = _json(timestamp=stamp, type=F.lit("event_msg"),
                  payload=F.struct(F.lit("token_count").alias("type"), info.alias("info")))
    meta = _json(timestamp=stamp, type=F.lit("session_meta"),
                 payload=F.struct(F.col("thread_id").alias("id"), F.col("forked_from_id").alias("forked_from_id")))
    n = F.col("line_no")
    context = _json(timestamp=stamp, type=F.lit("turn_context"), payload=F.struct(F.concat(F.lit("gpt-5."), (n % 3).cast("string")).alias("model")))
    call = _json(timestamp=stamp, type=F.lit("response_item"), payload=F.struct(
        F.when(n % 2 == 0, "function_call").otherwise("custom_tool_call").alias("type"), pick(views.TOOLS, n).alias("name"), F.lit("{}").alias("arguments")))
    noise = F.when(F.col("line_no") % 3 == 0, '{"type":"response_item","payload":{"type":"message"}}').otherwise('{"type":"token_count", broken')
    texts = log.select(
        F.concat(F.lit("/logs/"), "thread_id", F.lit(".jsonl")).alias("file_path"),
        F.explode(F.array(
            F.struct((n * 5).alias("line_no"), token.alias("value")),
            F.struct((n * 5 + 1).alias("line_no"), F.when(n % 5 == 0, meta).alias("value")),
            F.struct((n * 5 + 2).alias("line_no"), noise.alias("value")),
            F.struct((n * 5 + 3).alias("line_no"), F.when(n % 7 == 0, context).alias("value")),
            F.struct((n * 5 + 4).alias("line_no"), F.when(n % 4 < 2, call).alias("value")),
        )).alias("l"),
    )
    return texts.select("file_path", "l.line_no", "l.value").where("value is not null")


def transcript_texts(spark: SparkSession, d: str) -> DataFrame:
    """F6 as raw transcript lines."""
    t = views.transcript_lines(spark, d)
    usage = F.struct(
        F.col("input").alias("input_tokens"), F.col("cache_create").cast("string").alias("cache_creation_input_tokens"),
        F.col("cache_read").alias("cache_read_input_tokens"), F.col("output").alias("output_tokens"),
    )
    content = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("u1").alias("id"), F.col("tool_name").alias("name")),
                      F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")))
    value = _json(
        type=F.col("role"), timestamp=_iso("ts"), cwd=F.col("cwd"),
        message=F.struct(F.col("message_id").alias("id"), F.col("model").alias("model"), usage.alias("usage"), content.alias("content")),
    )
    path = F.concat(F.lit("/t/"), F.replace("seed_project", F.lit("/"), F.lit("-")), F.lit("/"), "session_id", F.lit(".jsonl"))
    return t.select(path.alias("file_path"), F.lit(None).cast("timestamp").alias("modified_at"), "line_no", value.alias("value"))


def task_documents(spark: SparkSession, d: str) -> DataFrame:
    """One task document per event: twin spellings, missing fields, file time as fallback."""
    e = views.events(spark, d)
    n = F.col("event_id")
    camel = _json(status=pick(STATUS_SPELLINGS, n), subject=F.when(n % 3 == 0, F.concat(F.lit("task "), n)),
                  title=F.when(n % 3 == 1, F.concat(F.lit("title "), n)),
                  updatedAt=F.when(n % 2 == 0, _iso("ts")), project=F.when(n % 4 == 0, F.concat(F.lit("/w/p"), n % 9)))
    snake = _json(status=pick(STATUS_SPELLINGS, n), updated_at=F.unix_millis("ts"), cwd=F.lit("/w/cwd/"))
    value = F.when(n % 10 == 9, "not json").when(n % 5 == 4, snake).otherwise(camel)
    return e.select(F.concat(F.lit("/tasks/"), n, F.lit(".json")).alias("path"),
                    (F.col("ts") + F.expr("interval 1 hour")).alias("modified_at"), value.alias("value"))


def stats_documents(spark: SparkSession, d: str) -> DataFrame:
    """One stats cache per customer: both spellings, numbers as text, empty and broken ones."""
    n = F.col("c_custkey")
    camel = _json(todayTokens=n % 7, sevenDayTokens=n % 50)
    snake = _json(today_tokens=(n % 5).cast("string"), total_tokens=n * 3, total_cost_usd=(n % 100) / 4)
    value = F.when(n % 4 == 0, camel).when(n % 4 == 1, snake).when(n % 4 == 2, "{}").otherwise("[")
    return views.table(spark, d, "customer").select(F.concat(F.lit("/home/"), n, F.lit("/stats-cache.json")).alias("path"), F.lit(None).cast("timestamp").alias("modified_at"), value.alias("value"))


def skill_counter_documents(spark: SparkSession, d: str) -> DataFrame:
    """Maps whose values are numbers, objects or other kinds: one document per event."""
    e = views.events(spark, d)
    n = F.col("event_id")
    value = F.concat(
        F.lit('{"skillUsage":{"plain":'), F.col("k").cast("string"),
        F.lit(',"object":{"loadCount":'), (F.col("k") - 5).cast("string"), F.lit(',"lastLoadedAt":'), F.unix_millis("ts").cast("string"),
        F.lit('},"snake":{"load_count":"7"},"bare":{},"text":"x","list":[1]}}'),
    )
    other = F.concat(F.lit('{"skill_usage":{"only":'), F.col("k").cast("string"), F.lit("}}"))
    return e.select(F.concat(F.lit("/g/"), n).alias("path"), F.col("ts").alias("modified_at"),
                    F.when(n % 7 == 0, other).otherwise(value).alias("value"))


def schedule_files(spark: SparkSession, d: str) -> DataFrame:
    """One key = value file per part."""
    s = views.schedules(spark, d)
    n = F.col("schedule_id").cast("bigint")
    rule = F.replace("rrule", F.lit("\n"), F.lit("\\n"))
    value = F.concat(
        F.lit("# schedule\n"),
        F.when(n % 4 != 0, F.concat(F.lit('id = "s'), "schedule_id", F.lit('"\n'))).otherwise(""),
        F.when(n % 3 != 0, F.concat(F.lit('name = "say \\"'), "name", F.lit('\\""\n'))).otherwise(""),
        F.lit("status = "), F.when(n % 5 == 0, '"PAUSED"').otherwise('"Active"'), F.lit("\n\n"),
        F.when(n % 2 == 0, '  kind = "heartbeat"  \n').otherwise(""),
        F.lit('rrule = "'), rule, F.lit('"\n'),
    )
    return s.select(F.concat(F.lit("/auto/"), "schedule_id", F.lit("/automation.toml")).alias("path"), value.alias("value"))


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents")
    return docs.where("doc_id % 7 <> 0").select(
        F.concat(F.lit("d/"), "doc_id").alias("file_path"), F.octet_length("text").cast("bigint").alias("file_size"),
        (F.col("doc_id") * 1000).alias("modified_micros"))


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents")
    size = F.octet_length("text").cast("bigint")
    return docs.where("doc_id % 3 <> 0").select(
        F.concat(F.lit("d/"), "doc_id").alias("file_path"), F.when(F.col("doc_id") % 5 == 0, size + 1).otherwise(size).alias("file_size"),
        (F.col("doc_id") * 1000 + (F.col("doc_id") % 11 == 0).cast("bigint")).alias("modified_micros"))


def notification_texts(spark: SparkSession, d: str, step: int = 1) -> DataFrame:
    """F7 as JSON notifications, numbered in steps; every seventh line is a reply (it carries an id)."""
    e = views.thread_events(spark, d)
    m = F.col("method")
    params = F.struct(
        F.col("thread_id").alias("threadId"),
        F.when(m.isin("thread/status/changed", "thread/list"), F.struct(
            F.col("status").alias("type"), F.when(F.col("flag").isNotNull(), F.array("flag")).alias("activeFlags"))).alias("status"),
        F.when(m.isin("turn/started", "turn/completed"), F.struct(F.col("turn_id").alias("id"), F.when(m == "turn/completed", F.col("status")).alias("status"))).alias("turn"),
        F.when(m == "item/completed", F.struct(F.col("status").alias("status"))).alias("item"),
        F.col("name").alias("name"),
        F.when(F.col("event_seq") % 11 == 0, "subagent").alias("threadSource"),
    )
    value = _json(method=m, id=F.when(F.col("event_seq") % 7 == 0, "r1"), seq=F.col("event_seq") * step, at=_iso("ts"), params=params)
    return e.select((F.col("event_seq") * step).alias("event_seq"), "thread_id", value.alias("value"))


#: Phases of the connection fixture, and where in the log each but the last ends (in eighths).
PHASES = ("listed", "lost", "opened", "end")
PHASE_EIGHTHS = (3, 4, 5)

#: Connection rows: what happens at which eighth of the log.
CONNECTION = ((1, "thread/list/started"), (3, "connection/lost"), (4, "connection/opened"), (5, "thread/list/started"))


def _eighth(count: int, eighth: int) -> int:
    """Number of a connection row; events take the even numbers."""
    return 2 * (count * eighth // 8) - 1


def phase_edges(spark: SparkSession, d: str) -> list[int]:
    """Last event number of every phase but the last: just before the next connection row."""
    count = views.table(spark, d, "events").count()
    return [_eighth(count, eighth) - 1 for eighth in PHASE_EIGHTHS]


def connection_texts(spark: SparkSession, d: str) -> DataFrame:
    """F7 as JSON notifications with a first list, a loss, a new connection and a second list among them."""
    count = views.table(spark, d, "events").count()
    texts = notification_texts(spark, d, 2).select("event_seq", "value")
    at = views.table(spark, d, "events").where(F.col("event_id") == 0).select(F.explode(F.array(*[
        F.struct(F.lit(_eighth(count, eighth)).cast("bigint").alias("event_seq"), F.lit(method).alias("method")) for eighth, method in CONNECTION])).alias("c")).select("c.*")
    return texts.unionByName(at.select("event_seq", _json(method=F.col("method"), seq=F.col("event_seq")).alias("value")))


# ---------------------------------------------------------------- varied values


def model_names(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    return e.select("event_id", pick(MODEL_SPELLINGS, F.col("event_id")).alias("model"),
                    F.when(F.col("event_id") % 4 != 0, "Thread-Model ").alias("thread_model"))


def timestamp_texts(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    n = F.col("o_orderkey")
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(n % 86400).cast("decimal(18,6)"))
    text = (
        F.when(n % 7 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(n % 7 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n % 7 == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(n % 7 == 3, F.unix_seconds(at).cast("string"))
        .when(n % 7 == 4, F.unix_millis(at).cast("string"))
        .when(n % 7 == 5, (-n).cast("string"))
        .otherwise("yesterday")
    )
    return o.select("o_orderkey", text.alias("text"))


def tool_names(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).select("event_id", pick(TOOL_SPELLINGS, F.col("event_id")).alias("tool_name"))


def tool_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Tool arguments that mention skill files in several ways."""
    e = views.events(spark, d)
    u, k = F.col("user_id").cast("string"), F.col("k").cast("string")
    return e.select(
        "event_id",
        F.concat(F.lit('{"cmd":"cat ~/.agents/skills/s'), u, F.lit('/SKILL.md && ls"}')).alias("arguments"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("see `/opt/x/../skills//s"), k, F.lit("/SKILL.md`; and ~/.agents/skills/s"), u, F.lit("/SKILL.md,"))).alias("input"),
        F.when(F.col("event_id") % 3 == 0, "echo skills/SKILL.md").alias("command"),
    )


def skill_paths(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    k = F.col("k").cast("string")
    path = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("/home/u/plugins/cache/fam"), k, F.lit("/plug/1.0/skills/a/SKILL.md")))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit("/srv/ai-infra/skills/s"), k, F.lit("/SKILL.md")))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit("/home/u/.agents/skills/s"), k, F.lit("/SKILL.md")))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit("/home/u/.codex/skills/.system/s"), k, F.lit("/SKILL.md")))
        .when(F.col("event_id") % 6 == 4, F.concat(F.lit("/home/u/.codex/skills/s"), k, F.lit("/SKILL.md")))
        .otherwise(F.concat(F.lit("/home/u/other/s"), k, F.lit("/SKILL.md")))
    )
    return e.select("event_id", path.alias("skill_path"))


def status_word() -> Column:
    return pick(STATUS_SPELLINGS, F.col("thread_id").cast("bigint"))


def turn_marks(spark: SparkSession, d: str) -> DataFrame:
    """Turns from events: clicks start, purchases complete, ids repeat every five events of a user's clicks."""
    e = views.events(spark, d)
    kind = F.col("event_type")
    return e.where(kind.isin("click", "purchase")).select(
        F.col("user_id").cast("string").alias("thread_id"),
        F.concat_ws("-", F.col("user_id"), F.col("k") % 5).alias("turn_id"),
        F.col("event_id").alias("line_no"),
        F.when(kind == "click", "started").otherwise("completed").alias("mark"),
        F.col("ts").alias("at"),
        F.when(F.col("k") % 2 == 0, F.col("value") * 1000).alias("duration_ms"),
        F.to_timestamp(F.lit("2024-01-05 00:00:00")).alias("created_at"),
        pick(("main", "subagent", "automation"), F.col("user_id")).alias("worker_kind"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("automation_id"),
    )


# ------------------------------------------------------------- skills by name


def skill_requests(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for from working directories: plain, commands, qualified, unsafe, missing."""
    e = views.events(spark, d)
    k = F.col("k").cast("string")
    n = F.col("event_id") % 7
    name = (
        F.when(n == 0, F.concat(F.lit("s"), k)).when(n == 1, F.concat(F.lit("c"), k))
        .when(n == 2, F.concat(F.lit("plug"), F.col("k") % 4, F.lit(":s"), k))
        .when(n == 3, F.concat(F.lit("apps/web:s"), k)).when(n == 4, "../up").when(n == 5, F.concat(F.lit("/s"), k))
        .otherwise(F.concat(F.lit("none"), k))
    )
    return e.select(name.alias("skill_name"), F.lit(None).cast("string").alias("explicit_path"),
                    F.concat(F.lit("/r/repo"), F.col("user_id") % 6, F.lit("/pkg/app")).alias("project_path"))


def repository_roots(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).where("user_id % 6 < 5").select(
        F.concat(F.lit("/r/repo"), F.col("user_id") % 6).alias("path")).distinct()


def skill_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that exist, by k: personal, project, command, nested and plugin ones."""
    e = views.events(spark, d).select("k", (F.col("user_id") % 6).alias("r")).distinct()
    k, r = F.col("k").cast("string"), F.col("r").cast("string")
    paths = F.array(
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("/home/u/.claude/skills/s"), k, F.lit("/SKILL.md"))),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("/r/repo"), r, F.lit("/.claude/skills/s"), k, F.lit("/SKILL.md"))),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("/r/repo"), r, F.lit("/pkg/app/.claude/skills/s"), k, F.lit("/SKILL.md"))),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("/home/u/.claude/commands/c"), k, F.lit(".md"))),
        F.when(F.col("k") % 3 == 1, F.concat(F.lit("/r/repo"), r, F.lit("/pkg/.claude/commands/c"), k, F.lit(".md"))),
        F.when(F.col("k") % 3 == 2, F.concat(F.lit("/r/repo"), r, F.lit("/apps/web/.claude/skills/s"), k, F.lit("/SKILL.md"))),
        F.when(F.col("k") % 2 == 1, F.concat(F.lit("/home/u/.claude/plugins/m1/plug"), F.col("k") % 4, F.lit("/skills/s"), k, F.lit("/SKILL.md"))),
        F.when(F.col("k") % 9 == 1, F.concat(F.lit("/home/u/.claude/plugins/m2/plug"), F.col("k") % 4, F.lit("/skills/s"), k, F.lit("/SKILL.md"))),
    )
    return e.select(F.explode(F.array_compact(paths)).alias("skill_path")).distinct()


def mixed_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skill rows of transcripts and global counters with and without a resolved path."""
    e = views.events(spark, d)
    name = F.concat(F.lit("n"), F.col("k"))
    resolved = F.col("user_id") % 3 == 0
    twice = F.when((F.col("k") % 8 == 0) & (F.col("user_id") % 2 == 0), "b").otherwise("a")
    path = F.when(resolved, F.concat(F.lit("/s/"), twice, F.lit("/"), name)).otherwise(name)
    per = e.groupBy(
        path.alias("path"), name.alias("name"), F.when(F.col("event_type") == "view", "global").otherwise("transcript").alias("source")
    ).agg(F.count("*").alias("load_count"), F.count_distinct("user_id").alias("thread_count"), F.max("ts").alias("last_loaded_at"), F.min("k").alias("k"))
    sized = F.col("path").startswith("/")
    return per.select(
        F.when(sized, F.col("path")).otherwise(F.concat(F.lit("skill:"), "name")).alias("skill_id"), "name", "path", "source",
        "load_count", F.when(F.col("source") == "global", F.lit(0)).otherwise(F.col("thread_count")).alias("thread_count"),
        F.when(sized, F.col("k").cast("bigint") + 10).alias("token_estimate"), F.when(sized, F.col("k").cast("bigint") * 4).alias("byte_count"),
        "last_loaded_at",
    )


def many_models(spark: SparkSession, d: str) -> DataFrame:
    """F1 with the model spread over 14 names."""
    e = views.usage_events(spark, d)
    model = F.when(F.col("model").isNotNull(), F.concat("model", F.lit("-"), F.col("seq") % 4))
    return with_cost(e.withColumn("model", model), "model", "log")


# ------------------------------------------------------------------ board, quota


def board_threads(spark: SparkSession, d: str) -> DataFrame:
    """F3 moved to the three days that end with the board's clock, in order of o_orderkey % 3."""
    t = views.threads(spark, d)
    n = F.col("thread_id").cast("bigint")
    day = F.date_sub(F.lit("2001-08-01").cast("date"), (n % 3).cast("int")).cast("timestamp")
    moved = day + F.make_dt_interval(secs=(n * 7 % 43200).cast("decimal(18,6)"))
    return t.withColumns(
        {
            "updated_at": moved, "created_at": moved - F.expr("interval 1 day"),
            "recency_at": F.when(F.col("recency_at").isNotNull(), moved + F.expr("interval 20 minutes")),
            "archived_at": F.when(F.col("archived_at").isNotNull(), moved + F.expr("interval 5 minutes")),
        }
    )


def threads_with_new_projects(spark: SparkSession, d: str) -> DataFrame:
    """F3 with a third of the last week's threads in projects that did not exist before."""
    t = views.threads(spark, d)
    n = F.col("thread_id").cast("bigint")
    fresh = (F.col("updated_at") >= F.lit("2001-07-26").cast("timestamp")) & (n % 3 == 0)
    return t.withColumn("cwd", F.when(fresh, F.concat(F.lit("/w/n"), (n % 5).cast("string"))).otherwise(F.col("cwd")))


def live_events(spark: SparkSession, d: str) -> DataFrame:
    """F7 on the board's day, one thread per event number; some threads are unknown."""
    e = views.thread_events(spark, d)
    at = F.to_timestamp(F.lit("2001-08-01 00:00:00")) + F.make_dt_interval(secs=(F.col("event_seq") * 5 % 43200).cast("decimal(18,6)"))
    many = views.table(spark, d, "events").agg(F.count("*")).scalar()
    return e.withColumn("thread_id", (F.col("event_seq") * 2 % many).cast("string")).withColumn("ts", at)


def worked_lines(spark: SparkSession, d: str) -> DataFrame:
    """F6 as files of work: every third conversation is a subagent of the one before; assistant lines of the others end a turn."""
    number = F.col("session_id").cast("bigint")
    sub = number % 3 == 1
    path = F.when(sub, F.concat(F.lit("/t/p/"), (number - 1).cast("string"), F.lit("/subagents/agent-"), "session_id", F.lit(".jsonl"))).otherwise(
        F.concat(F.lit("/t/p/"), "session_id", F.lit(".jsonl")))
    ends = F.col("role") == "assistant"
    lines = views.transcript_lines(spark, d).withColumns({
        "file_path": path, "subtype": F.when(ends, "turn_duration"), "duration_ms": F.when(ends, (F.col("line_no") + 1) * 1500.5)})
    return lines.withColumn("cwd", F.when((number % 5 != 0) & (F.col("line_no") > 0), F.col("cwd")))


#: Moves transcripts to the days of the thread table, so that a list of both mixes them.
DAYS_APART = -8193


def runtimes(spark: SparkSession, d: str) -> DataFrame:
    """Every user as a runtime: whether its status file exists, whether it has usage, and when it is looked at."""
    n = F.col("user_id")
    last = views.events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    soon = F.col("last_ts") + F.expr("interval 10 minutes")
    return last.select(n.cast("string").alias("runtime"), (n % 3 != 0).alias("exists"), (n % 2 == 0).alias("has_usage"),
                       F.when(n % 4 == 0, F.to_timestamp(F.lit(views.EVENTS_AS_OF))).otherwise(soon).alias("checked_at"))


def quota_of_some(spark: SparkSession, d: str) -> DataFrame:
    """Quota snapshots of the runtimes that wrote any: all but every fifth."""
    return views.quota_documents(spark, d).where(F.col("runtime").cast("bigint") % 5 != 0)


def resumed_lines(spark: SparkSession, d: str) -> DataFrame:
    """F6 and, of every fourth conversation, a file that resumes it: the same messages a minute later, every third of those files without usage."""
    lines = views.transcript_lines(spark, d)
    number = F.col("session_id").cast("bigint")
    used = {c: F.when(number % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col(c)) for c in ("input", "cache_read", "cache_create", "output")}
    again = lines.where(number % 4 == 0).withColumns(used).withColumns({
        "file_path": F.concat(F.lit("d"), F.substring("file_path", 2, 100)), "session_id": F.concat(F.lit("r"), "session_id"), "ts": F.col("ts") + F.expr("interval 1 minute")})
    return lines.unionByName(again)


def limit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rate-limit responses: named and default entries, malformed slots, credits."""
    e = views.events(spark, d)
    n = F.col("event_id")
    window = F.concat(F.lit('{"usedPercent":'), F.col("value").cast("string"), F.lit(',"windowDurationMins":300,"resetsAt":1700000000}'))
    second = (
        F.when(n % 5 == 0, "null").when(n % 5 == 1, '{"windowDurationMins":10080}')
        .when(n % 5 == 2, '{"usedPercent":"12.5","windowDurationMins":"10080"}').otherwise('{"usedPercent":3}')
    )
    entry = F.concat(F.lit('{"limitId":"'), F.when(n % 2 == 0, "main").otherwise("base"), F.lit('","primary":'), window, F.lit(',"secondary":'), second, F.lit("}"))
    holder = F.when(n % 2 == 0, F.concat(F.lit('"rateLimitsByLimitId":{"main":'), entry, F.lit('},"rateLimits":{"limitId":"x"}'))).otherwise(
        F.concat(F.lit('"rateLimits":'), F.when(n % 9 == 0, '{"limitId":"empty"}').otherwise(entry)))
    credit = F.concat(
        F.lit('{"availableCount":'), (F.col("k") % 5 - 1).cast("string"), F.lit(',"credits":['),
        F.lit('{"id":"c1","status":"available","expiresAt":'), (F.lit(1700000000) + F.col("k") * 10).cast("string"), F.lit("},"),
        F.lit('{"id":"c2","status":"used","expiresAt":5},{"id":"c3","status":"available"},'),
        F.lit('{"id":"c0","status":"available","expiresAt":1700000400}]}'),
    )
    return e.select("event_id", F.concat(F.lit("{"), holder, F.lit(',"rateLimitResetCredits":'), credit, F.lit("}")).alias("value"))
