"""Every operator as a query over the given tables: key -> (spark, sf_dir) -> DataFrame.

Columns are plain (bigint, double, boolean, text, timestamps without zone), money and
ratios are rounded to six decimals, days are ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import measures as ms
from tallyloom.functions import names as nm
from tallyloom.functions import times as tm
from tallyloom.functions import tokens as tok
from tallyloom.operators import (
    board, counters, intervals, lineage, ordered, quota, rankings, scoring, skills, transcripts, trend, usage, worktime,
)
from tallyloom.plans import derived, ledger, rounds, views
from tallyloom.plans.views import EVENTS_AS_OF, ORDERS_AS_OF
from tallyloom.schemas import TOKEN_COLUMNS
from tallyloom.session import materialise, prepare
from tallyloom.sources import documents, increments, logs, notifications, sinks, threads as thread_source
from tallyloom.streaming import jobs, live, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HOME = "/home/u"
LA = "America/Los_Angeles"


def query(fn: Query) -> Query:
    """Register a query under its function name and give its result plain columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(prepare(spark), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def plain(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "decimal":
            column = F.round(column, 6).cast("double")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("bigint")
        elif kind == "float":
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def _r(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# ============================================================== scans and sinks


@query
def s01_session_log_scan(spark, d):
    """Log lines built from the counter log, parsed by the session-log scan."""
    records = logs.parse_session_logs(derived.session_log_lines(spark, d))
    lines = logs.counter_lines(records)
    return lines.groupBy("thread_id", "line_type").agg(
        F.count("*").alias("line_count"), F.sum("line_no").alias("line_no_sum"),
        F.sum("cum.total_tokens").alias("cum_total"), F.sum("last.input_tokens").alias("last_input"),
        F.count_if(F.col("cum").isNotNull()).alias("with_cum"), F.max("ts").alias("last_ts"),
        F.max("forked_from_id").alias("parent"), F.max("model").alias("model"),
    )


@query
def s01_tool_calls(spark, d):
    """Tool calls of the same lines, of both kinds."""
    calls = logs.call_lines(logs.parse_session_logs(derived.session_log_lines(spark, d)))
    return calls.groupBy("thread_id", "tool_name").agg(F.count("*").alias("call_count"), F.sum("seq").alias("seq_sum"), F.max("ts").alias("last_ts"))


@query
def s13_ledger_by_path(spark, d):
    """The whole log ledger from raw lines whose file names are not the thread's id; the thread table names the files."""
    lines = derived.session_log_lines(spark, d)
    path = F.regexp_replace("file_path", "^/logs/(.*)[.]jsonl$", "/logs/day 1/rollout-2024-$1-x.jsonl")
    named = lines.select("file_path").distinct().select(
        logs.thread_of("file_path").alias("thread_id"), path.alias("log_path"), F.lit("/w").alias("cwd"), F.lit("gpt-5").alias("model"),
        F.lit(1).alias("tokens_used"), F.to_timestamp(F.lit(EVENTS_AS_OF)).alias("updated_at"))
    uri = F.concat(F.lit("file://"), F.replace(path, F.lit(" "), F.lit("%20")))
    kept, _, events = ledger.log_usage(logs.parse_session_logs(lines.withColumn("file_path", uri)), materialise(named))
    sums = kept.groupBy("thread_id").agg(F.count("*").alias("kept_deltas"), F.sum("total_tokens").alias("kept_tokens"))
    return events.join(sums, "thread_id", "left").select("thread_id", "token_events", F.coalesce("kept_deltas", F.lit(0)).alias("kept_deltas"), F.coalesce("kept_tokens", F.lit(0)).alias("kept_tokens"))


@query
def s02_transcript_scan(spark, d):
    lines = logs.parse_transcripts(derived.transcript_texts(spark, d))
    rows = transcripts.usage_vector(transcripts.carry_attributes(lines))
    return rows.select("session_id", "line_no", "ts", "message_id", "model", "project_path",
                       *TOKEN_COLUMNS, F.size("tool_uses").alias("tool_uses"))


@query
def s03_threads_with_logs(spark, d):
    return thread_source.with_logs(views.threads(spark, d)).select("log_path", "thread_id", "tokens_used", "updated_at")


@query
def s04_task_documents(spark, d):
    return documents.parse_tasks(derived.task_documents(spark, d))


@query
def s05_skill_counters(spark, d):
    return documents.parse_skill_counters(derived.skill_counter_documents(spark, d))


@query
def s06_schedule_files(spark, d):
    return documents.parse_schedules(derived.schedule_files(spark, d)).drop("path")


@query
def s04_stats_fallback(spark, d):
    """Window roll-ups with stats caches at hand: taken where no usage was found, left alone where it was."""
    caches = documents.parse_stats_cache(derived.stats_documents(spark, d))
    used = transcripts.ledger(views.transcript_lines(spark, d))
    cases = [usage.or_cached(usage.rollup_windows(rows, EVENTS_AS_OF), caches).withColumn("usage", F.lit(name)) for name, rows in (("none", used.where(F.lit(False))), ("some", used))]
    return cases[0].unionByName(cases[1])


@query
def s07_skill_catalog(spark, d):
    return views.skill_catalog(spark, d)


@query
def s07_skill_files(spark, d):
    """Pages as skill files in the shape of a binary scan; some are too long to be read."""
    files = views.table(spark, d, "pages").select(
        F.concat(F.lit("file:///home/u/.agent/skills/"), "page_id", F.lit("/SKILL.md")).alias("path"), F.to_timestamp(F.lit(EVENTS_AS_OF)).alias("modificationTime"),
        F.when(F.col("page_id") % 11 == 7, documents.MAX_SKILL_BYTES + F.col("page_id") + 1).otherwise(F.octet_length("html")).cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return documents.skill_files(files.where("html is not null")).select("skill_path", "byte_count", "token_estimate")


@query
def s08_changed_files(spark, d):
    listing, manifest = derived.file_listing(spark, d), derived.file_manifest(spark, d)
    changed = increments.changed_files(listing, manifest)
    live_rows = increments.live_rows(manifest.select("file_path"), listing)
    return changed.select("file_path", F.lit("changed").alias("state")).unionByName(
        live_rows.select("file_path", F.lit("live").alias("state"))
    )


@query
def s08_refreshed_store(spark, d):
    """Rows kept by the store after files were added, replaced, deleted and put back; equals a full parse."""
    return rounds.refreshed_transcripts(spark, d).groupBy("message_id", "model").agg(
        F.count("*").alias("line_count"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"))


@query
def s09_pruned_threads(spark, d):
    return thread_source.updated_since(views.threads(spark, d), ORDERS_AS_OF).select("thread_id", "updated_at")


def _both(spark, d, allow=None):
    log = views.usage_events(spark, d)
    transcript = transcripts.ledger(views.transcript_lines(spark, d)).drop("file_path", "message_id")
    return thread_source.union_runtimes([log, transcript], allow)


@query
def s10_runtime_union(spark, d):
    return _both(spark, d, ["log", "transcript"]).select(
        "runtime", "thread_id", "seq", "project_path", "model", "ts", *TOKEN_COLUMNS, "cost_usd", "source_quality"
    )


@query
def s11_snapshot_document(spark, d):
    """The nested snapshot, compared by a few values read back from the JSON."""
    events = materialise(views.usage_events(spark, d))
    rollup = usage.rollup_windows(events, EVENTS_AS_OF)
    loads, catalog = views.skill_loads(spark, d), views.skill_catalog(spark, d)
    document = sinks.snapshot_document(
        rollup, usage.seven_day_strip(events, EVENTS_AS_OF), rankings.recent_projects(events, EVENTS_AS_OF),
        rankings.tools_by_share(views.tool_calls(spark, d), events), skills.skill_usage(loads, catalog),
        scoring.report(views.work_intervals(spark, d), EVENTS_AS_OF), EVENTS_AS_OF,
    )
    get = F.get_json_object
    return document.select(
        get("snapshot", "$.schemaVersion").cast("bigint").alias("schema_version"),
        get("snapshot", "$.refreshedAt").alias("refreshed_at"),
        get("snapshot", "$.detailedUsage.lifetime.tokens.visibleTotalTokens").cast("bigint").alias("lifetime_tokens"),
        get("snapshot", "$.detailedUsage.tokenEventCount").cast("bigint").alias("token_events"),
        F.json_array_length(get("snapshot", "$.dailyBuckets")).alias("day_count"),
        F.json_array_length(get("snapshot", "$.projects")).alias("project_count"),
        F.json_array_length(get("snapshot", "$.toolUsages")).alias("tool_count"),
        F.json_array_length(get("snapshot", "$.skillUsages")).alias("skill_count"),
        get("snapshot", "$.projects[0].fullPath").alias("first_project"),
        get("snapshot", "$.toolUsages[0].name").alias("first_tool"),
        F.json_array_length(get("snapshot", "$.leadership")).alias("report_count"),
    )


@query
def s12_notifications(spark, d):
    raw = F.from_json("value", notifications.NOTIFICATION)
    parsed = derived.notification_texts(spark, d).select(raw.alias("n")).select("n.*")
    return notifications.notification_rows(parsed).select("thread_id", "event_seq", "method", "status", "flag", "turn_id", "name", "hidden")


@query
def s12_tailed_notifications(spark, d):
    """The notifications again, from files that grow between two runs: every line once."""
    return rounds.tailed_notifications(spark, d).select("thread_id", "event_seq", "method", "status", "flag", "turn_id", "name", "hidden")


# =================================================================== projections


@query
def p01_token_split(spark, d):
    return views.usage_events(spark, d).select(
        "thread_id", "seq", tok.billable_cached().alias("billable_cached"), tok.uncached_input().alias("uncached"),
        tok.visible_total().alias("visible_total"), tok.split_total().alias("split_total"),
    )


@query
def p02_model_price(spark, d):
    models = derived.model_names(spark, d)
    parts = ("input", "cached", "output")
    return models.select(
        "event_id", "model",
        *[tok.model_price("model", p, "log").cast("double").alias(f"log_{p}") for p in parts],
        *[tok.model_price("model", p, "transcript").cast("double").alias(f"transcript_{p}") for p in parts],
    )


@query
def p03_cost(spark, d):
    return views.usage_events(spark, d).select("thread_id", "seq", "cost_usd")


@query
def p04_model_name(spark, d):
    return derived.model_names(spark, d).select(
        "event_id", tok.model_name("model").alias("model_name"), tok.model_id("model").alias("model_id"),
        tok.resolve_model("model", F.col("thread_model")).alias("resolved"),
    )


@query
def p05_timestamp_parse(spark, d):
    return derived.timestamp_texts(spark, d).select("o_orderkey", tm.parse_instant("text").alias("parsed"))


@query
def p06_day_key(spark, d):
    ts = F.col("ts")
    return views.events(spark, d).select(
        "event_id", tm.day_key(ts).alias("day_utc"), tm.day_key(ts, LA).alias("day_la"),
        tm.start_of_day(ts, LA).alias("day_start_la"),
    )


@query
def p07_project_identity(spark, d):
    t = views.threads(spark, d).withColumn("encoded", F.replace(F.col("cwd"), F.lit("/"), F.lit("-")))
    return t.groupBy("cwd", "encoded").agg(F.count_distinct(nm.project_id("cwd", F.lit("log"))).alias("ids"),
                                           F.min(nm.project_name("cwd")).alias("name")).select(
        "cwd", "ids", "name", nm.decode_directory("encoded").alias("decoded"))


@query
def p08_title(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", nm.title(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("source")).alias("title"))


@query
def p09_tool_category(spark, d):
    return derived.tool_names(spark, d).select(
        "event_id", "tool_name", nm.tool_category("tool_name", "log").alias("log_category"),
        nm.tool_category("tool_name", "transcript").alias("transcript_category"))


@query
def p10_skill_paths(spark, d):
    return skills.extract_loads(derived.tool_arguments(spark, d), HOME).select("event_id", "skill_path")


@query
def p11_text_tokens(spark, d):
    return views.table(spark, d, "documents").select("doc_id", ms.text_tokens("text").alias("token_estimate"))


@query
def p12_skill_source(spark, d):
    paths = derived.skill_paths(spark, d)
    return paths.select("event_id", nm.skill_source("skill_path", HOME).alias("label"), nm.skill_name("skill_path").alias("name"))


@query
def p13_worker_kind(spark, d):
    t = views.threads(spark, d).withColumn(
        "text", F.when(F.col("thread_id").cast("bigint") % 2 == 0, F.concat(F.lit("x Automation ID: a"), F.col("thread_id").cast("bigint") % 40, F.lit("\nmore"))).otherwise(F.col("title")))
    kind = nm.worker_kind("thread_source")
    auto = nm.automation_id("thread_source", "text")
    return t.withColumn("kind", kind).withColumn("auto", auto).select(
        "thread_id", "kind", F.col("auto").alias("automation_id"), nm.worker_id("kind", "thread_id", "auto").alias("worker_id"),
        (F.col("kind") != "main").alias("is_autonomous"), nm.is_subagent_file(F.concat(F.lit("/s/"), "thread_source", F.lit("s/"), "thread_id")).alias("subagent_file"))


@query
def p14_remaining_percent(spark, d):
    return quota.slot_rows(views.quota_documents(spark, d)).select("snapshot_id", "slot", F.round("remaining_percent", 6).alias("remaining_percent"))


@query
def p15_value_progress(spark, d):
    by_day = usage.daily(views.usage_events(spark, d), "UTC", ("project_path",))
    cost = F.col("cost_usd").cast("double") * 300
    return by_day.select("project_path", "day", F.round(ms.value_fraction(cost), 6).alias("fraction"), ms.milestone(cost).alias("milestone"))


@query
def p16_task_state(spark, d):
    now = tm.instant(ORDERS_AS_OF)
    t = views.threads(spark, d)
    word = derived.status_word()
    return t.select("thread_id", nm.activity_column("updated_at", now).alias("activity"), nm.activity_state("updated_at", now).alias("activity_state"),
                    nm.task_column(word).alias("task_column"), nm.task_state(word).alias("task_state"))


@query
def p17_visible_threads(spark, d):
    t = views.threads(spark, d)
    n = F.col("thread_id").cast("bigint")
    source = F.when(n % 4 == 0, "SubAgent").when(n % 4 == 1, "vscode")
    keys = F.when(n % 6 == 3, F.array(F.lit("subAgent"), F.lit("depth")))
    return t.where(~nm.is_subagent(F.col("thread_source"), source, keys)).select("thread_id")


# ====================================================================== sequences


def _lines(spark, d):
    return materialise(views.counter_log(spark, d))


def _numbered_forks(spark, d):
    log = materialise(views.fork_log(spark, d))
    numbered = materialise(lineage.number_deltas(materialise(counters.normalise(log))))
    meta = log.where("forked_from_id is not null")
    return log, numbered, lineage.fork_parents(meta)


@query
def t01_counter_deltas(spark, d):
    return counters.normalise(_lines(spark, d)).select("thread_id", "line_no", *TOKEN_COLUMNS)


@query
def t02_carry_model(spark, d):
    threads = views.events(spark, d).select(F.col("user_id").cast("string").alias("thread_id")).distinct().withColumn(
        "model", F.when(F.col("thread_id").cast("bigint") % 4 != 0, F.lit(" thread-model ")))
    return lineage.carry_model(_lines(spark, d), threads).where("line_type = 'token_count'").select("thread_id", "line_no", "model")


@query
def t03_carry_attributes(spark, d):
    return transcripts.carry_attributes(views.transcript_lines(spark, d)).select("session_id", "line_no", "model", "project_path")


@query
def t04_fork_parents(spark, d):
    return lineage.fork_parents(views.fork_log(spark, d).withColumn(
        "forked_from_id", F.when(F.col("line_no") % 7 != 0, F.col("forked_from_id"))))


@query
def t05_inherited_prefix(spark, d):
    _log, numbered, parents = _numbered_forks(spark, d)
    return lineage.inherited_prefix(numbered, parents)


@query
def t06_fork_dedup(spark, d):
    log, numbered, parents = _numbered_forks(spark, d)
    prefixes = materialise(lineage.inherited_prefix(numbered, parents))
    kept = lineage.drop_inherited(numbered, prefixes).groupBy("thread_id").agg(
        F.count("*").alias("kept_deltas"), F.sum("total_tokens").alias("kept_tokens"))
    raw = numbered.groupBy("thread_id").agg(F.sum("total_tokens").alias("tokens_used"))
    adjusted = lineage.adjust_threads(raw, lineage.fork_baselines(numbered, prefixes))
    counts = lineage.event_counts(counters.counter_events(log), prefixes)
    return adjusted.join(counts, "thread_id").join(kept, "thread_id", "left").na.fill(0)


@query
def t07_message_dedup(spark, d):
    rows = transcripts.first_per_message(transcripts.usage_vector(views.transcript_lines(spark, d)))
    return rows.select("file_path", "line_no", "message_id", "total_tokens")


@query
def t08_usage_vector(spark, d):
    return transcripts.usage_vector(views.transcript_lines(spark, d)).select("file_path", "line_no", *TOKEN_COLUMNS)


@query
def t09_turn_pairs(spark, d):
    marks = derived.turn_marks(spark, d)
    pairs = worktime.pair_turns(marks, EVENTS_AS_OF, ordered.line_slot("line_no"), ["line_no"])
    return pairs.select("interval_id", "line_no", "start_at", "end_at", "quality", "is_autonomous")


@query
def t10_duration_marks(spark, d):
    lines = views.events(spark, d).select(
        F.col("user_id").cast("string").alias("file_id"), "event_id", "ts",
        F.when(F.col("event_type") != "view", F.col("value") * 1000).alias("duration_ms"),
        F.when(F.col("user_id") % 3 == 0, "main").otherwise("subagent").alias("worker_kind"))
    return worktime.duration_marks(lines).select("event_id", "interval_id", "start_at", "end_at", "quality")


@query
def t11_lifetimes(spark, d):
    return worktime.lifetimes(views.transcript_lines(spark, d)).select("file_path", "start_at", "end_at", "quality")


@query
def t12_distinct_work(spark, d):
    w = worktime.distinct_workers(views.workers(spark, d).withColumn(
        "parent_id", F.when(F.col("load_order") % 3 == 0, F.col("parent_id"))))
    rows = views.work_intervals(spark, d).withColumn("load_order", F.col("interval_id").cast("bigint")).withColumn(
        "interval_id", F.concat_ws(":", "worker_id", F.date_format("start_at", "yyyy-MM-dd")))
    i = worktime.first_intervals(rows)
    return w.select(F.lit("worker").alias("what"), F.col("worker_id").alias("id"), "project_id", "parent_id", F.lit(None).cast("timestamp").alias("start_at")).unionByName(
        i.select(F.lit("interval").alias("what"), F.col("interval_id").alias("id"), "project_id", F.lit(None).cast("string").alias("parent_id"), "start_at"))


@query
def t12_transcript_work(spark, d):
    """Intervals and workers of transcript files: sessions with duration marks, and subagents below the session they belong to."""
    work, workers = ledger.transcript_work(derived.worked_lines(spark, d))
    # Ids of projects are hashes; an interval's project is told by the names of the workers with its id.
    names = workers.select("project_id", "project_name").distinct()
    return workers.select(F.lit("worker").alias("what"), F.col("worker_id").alias("id"), "worker_kind", "project_name", "parent_id", F.lit(None).cast("timestamp").alias("start_at"), F.lit(None).cast("timestamp").alias("end_at")).unionByName(
        work.join(names, "project_id", "left").select(F.lit("interval").alias("what"), F.col("interval_id").alias("id"), "worker_kind", F.coalesce("project_name", F.lit("uncategorized")).alias("project_name"), F.col("worker_id").alias("parent_id"), "start_at", "end_at"))


# ========================================================================== joins


@query
def j01_thread_parents(spark, d):
    return worktime.attach_parents(views.threads(spark, d), views.spawn_edges(spark, d)).select("thread_id", "parent_id")


@query
def j02_fork_pairs(spark, d):
    """Counted events of a child next to the parent's event at the same position."""
    _log, numbered, parents = _numbered_forks(spark, d)
    child = numbered.join(parents, "thread_id")
    parent = numbered.select(F.col("thread_id").alias("parent_id"), "idx", F.col("line_no").alias("parent_line"))
    return child.join(parent, ["parent_id", "idx"]).select("thread_id", "parent_id", "idx", "line_no", "parent_line")


@query
def j03_adjusted_threads(spark, d):
    _log, numbered, parents = _numbered_forks(spark, d)
    baselines = lineage.fork_baselines(numbered, lineage.inherited_prefix(numbered, parents))
    totals = numbered.groupBy("thread_id").agg(F.sum("total_tokens").alias("tokens_used"))
    return lineage.adjust_threads(totals, baselines)


@query
def j04_active_workers(spark, d):
    who = worktime.distinct_workers(views.workers(spark, d))
    isl = materialise(intervals.islands(views.work_intervals(spark, d), EVENTS_AS_OF))
    return intervals.active_workers(who, isl).select("period", "worker_id", "worker_kind", "project_id")


@query
def j05_skill_sizes(spark, d):
    loads = views.skill_loads(spark, d).groupBy("skill_path").agg(F.count("*").alias("load_count"))
    return skills.attach_catalog(loads, views.skill_catalog(spark, d))


@query
def j06_skill_names(spark, d):
    requests, catalog, roots = derived.skill_requests(spark, d), derived.skill_files(spark, d), derived.repository_roots(spark, d)
    return skills.resolve_names(requests, catalog, roots, HOME).select("skill_name", "project_path", "resolved_path")


def _board(spark, d):
    t = derived.board_threads(spark, d)
    return board.thread_items(t, derived.BOARD_AS_OF).unionByName(board.archived_items(t, derived.BOARD_AS_OF))


def _live(spark, d):
    folded = live.fold_events(derived.live_events(spark, d))
    return live.downgrade(folded, True)


@query
def j07_live_board(spark, d):
    merged = board.merge_live(_board(spark, d), _live(spark, d), derived.BOARD_AS_OF)
    return merged.select("item_id", "thread_id", "title", "updated_at", "tokens", "column_kind", "display_state", "runtime_state", "is_realtime")


def _flat_windows(df, *extra):
    return df.select(*extra, *[F.col(f"{k}.used_percent").alias(f"{k}_used") for k in quota.KINDS])


@query
def j08_quota_carry(spark, d):
    committed = quota.understand(views.quota_documents(spark, d))
    return _flat_windows(quota.carry_history(committed), "runtime", "snapshot_id", "ok", "status")


@query
def j09_new_projects(spark, d):
    t = derived.threads_with_new_projects(spark, d)
    recent = rankings.approximate_projects(t, ORDERS_AS_OF, k=None)
    return rankings.new_projects(recent, rankings.approximate_projects(t, k=None)).select("project_id", "thread_count", "all_threads")


@query
def j10_dense_days(spark, d):
    return usage.daily_dense(views.usage_events(spark, d), EVENTS_AS_OF).select("day", "tokens", "cost_usd", "input_tokens")


# ========================================================================== usage


@query
def a01_window_rollup(spark, d):
    return usage.rollup_windows(views.usage_events(spark, d), EVENTS_AS_OF)


@query
def a01_window_rollup_la(spark, d):
    return usage.rollup_windows(views.usage_events(spark, d), EVENTS_AS_OF, LA)


@query
def a02_daily_usage(spark, d):
    return usage.daily(views.usage_events(spark, d))


@query
def a03_daily_by_model(spark, d):
    return usage.daily_by_model(views.usage_events(spark, d)).select("model_id", "day", "model", "tokens", "cost_usd", "output_tokens")


@query
def a04_seven_day_strip(spark, d):
    return usage.seven_day_strip(views.usage_events(spark, d), EVENTS_AS_OF)


@query
def a04_seven_day_threads(spark, d):
    return usage.seven_day_threads(views.threads(spark, d), ORDERS_AS_OF)


@query
def a05_thread_totals(spark, d):
    return usage.thread_totals(views.threads(spark, d), ORDERS_AS_OF)


@query
def a06_recent_threads(spark, d):
    return rankings.recent_threads(views.threads(spark, d)).select("thread_id", "title", "tokens_used", "updated_at", "cwd", "archived")


@query
def a06_recent_transcripts(spark, d):
    """Every file's own usage, resumed sessions and files without usage included."""
    return rankings.transcript_threads(derived.resumed_lines(spark, d)).drop("file_path")


@query
def a14_recent_threads(spark, d):
    """The recent threads of both runtimes in one list."""
    columns = ("thread_id", "title", "tokens_used", "updated_at", "cwd", "archived")
    log = rankings.recent_threads(views.threads(spark, d)).select(F.lit("log").alias("runtime"), *columns)
    # Both fixtures end on the same day.
    moved = F.col("updated_at") + F.make_dt_interval(days=F.lit(derived.DAYS_APART))
    other = rankings.transcript_threads(derived.resumed_lines(spark, d)).select(F.lit("transcript").alias("runtime"), *columns).withColumn("updated_at", moved)
    return rankings.merge_threads(log.unionByName(other))


@query
def a07_recent_projects(spark, d):
    return rankings.recent_projects(views.usage_events(spark, d), EVENTS_AS_OF)


@query
def a08_approximate_projects(spark, d):
    return rankings.approximate_projects(views.threads(spark, d)).drop("cost_usd")


@query
def a09_transcript_projects(spark, d):
    return rankings.transcript_projects(transcripts.ledger(views.transcript_lines(spark, d)))


@query
def a10_tools_by_share(spark, d):
    return rankings.tools_by_share(views.tool_calls(spark, d), views.usage_events(spark, d))


def _transcript_calls(spark, d):
    return views.transcript_lines(spark, d).select(F.col("session_id").alias("thread_id"), F.col("line_no").alias("seq"), "tool_name", "ts")


@query
def a11_tools_uniform(spark, d):
    return rankings.tools_uniform(_transcript_calls(spark, d), transcripts.ledger(views.transcript_lines(spark, d)))


@query
def a12_skill_usage(spark, d):
    return skills.skill_usage(views.skill_loads(spark, d), views.skill_catalog(spark, d))


@query
def a13_skill_merge(spark, d):
    return skills.merge_global(derived.mixed_skills(spark, d))


@query
def a14_runtime_windows(spark, d):
    log = usage.rollup_windows(views.usage_events(spark, d), EVENTS_AS_OF)
    other = usage.rollup_windows(transcripts.ledger(views.transcript_lines(spark, d)), EVENTS_AS_OF)
    return rankings.merge_windows(log.unionByName(other))


@query
def a14_runtime_days(spark, d):
    log = usage.daily(views.usage_events(spark, d))
    other = usage.daily(transcripts.ledger(views.transcript_lines(spark, d)))
    return rankings.merge_days(log.select("day", "tokens").unionByName(other.select("day", "tokens")))


@query
def a14_runtime_projects(spark, d):
    log = rankings.approximate_projects(views.threads(spark, d))  # each runtime's list over all time, once
    other = rankings.transcript_projects(transcripts.ledger(views.transcript_lines(spark, d)))
    mixed = log.unionByName(other)
    return rankings.merge_projects(mixed.withColumn("project_id", F.regexp_replace("project_id", "^/w/[pc]", "/w/")))


@query
def a14_runtime_tools(spark, d):
    log = rankings.tools_by_share(views.tool_calls(spark, d), views.usage_events(spark, d)).withColumn("runtime", F.lit("log"))
    other = rankings.tools_uniform(_transcript_calls(spark, d), transcripts.ledger(views.transcript_lines(spark, d))).withColumn("runtime", F.lit("transcript"))
    return rankings.merge_tools(log.unionByName(other)).select("tool_name", "category", "call_count", "estimated_tokens", F.round("estimated_cost_usd", 4).alias("estimated_cost_usd"))


@query
def a14_runtime_skills(spark, d):
    log = skills.skill_usage(views.skill_loads(spark, d), views.skill_catalog(spark, d)).select(
        F.lit("log").alias("runtime"), F.col("skill_path").alias("skill_id"), "name", "load_count", "thread_count", "token_estimate", "last_loaded_at")
    mixed = skills.merge_global(derived.mixed_skills(spark, d)).select(
        F.lit("transcript").alias("runtime"), "skill_id", "name", "load_count", "thread_count", "token_estimate", "last_loaded_at")
    return skills.merge_runtimes(log.unionByName(mixed))


@query
def a15_preferred_today(spark, d):
    detailed = usage.rollup_windows(views.usage_events(spark, d), EVENTS_AS_OF).where("usage_window = 'today'").select(
        F.lit("log").alias("runtime"), F.col("visible_tokens").alias("today_tokens"))
    approx = usage.thread_totals(views.threads(spark, d), ORDERS_AS_OF).select(
        F.explode(F.array(F.lit("log"), F.lit("transcript"))).alias("runtime"), "today_tokens")
    return usage.preferred_today(detailed, approx)


@query
def a16_source_guard(spark, d):
    rollup = usage.rollup_windows(views.usage_events(spark, d), EVENTS_AS_OF).withColumn("visible_tokens", F.col("visible_tokens") * 5000)
    return usage.choose_source(rollup, usage.thread_totals(views.threads(spark, d), ORDERS_AS_OF))


@query
def a17_approximate_trend(spark, d):
    ledger = usage.approximate_ledger(views.threads(spark, d), ORDERS_AS_OF)
    return usage.daily_dense(ledger, ORDERS_AS_OF).select("day", "tokens", "cost_usd")


# ========================================================================== trend


def _dense(spark, d, profile="log"):
    return usage.daily_dense(views.usage_events(spark, d), EVENTS_AS_OF, profile=profile)


@query
def a18_trend_summary(spark, d):
    return trend.summary(_dense(spark, d), EVENTS_AS_OF)


@query
def a18_trend_summary_transcript(spark, d):
    return trend.summary(_dense(spark, d, "transcript"), EVENTS_AS_OF, profile="transcript")


@query
def a19_projected_cost(spark, d):
    return trend.projected_month_cost(_dense(spark, d), EVENTS_AS_OF)


@query
def a20_active_days(spark, d):
    return trend.active_days(_dense(spark, d))


@query
def a21_heat_grid(spark, d):
    return trend.heat_grid(_dense(spark, d), EVENTS_AS_OF)


@query
def a21_heat_grid_transcript(spark, d):
    return trend.heat_grid(_dense(spark, d, "transcript"), EVENTS_AS_OF, profile="transcript")


@query
def a22_heat_thresholds(spark, d):
    return trend.heat_thresholds(trend.heat_grid(_dense(spark, d), EVENTS_AS_OF))


@query
def a22_heat_thresholds_transcript(spark, d):
    return trend.heat_thresholds(trend.heat_grid(_dense(spark, d, "transcript"), EVENTS_AS_OF, profile="transcript"), "transcript")


@query
def a22_heat_levels(spark, d):
    return trend.heat_levels(trend.heat_grid(_dense(spark, d), EVENTS_AS_OF)).select("day", "level")


def _by_model(spark, d):
    # The mart by model and day feeds several steps of a report: written once.
    return materialise(trend.model_daily(derived.many_models(spark, d), EVENTS_AS_OF))


@query
def a23_model_trends(spark, d):
    return trend.model_trends(_by_model(spark, d), EVENTS_AS_OF)


@query
def a23_model_series(spark, d):
    return trend.model_dense(trend.model_daily(views.usage_events(spark, d), EVENTS_AS_OF), EVENTS_AS_OF).select("model_id", "day", "tokens", "cost_usd")


@query
def a24_window_series(spark, d):
    return trend.select_window(_dense(spark, d), EVENTS_AS_OF, 60).select("day", "tokens")


@query
def a25_area_series(spark, d):
    return trend.area_series(_by_model(spark, d), EVENTS_AS_OF, 30)


@query
def a26_metric_summary(spark, d):
    return trend.metric_summary(_dense(spark, d), EVENTS_AS_OF)


@query
def a27_model_overview(spark, d):
    return trend.model_overview(_dense(spark, d), _by_model(spark, d), EVENTS_AS_OF, 30)


@query
def a28_project_overview(spark, d):
    t = derived.threads_with_new_projects(spark, d)
    recent = materialise(rankings.approximate_projects(t, ORDERS_AS_OF))
    return rankings.project_overview(recent, rankings.approximate_projects(t, k=None))


@query
def a28_recently_active(spark, d):
    recent = rankings.approximate_projects(views.threads(spark, d), ORDERS_AS_OF)
    return rankings.recently_active(recent).select("project_id", "tokens", "last_active_at")


@query
def a29_bar_ratio(spark, d):
    top = materialise(rankings.approximate_projects(views.threads(spark, d), k=8))
    return rankings.bar_ratios(top).select("project_id", "tokens", "ratio")


@query
def a30_operation_latency(spark, d):
    return rankings.operation_latency(views.spans(spark, d))


# ====================================================================== intervals


def _islands(spark, d):
    return materialise(intervals.islands(views.work_intervals(spark, d), EVENTS_AS_OF))


@query
def i01_period_clip(spark, d):
    return intervals.clip(views.work_intervals(spark, d), EVENTS_AS_OF).select("period", "interval_id", "start_at", "end_at")


@query
def i02_worker_islands(spark, d):
    return intervals.islands(views.work_intervals(spark, d), EVENTS_AS_OF)


@query
def i03_timeline(spark, d):
    return intervals.concurrency(_islands(spark, d)).select("period", "active_micros", "parallel_micros", "peak", "worked_micros", *_r("average_parallelism"))


@query
def i04_multi_project(spark, d):
    return intervals.multi_project(_islands(spark, d))


@query
def i05_daily_points(spark, d):
    return intervals.daily_points(_islands(spark, d), EVENTS_AS_OF).drop("autonomous")


@query
def i05_daily_points_la(spark, d):
    isl = materialise(intervals.islands(views.work_intervals(spark, d), EVENTS_AS_OF, LA))
    return intervals.daily_points(isl, EVENTS_AS_OF, LA).drop("autonomous")


@query
def i06_active_days(spark, d):
    return intervals.active_days(intervals.daily_points(_islands(spark, d), EVENTS_AS_OF))


@query
def i07_work_measures(spark, d):
    m = intervals.work_measures(_islands(spark, d))
    return m.select("period", *_r("ai_hours", "autonomous_hours", "delegated_hours", "autonomous_share", "delegated_share", "longest_autonomous_hours"), "autonomous_days", "agents", "projects")


@query
def i08_effective_workers(spark, d):
    return intervals.effective_workers(_islands(spark, d)).select("period", *_r("effective_workers"))


@query
def i09_confidence(spark, d):
    return intervals.work_measures(_islands(spark, d)).select("period", *_r("confidence"))


def _measures(spark, d):
    return materialise(scoring.metrics_of(_islands(spark, d), EVENTS_AS_OF))


@query
def i10_dimensions(spark, d):
    return scoring.dimension_rows(_measures(spark, d)).select("period", "dimension", F.round("score", 4).alias("score"))


@query
def i11_composite(spark, d):
    df = scoring.composite(scoring.with_dimensions(_measures(spark, d)))
    return df.select("period", "score", F.round("core", 4).alias("core"), *_r("maturity", "coverage"))


@query
def i12_rank_band(spark, d):
    score = F.floor(F.col("value") * 2).cast("bigint")
    scored = views.events(spark, d).select("event_id", F.when(score <= 100, score).alias("score"))
    s = F.col("score")
    return scored.select("event_id", "score", scoring.band_column(s, -1).alias("level"), scoring.band_column(s, 0).alias("low"),
                         scoring.band_column(s, 1).alias("high"), scoring.next_lower_bound(s).alias("next_low"))


@query
def i13_project_contribution(spark, d):
    who = worktime.distinct_workers(views.workers(spark, d))
    return intervals.project_contributions(_islands(spark, d), who).select("period", "project_id", "project_name", "agents", *_r("ai_hours", "autonomous_hours"))


@query
def i14_report(spark, d):
    df = scoring.composite(scoring.with_dimensions(_measures(spark, d)))
    return df.select("period", "score", "level", "agents", "peak", "active_days", "projects", *_r("ai_hours", "parallel_share", "multi_share"))


# ========================================================================== quota


@query
def q01_slot_rows(spark, d):
    return quota.slot_rows(views.quota_documents(spark, d)).select("runtime", "snapshot_id", "slot", "used_percent", "window_mins", "resets_at", "malformed")


@query
def q01_limit_documents(spark, d):
    docs = documents.read_limit_documents(derived.limit_documents(spark, d), "main")
    return docs.select("event_id", "limit_id", "has_fields", "malformed", F.col("primary.used_percent").alias("primary_used"),
                       F.col("primary.window_mins").alias("primary_mins"), F.col("secondary.used_percent").alias("secondary_used"))


@query
def q02_window_kind(spark, d):
    return quota.slot_rows(views.quota_documents(spark, d)).select("snapshot_id", "slot", "kind")


@query
def q03_unique_windows(spark, d):
    u = quota.unique_windows(views.quota_documents(spark, d))
    return _flat_windows(u, "snapshot_id", *[f"{k}_count" for k in quota.KINDS], F.size("unclassified").alias("unclassified"))


@query
def q04_commit(spark, d):
    return _flat_windows(quota.understand(views.quota_documents(spark, d)), "snapshot_id", "ok")


@query
def q05_diagnostics(spark, d):
    u = quota.diagnostics(quota.unique_windows(views.quota_documents(spark, d)))
    return u.select("snapshot_id", F.array_join("messages", ";").alias("messages"))


@query
def q06_reset_credits(spark, d):
    docs = quota.reset_credits(documents.read_limit_documents(derived.limit_documents(spark, d), "main"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return docs.select("event_id", "total_count", ids("details").alias("details"), ids("inline_details").alias("inline_details"), "hidden_count", "missing_count")


@query
def q07_runtime_status(spark, d):
    return quota.latest_status(quota.understand(derived.quota_of_some(spark, d)), F.col("checked_at"), derived.runtimes(spark, d))


# ========================================================================== board


@query
def b01_open_threads(spark, d):
    return board.in_order(board.thread_items(derived.board_threads(spark, d), derived.BOARD_AS_OF)).select(
        "item_id", "thread_id", "title", "detail", "updated_at", "tokens", "column_kind", "display_state")


@query
def b02_archived_today(spark, d):
    return board.archived_items(derived.board_threads(spark, d), derived.BOARD_AS_OF).select("item_id", "thread_id", "title", "updated_at", "tokens")


@query
def b03_next_runs(spark, d):
    return board.next_runs(views.schedules(spark, d), EVENTS_AS_OF).select("schedule_id", "frequency", "hour", "minute", "next_run_at")


@query
def b04_task_board(spark, d):
    return board.in_order(board.task_items(documents.parse_tasks(derived.task_documents(spark, d)))).select(
        "item_id", "title", "detail", "updated_at", "column_kind", "display_state", "runtime_state")


@query
def b05_column_summary(spark, d):
    return board.column_summary(_board(spark, d))


@query
def b06_attention(spark, d):
    merged = board.merge_live(_board(spark, d), _live(spark, d), derived.BOARD_AS_OF)
    statuses = quota.latest_status(quota.understand(derived.quota_of_some(spark, d)), F.col("checked_at"), derived.runtimes(spark, d)).withColumnRenamed("captured_at", "since")
    return board.attention(merged, statuses)


# ====================================================================== streaming


@query
def r01_live_state(spark, d):
    """Notifications, lists and connection rows as one stream: the records after a second list."""
    return jobs.run_live_state(spark, d).where("phase = 'end'").select("thread_id", "state", "name", "turn_id", "updated_at", "is_realtime")


@query
def r02_list_replace(spark, d):
    """The same stream before the connection is lost: only listed threads, and those heard of since, are left."""
    return jobs.run_live_state(spark, d).where("phase = 'listed'").select("thread_id", "state", "name", "turn_id", "updated_at", "is_realtime")


@query
def r03_disconnect(spark, d):
    """The same stream around a loss: nothing is real time until the list after the reconnect."""
    return jobs.run_live_state(spark, d).select("phase", "thread_id", "state", "is_realtime")


@query
def r04_stream_counters(spark, d):
    """The counter log replayed as a stream with state kept between batches."""
    return jobs.run_counters(spark, d).groupBy("thread_id").agg(
        F.count("*").alias("deltas"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])


@query
def r05_daily_mart(spark, d):
    return jobs.run_daily(spark, d).select("day", "tokens", "cost_usd")


#: The zone to which the mart changes half-way.
REZONED = "America/Los_Angeles"


@query
def r05_rezoned_mart(spark, d):
    """The mart when the zone changes half-way: days so far are rebuilt, later batches go on in the new zone."""
    return jobs.run_daily(spark, d, zones=("UTC", REZONED)).select("day", "tokens", "cost_usd")


@query
def r06_discovered_files(spark, d):
    return jobs.run_discovery(spark, d)


__all__ = ["QUERIES", "tables"]
