"""From raw files to the ledger, the marts and the snapshot: the whole job in stages.

Each stage ends in a Parquet table, so a later stage reads columns instead of parsing
text again, and a lost executor never costs more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.functions.tokens import with_cost
from tallyloom.operators import (
    counters, intervals, lineage, ordered, rankings, scoring, skills, transcripts, trend, usage, worktime,
)
from tallyloom.schemas import TOKEN_COLUMNS
from tallyloom.session import materialise
from tallyloom.sources import increments, logs, sinks, threads as thread_source

LEDGER_COLUMNS = (
    "runtime", "thread_id", "seq", "project_path", "model", "ts", *TOKEN_COLUMNS, "cost_usd", "source_quality",
)


def log_ledger(records: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session-log records to (usage events, inherited tokens per forked thread).

    ``threads`` has thread_id, cwd and model; its log_path names the file of each thread.  Without that column a
    file's stem is its thread.  Counters are normalised, prefixes that forks inherited are dropped, models carried
    forward, usage priced.
    """
    ledger, baselines, _ = log_usage(records, threads)
    return ledger, baselines


def owned_records(records: DataFrame, threads: DataFrame) -> tuple[DataFrame, Column | None]:
    """Records keyed by the thread table, and the column that holds the thread (None: the file's stem)."""
    if "log_path" not in threads.columns:
        return records, None
    return logs.by_threads(records, threads), F.col("thread_id")


def log_usage(records: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``log_ledger``, and the counter events of each thread for ``usage.rollup_windows``."""
    records, thread = owned_records(records, threads)
    lines = materialise(logs.counter_lines(records, thread))
    numbered = materialise(lineage.number_deltas(materialise(counters.normalise(lines).drop("model"))))
    prefixes = materialise(lineage.inherited_prefix(numbered, lineage.fork_parents(lines.where("line_type = 'session_meta'"))))
    models = lineage.carry_model(lines.select("thread_id", "line_no", "line_type", "model"), threads).where(
        "line_type = 'token_count'"
    ).select("thread_id", "line_no", "model")
    kept = lineage.drop_inherited(numbered, prefixes).join(models, ["thread_id", "line_no"], "left")
    owned = kept.join(threads.select("thread_id", F.col("cwd").alias("project_path")), "thread_id", "left")
    ledger = with_cost(owned, "model", "log").select(
        F.lit("log").alias("runtime"), "thread_id", F.col("line_no").alias("seq"),
        F.coalesce("project_path", F.lit("")).alias("project_path"), "model", "ts", *TOKEN_COLUMNS, "cost_usd",
        F.lit("detailed").alias("source_quality"),
    )
    read = counters.counter_events(lines)
    return ledger, lineage.fork_baselines(numbered, prefixes), lineage.event_counts(read, prefixes)


def transcript_ledger(lines: DataFrame) -> DataFrame:
    return transcripts.ledger(lines).select(*LEDGER_COLUMNS)


def write_ledger(ledger: DataFrame, path: str, tz: str = "UTC") -> None:
    """The ledger as a table partitioned by civil day."""
    from tallyloom.functions.times import local_day

    sinks.write_mart(ledger.withColumn("day", local_day("ts", tz)), path, "day")


def log_work(records: DataFrame, threads: DataFrame, edges: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Turn records (scanned with ``logs.WORK_TYPES``) to (intervals, workers)."""
    kind = nm.worker_kind("thread_source")
    owners = worktime.attach_parents(threads, edges).select(
        "thread_id", "created_at", kind.alias("worker_kind"),
        nm.automation_id("thread_source", "title").alias("automation_id"),
        nm.project_id("cwd", F.lit("log")).alias("project_id"), nm.project_name("cwd").alias("project_name"), "parent_id", "updated_at",
    ).withColumn("worker_id", nm.worker_id("worker_kind", "thread_id", "automation_id"))
    records, thread = owned_records(records, threads)
    marks = logs.turn_marks(records, thread).join(owners, "thread_id")
    pairs = worktime.pair_turns(marks, as_of, ordered.line_slot("line_no"), ["line_no"])
    parent = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("log:main:"), "parent_id"))
    workers = owners.select(
        "worker_id", "worker_kind", "project_id", "project_name", parent.alias("parent_id"),
        F.struct(-F.unix_micros("updated_at"), "thread_id").alias("load_order"),
    )
    columns = ("interval_id", "worker_id", "worker_kind", "project_id", "start_at", "end_at", "quality", "is_autonomous")
    first = worktime.first_intervals(pairs.select(*columns, F.col("line_no").alias("load_order")))
    return first, worktime.distinct_workers(workers)


def transcript_work(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcript lines (scanned with the pattern ``timestamp``) to (intervals, workers).

    Main sessions give an interval per duration mark, subagents one for their lifetime.  Every file is a worker, also one
    without intervals; a subagent's parent is the session whose folder holds it.  A file's project is the first folder it
    names; marks before that line have none.
    """
    path = F.col("file_path")
    subagent = nm.is_subagent_file(path)
    file_id = F.replace(logs.thread_of(path), F.lit("agent-"), F.lit(""))
    files = lines.groupBy("file_path").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.min(F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("named_at"))
    files = files.withColumns({"file_id": file_id, "worker_kind": F.when(subagent, "subagent").otherwise("main")}).withColumn(
        "worker_id", F.concat_ws(":", F.lit("transcript"), "worker_kind", "file_id"))
    session = F.regexp_extract("file_path", "([^/]+)/[^/]+/[^/]+$", 1)
    workers = files.select(
        "worker_id", "worker_kind", nm.project_id("cwd", F.lit("transcript")).alias("project_id"), nm.project_name("cwd").alias("project_name"),
        F.when(F.col("worker_kind") == "subagent", F.concat(F.lit("transcript:main:"), session)).alias("parent_id"), F.col("file_path").alias("load_order"))

    columns = ("interval_id", "worker_id", "worker_kind", "project_id", "start_at", "end_at", "quality", "is_autonomous")
    named = lines.drop("cwd").join(files, "file_path")
    known = F.when(F.col("line_no") >= F.col("named_at"), F.col("cwd"))
    marks = worktime.duration_marks(named.where("subtype = 'turn_duration'").withColumn("project_id", nm.project_id(known, F.lit("transcript")))).select(*columns)
    owners = files.where("worker_kind = 'subagent'").select("file_path", "worker_id", "worker_kind", nm.project_id("cwd", F.lit("transcript")).alias("project_id"))
    lives = worktime.lifetimes(named.where("worker_kind = 'subagent'")).join(owners, "file_path").select(*columns)
    return marks.unionByName(lives), worktime.distinct_workers(workers)


def snapshot(
    ledger: DataFrame, calls: DataFrame, loads: DataFrame, catalog: DataFrame, work: DataFrame, as_of: str,
    tz: str = "UTC", board: DataFrame | None = None, quota: DataFrame | None = None, events: DataFrame | None = None,
) -> DataFrame:
    """The snapshot document from the canonical tables; ``events`` has the counter events per thread (``log_usage``)."""
    dense = materialise(usage.daily_dense(ledger, as_of, tz))
    return sinks.snapshot_document(
        usage.rollup_windows(ledger, as_of, tz, events), trend.select_window(dense, as_of, 7, tz).select("day", "tokens"),
        rankings.recent_projects(ledger, as_of, tz), rankings.tools_by_share(calls, ledger),
        skills.skill_usage(loads, catalog), scoring.report(work, as_of, tz), as_of,
        trend=trend.summary(dense, as_of, tz), board=board, quota=quota,
    )


def read_everything(spark: SparkSession, log_path: str, transcript_path: str | None, threads: DataFrame, store: str | None = None) -> DataFrame:
    """Ledger of both runtimes from their files, however old.

    With a ``store`` folder the parsed records are kept between runs, and only new and changed files are read.
    """
    def records(path: str, scan: increments.Scan, name: str) -> DataFrame:
        return increments.FileStore(spark, f"{store.rstrip('/')}/{name}").refresh(path, scan) if store else scan(spark, path)

    log, _ = log_ledger(records(log_path, logs.scan_session_logs, "logs"), threads)
    frames = [log]
    if transcript_path:
        frames.append(transcript_ledger(records(transcript_path, logs.scan_transcripts, "transcripts")))
    return thread_source.union_runtimes(frames)


def read_work(spark: SparkSession, log_path: str, transcript_path: str | None, threads: DataFrame, edges: DataFrame, as_of: str, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Work intervals and workers of both runtimes; threads and files too old for the longest period are left out."""
    bound = thread_source.prune_after(spark, as_of, tz)
    work, workers = log_work(logs.scan_session_logs(spark, log_path, logs.WORK_TYPES), thread_source.updated_since(threads, as_of, tz), edges, as_of)
    if transcript_path:
        more, others = transcript_work(logs.scan_transcripts(spark, transcript_path, pattern='"timestamp"', modified_after=bound))
        work, workers = work.unionByName(more), workers.unionByName(others.select(*workers.columns))
    return work, workers


__all__ = [
    "intervals", "log_ledger", "log_usage", "log_work", "read_everything", "read_work", "snapshot", "transcript_ledger", "transcript_work", "write_ledger",
]
