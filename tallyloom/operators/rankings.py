"""Ranked lists: threads, projects, tools, latencies, and their merge over runtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.functions import tokens as tok
from tallyloom.functions.measures import bar_ratio
from tallyloom.functions.times import as_instant, day_start, local_day
from tallyloom.operators import transcripts
from tallyloom.schemas import MONEY, TOKEN_COLUMNS

RECENT_THREADS = {"log": 5, "transcript": 12, "all": 12}
APPROXIMATE_PROJECTS = 24
RECENT_PROJECTS = 8
LATENCY_SAMPLES = 256
TRANSCRIPT_PROJECT = "transcripts"


def _week_start(as_of: str, tz: str) -> Column:
    return day_start(F.date_sub(local_day(as_instant(as_of), tz), 6), tz)


def recent_threads(threads: DataFrame, k: int = RECENT_THREADS["log"]) -> DataFrame:
    """The ``k`` threads updated last."""
    return threads.orderBy(F.desc_nulls_last("updated_at"), "thread_id").limit(k)


def transcript_sessions(lines: DataFrame) -> DataFrame:
    """Every transcript file as a thread: (thread_id, title, tokens_used, updated_at, model, cwd, archived).

    ``lines`` are scanned transcript lines.  A file's tokens are its own: of lines with one message id the first with
    usage counts, messages that another file holds too count here as well, and a file without usage stays with zero.
    The last line that names a model or a folder decides, also one without usage; the time is the latest of its lines and,
    where the lines carry it (``modified_at``), of the file.
    """
    own = F.coalesce("message_id", F.concat(F.lit("#"), F.col("line_no").cast("string")))
    used = transcripts.usage_vector(lines).groupBy("file_path", own.alias("message")).agg(F.min_by(tok.visible_total(), "line_no").alias("tokens"))
    tokens = used.groupBy("file_path").agg(F.sum("tokens").alias("tokens_used"))
    latest = F.max("ts") if "modified_at" not in lines.columns else F.greatest(F.max("ts"), F.max("modified_at"))
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("line_no")))
    files = lines.groupBy("file_path").agg(
        F.min("session_id").alias("thread_id"), latest.alias("updated_at"), last("model").alias("model"),
        F.coalesce(last("cwd"), F.min("seed_project"), F.lit("")).alias("cwd"))
    title = F.when(F.col("cwd") == "", TRANSCRIPT_PROJECT).otherwise(F.coalesce(F.nullif(nm.last_component("cwd"), F.lit("")), "cwd"))
    return files.join(tokens, "file_path", "left").select(
        "thread_id", title.alias("title"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), "updated_at", "model", "cwd",
        F.lit(False).alias("archived"), "file_path")


def transcript_threads(lines: DataFrame, k: int = RECENT_THREADS["transcript"]) -> DataFrame:
    """Transcript sessions as recent threads."""
    return recent_threads(transcript_sessions(lines), k)


def merge_threads(threads: DataFrame, k: int = RECENT_THREADS["all"]) -> DataFrame:
    """The recent threads of all runtimes, each already a short list, as one."""
    return threads.orderBy(F.desc_nulls_last("updated_at"), "runtime", "thread_id").limit(k)


# ------------------------------------------------------------------- projects


def recent_projects(ledger: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Projects of the last seven days from detailed usage."""
    path = F.coalesce("project_path", F.lit(""))
    grouped = (
        ledger.where(F.col("ts") >= _week_start(as_of, tz))
        .groupBy(path.alias("full_path"))
        .agg(*tok.sum_tokens(), tok.sum_cost(), F.count_distinct("thread_id").alias("thread_count"),
             F.max("ts").alias("last_active_at"))
        .withColumn("tokens", tok.visible_total())
        .where("tokens > 0")
    )
    return grouped.select(
        F.when(F.col("full_path") == "", nm.UNCATEGORIZED).otherwise(F.col("full_path")).alias("project_id"),
        nm.project_name("full_path").alias("name"), "full_path", "tokens", "cost_usd",
        F.greatest("thread_count", F.lit(1)).alias("thread_count"), "last_active_at",
        F.lit("detailed").alias("source_quality"),
    ).orderBy(F.desc("tokens"), "name", "project_id")


def approximate_projects(threads: DataFrame, as_of: str | None = None, tz: str = "UTC",
                         k: int | None = APPROXIMATE_PROJECTS) -> DataFrame:
    """Projects from thread totals, all time or (with ``as_of``) the last seven days; top ``k``."""
    rows = threads.where("tokens_used > 0")
    if as_of is not None:
        rows = rows.where(F.col("updated_at") >= _week_start(as_of, tz))
    active = F.coalesce("recency_at", "updated_at")
    grouped = rows.groupBy(F.coalesce("cwd", F.lit("")).alias("full_path")).agg(
        F.sum("tokens_used").alias("tokens"), F.count("*").alias("thread_count"), F.max(active).alias("last_active_at")
    )
    ranked = grouped.where("tokens > 0").select(
        F.when(F.col("full_path") == "", nm.UNCATEGORIZED).otherwise(F.col("full_path")).alias("project_id"),
        nm.project_name("full_path").alias("name"), "full_path", "tokens",
        F.lit(None).cast(MONEY).alias("cost_usd"), "thread_count", "last_active_at",
        F.lit("approximate").alias("source_quality"),
    ).orderBy(F.desc("tokens"), "name", "project_id")
    return ranked.limit(k) if k else ranked


def transcript_projects(ledger: DataFrame) -> DataFrame:
    """All-time projects of the transcript runtime; cost null when zero."""
    path = F.when(F.coalesce("project_path", F.lit("")) == "", TRANSCRIPT_PROJECT).otherwise(F.col("project_path"))
    grouped = ledger.groupBy(path.alias("project_id")).agg(
        *tok.sum_tokens(), tok.sum_cost(), F.count_distinct("thread_id").alias("thread_count"),
        F.max("ts").alias("last_active_at"),
    ).withColumn("tokens", tok.visible_total())
    return grouped.select(
        "project_id", nm.last_component("project_id").alias("name"), F.col("project_id").alias("full_path"), "tokens",
        F.when(F.col("cost_usd") > 0, F.col("cost_usd")).alias("cost_usd"),
        F.greatest("thread_count", F.lit(1)).alias("thread_count"), "last_active_at",
        F.lit("detailed").alias("source_quality"),
    ).orderBy(F.desc("tokens"), F.desc_nulls_last("last_active_at"), "project_id")


def merge_projects(projects: DataFrame) -> DataFrame:
    """Project rows of all runtimes by id: worst quality, sums, latest time."""
    return projects.groupBy("project_id").agg(
        F.min("name").alias("name"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.greatest(F.sum("thread_count"), F.lit(1)).alias("thread_count"), F.max("last_active_at").alias("last_active_at"),
        F.when(F.bool_or(F.col("source_quality") == "approximate"), "approximate").otherwise("detailed").alias("source_quality"),
    ).orderBy(F.desc("tokens"), F.desc_nulls_last("last_active_at"), "project_id")


def new_projects(recent: DataFrame, everything: DataFrame) -> DataFrame:
    """Recent projects that hold no more threads over all time: counted as new."""
    older = everything.select("project_id", F.col("thread_count").alias("all_threads"))
    return recent.join(older, "project_id").where("all_threads <= thread_count")


def project_overview(recent: DataFrame, everything: DataFrame) -> DataFrame:
    """Active and new projects, token share of the largest and the three largest: one row."""
    top = recent.orderBy(F.desc("tokens"), "name", "project_id")
    whole = recent.agg(F.count("*").alias("active_projects"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    one = top.limit(1).agg(F.sum("tokens")).scalar()
    three = top.limit(3).agg(F.sum("tokens")).scalar()
    new = new_projects(recent, everything).agg(F.count("*")).scalar()

    def share(part: Column) -> Column:
        return F.when((F.col("total_tokens") > 0) & (part > 0), F.round(part / F.col("total_tokens") * 100, 6))

    return whole.select(
        "active_projects", new.alias("new_projects"), "total_tokens",
        share(one).alias("top_one_share"), share(three).alias("top_three_share"),
    )


def recently_active(projects: DataFrame, k: int = 5) -> DataFrame:
    return projects.orderBy(F.desc_nulls_last("last_active_at"), F.desc("tokens"), "project_id").limit(k)


def bar_ratios(top: DataFrame, value: str = "tokens") -> DataFrame:
    """Value over the largest value of an already limited list, 0..1."""
    largest = F.coalesce(top.agg(F.max(value)).scalar(), F.lit(1))
    return top.withColumn("ratio", F.round(bar_ratio(value, largest), 6))


# ---------------------------------------------------------------------- tools


def tools_by_share(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every session's usage spread over its tools in proportion to their calls.

    Tokens are rounded per session and tool before the sum.
    """
    per_tool = calls.where("tool_name <> ''").groupBy("thread_id", "tool_name").agg(F.count("*").alias("calls"))
    # Totals come from the call rows by a combinable sum, not from a window over a session.
    per_session = per_tool.groupBy("thread_id").agg(F.sum("calls").alias("all_calls"))
    usage = ledger.groupBy("thread_id").agg(*tok.sum_tokens(), tok.sum_cost()).select(
        "thread_id", tok.visible_total().alias("session_tokens"), "cost_usd"
    )
    joined = per_tool.join(per_session, "thread_id").join(usage, "thread_id", "left")
    share = F.col("calls").cast("double") / F.col("all_calls")
    used = F.col("session_tokens") > 0
    # The share of the cost is calls * cost / all_calls.  Whole nano dollars are divided by all calls first, so that neither
    # the product nor the quotient of the rest leaves 38 digits, whatever the number of calls.
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    nano = joined.withColumn("nano", (F.col("cost_usd") * 1_000_000_000).cast("bigint"))
    joined = nano.withColumns({"each": F.expr("nano div all_calls"), "rest": F.expr("nano % all_calls")})
    cost = whole("each") * whole("calls") + whole("rest") * whole("calls") / whole("all_calls")
    spread = joined.select(
        "tool_name", "calls",
        F.when(used, F.round(F.col("session_tokens") * share).cast("bigint")).otherwise(0).alias("tokens"),
        F.when(used, cost.cast("decimal(32,6)")).otherwise(F.lit(0).cast("decimal(32,6)")).alias("nano"),
    )
    return spread.groupBy("tool_name").agg(
        F.sum("calls").alias("call_count"), F.sum("tokens").alias("_t"), (F.sum("nano") / F.lit(1_000_000_000).cast("decimal(10,0)")).alias("_c")
    ).select(
        "tool_name", nm.tool_category("tool_name", "log").alias("category"), "call_count",
        F.when(F.col("_t") > 0, F.col("_t")).alias("estimated_tokens"),
        F.when(F.col("_c") > 0, tok.usd("_c")).alias("estimated_cost_usd"),
    ).orderBy(F.desc("call_count"), "tool_name")


def tools_uniform(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lifetime usage divided by all calls, times the calls of a tool."""
    per_tool = calls.where("tool_name <> ''").groupBy("tool_name").agg(F.count("*").alias("call_count"))
    lifetime = ledger.agg(*tok.sum_tokens(), tok.sum_cost()).select(
        F.struct(tok.visible_total().alias("tokens"), F.col("cost_usd").cast("double").alias("cost"))
    ).scalar()
    tokens, cost = lifetime["tokens"], lifetime["cost"]
    calls_all = F.greatest(per_tool.agg(F.sum("call_count")).scalar(), F.lit(1))
    sized = per_tool.withColumns({"_tokens": tokens, "_cost": cost / calls_all, "_calls": calls_all}).withColumn(
        "_each", F.expr("_tokens div _calls")
    )
    return sized.select(
        "tool_name", nm.tool_category("tool_name", "transcript").alias("category"), "call_count",
        F.when(F.col("_each") > 0, F.col("_each") * F.col("call_count")).alias("estimated_tokens"),
        F.when(F.col("_cost") > 0, F.round(F.col("_cost") * F.col("call_count"), 6)).alias("estimated_cost_usd"),
    ).orderBy(F.desc("call_count"), "tool_name")


def merge_tools(tools: DataFrame) -> DataFrame:
    """Tool rows of all runtimes by name; sums ignore nulls, all-null stays null.

    ``runtime`` orders the runtimes: the category of the first one is kept.
    """
    return tools.groupBy("tool_name").agg(
        F.min_by("category", "runtime").alias("category"), F.sum("call_count").alias("call_count"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
        F.round(F.sum(F.col("estimated_cost_usd").cast("decimal(28,6)")).cast("double"), 6).alias("estimated_cost_usd"),
    ).orderBy(F.desc("call_count"), "tool_name")


# -------------------------------------------------------- cross-runtime merge


def merge_windows(rollups: DataFrame) -> DataFrame:
    """Window roll-ups of several runtimes summed: the visible total is that of the summed vector."""
    return rollups.groupBy("usage_window").agg(
        F.sum("parsed_files").alias("parsed_files"), F.sum("token_events").alias("token_events"),
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_usd").alias("cost_usd"),
    ).withColumn("visible_tokens", tok.visible_total())


def merge_days(days: DataFrame) -> DataFrame:
    return days.groupBy("day").agg(F.sum("tokens").alias("tokens"))


# -------------------------------------------------------------------- latency


def operation_latency(spans: DataFrame, samples: int = LATENCY_SAMPLES) -> DataFrame:
    """Count and failures of all spans; nearest-rank p50, p95 and maximum of the latest samples.

    The rank filter is applied before the shuffle too (window group limit), so one
    busy operation sends at most ``samples`` rows per input partition.
    """
    counts = spans.groupBy("operation").agg(
        F.count("*").alias("span_count"), F.count_if(~F.col("success")).alias("failures")
    )
    from pyspark.sql import Window

    newest = Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("span_id"))
    latest = spans.select("operation", "elapsed_ms", "ts", "span_id").withColumn("_n", F.row_number().over(newest)).where(f"_n <= {samples}")
    levels = latest.groupBy("operation").agg(
        F.expr("percentile_disc(0.5) within group (order by elapsed_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) within group (order by elapsed_ms)").alias("p95_ms"),
        F.max("elapsed_ms").alias("max_ms"),
    )
    return counts.join(levels, "operation")
