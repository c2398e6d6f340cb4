"""The nested snapshot document and columnar marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.times import as_instant, iso_millis

SCHEMA_VERSION = 2
LIST_LIMITS = {"tools": 20, "skills": 20, "projects": 8}


def capped_list(ranked: DataFrame, k: int, fields: dict[str, Column], *order: Column) -> Column:
    """The first ``k`` rows as an array of structs; ``k`` is a small constant."""
    rows = ranked.orderBy(*order).limit(k).select(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("r"), *[
        c.alias(f"_o{i}") for i, c in enumerate([F.monotonically_increasing_id()])
    ])
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o0", "r"))), lambda s: s["r"])).scalar()


def windows_map(rollup: DataFrame) -> Column:
    """The four roll-up windows as one map of nested objects; evaluated once."""
    tokens = F.struct(
        F.col("input_tokens").alias("inputTokens"), F.col("cached_input_tokens").alias("cachedInputTokens"),
        (F.col("input_tokens") - F.least(F.greatest("cached_input_tokens", F.lit(0)), F.greatest("input_tokens", F.lit(0)))).alias("uncachedInputTokens"),
        F.col("output_tokens").alias("outputTokens"), F.col("reasoning_output_tokens").alias("reasoningOutputTokens"),
        F.col("total_tokens").alias("totalTokens"), F.col("visible_tokens").alias("visibleTotalTokens"),
    )
    value = F.struct(tokens.alias("tokens"), F.round("cost_usd", 6).cast("double").alias("estimatedCostUSD"),
                     F.col("parsed_files"), F.col("token_events"))
    return rollup.agg(F.map_from_entries(F.collect_list(F.struct(F.col("usage_window"), value)))).scalar()


def trend_part(trend: DataFrame | None) -> Column:
    if trend is None:
        return F.lit(None).cast("string")
    return trend.select(F.struct(
        F.col("week_tokens").alias("sevenDayTokens"), F.round("week_cost", 6).cast("double").alias("sevenDayCostUSD"),
        F.col("daily_average").alias("dailyAverageTokens"), F.col("change_percent").alias("changePercent"),
        F.col("is_new").alias("isNewActivity"), F.col("active_days").alias("activeDayCount"),
        F.struct(F.date_format("peak_day", "yyyy-MM-dd").alias("day"), F.col("peak_tokens").alias("tokens")).alias("peakDay"),
    )).scalar()


def board_part(board: DataFrame | None) -> Column:
    if board is None:
        return F.lit(None).cast("string")
    return board.agg(F.struct(
        F.max("total_count").alias("totalCount"),
        F.array_sort(F.collect_list(F.struct(F.col("column_kind").alias("id"), F.col("item_count").alias("count")))).alias("columns"),
    )).scalar()


def quota_part(quota: DataFrame | None) -> Column:
    """Windows per runtime, at most the caller's few runtimes."""
    if quota is None:
        return F.lit(None).cast("string")

    def window(kind: str) -> Column:
        w = F.col(kind)
        return F.when(w.isNotNull(), F.struct(
            w["used_percent"].alias("usedPercent"), (F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - w["used_percent"]))).alias("remainingPercent"),
            w["window_mins"].alias("windowDurationMins"), iso_millis(w["resets_at"]).alias("resetsAt"))).alias(kind)

    rows = quota.select(F.struct("runtime", *[window(k) for k in ("fiveHour", "sevenDay", "monthly")]).alias("r"))
    return rows.agg(F.collect_list("r")).scalar()


def snapshot_document(
    rollup: DataFrame, days: DataFrame, projects: DataFrame, tools: DataFrame, skills: DataFrame,
    reports: DataFrame, as_of: str, trend: DataFrame | None = None, board: DataFrame | None = None, quota: DataFrame | None = None,
) -> DataFrame:
    """One row with the snapshot as JSON text; lists are capped, nulls are kept.

    Inputs are marts: their rows are bounded by windows, days, periods or the caps.
    ``trend`` is a trend summary, ``board`` a column summary, ``quota`` the latest
    committed snapshot per runtime; parts that are not given are null.
    """
    day_list = days.agg(
        F.array_sort(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("tokens").alias("tokens"))))
    ).scalar()
    report_list = reports.agg(
        F.array_sort(F.collect_list(F.struct("period", "score", "level", "agents", "peak")))
    ).scalar()
    spark = rollup.sparkSession
    tool_fields = {"name": F.col("tool_name"), "category": F.col("category"), "callCount": F.col("call_count"),
                   "estimatedTokens": F.col("estimated_tokens"), "estimatedCostUSD": F.col("estimated_cost_usd")}
    skill_fields = {"name": F.col("name"), "path": F.col("skill_path"), "sourceLabel": F.col("source_label"),
                    "loadCount": F.col("load_count"), "threadCount": F.col("thread_count"),
                    "staticTokenEstimate": F.col("token_estimate"), "staticByteCount": F.col("byte_count"),
                    "lastLoadedAt": iso_millis("last_loaded_at")}
    project_fields = {"name": F.col("name"), "fullPath": F.col("full_path"), "tokens": F.col("tokens"),
                      "estimatedCostUSD": F.round("cost_usd", 6).cast("double"), "threadCount": F.col("thread_count"),
                      "lastActiveAt": iso_millis("last_active_at"), "sourceQuality": F.col("source_quality")}
    windows = windows_map(rollup)
    whole = F.element_at(windows, F.lit("lifetime"))

    def window(name: str) -> Column:
        picked = F.element_at(windows, F.lit(name))
        return F.struct(picked["tokens"].alias("tokens"), picked["estimatedCostUSD"].alias("estimatedCostUSD"))

    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        iso_millis(as_instant(as_of)).alias("refreshedAt"),
        F.struct(
            *[window(w).alias(n) for w, n in
              (("today", "today"), ("seven_day", "sevenDay"), ("month", "month"), ("lifetime", "lifetime"))],
            whole["parsed_files"].alias("parsedFileCount"), whole["token_events"].alias("tokenEventCount"),
        ).alias("detailedUsage"),
        day_list.alias("dailyBuckets"),
        capped_list(projects, LIST_LIMITS["projects"], project_fields, F.desc("tokens"), F.col("name")).alias("projects"),
        capped_list(tools, LIST_LIMITS["tools"], tool_fields, F.desc("call_count"), F.col("tool_name")).alias("toolUsages"),
        capped_list(skills, LIST_LIMITS["skills"], skill_fields, F.desc("load_count"), F.desc(F.coalesce("token_estimate", F.lit(-1))), F.col("name"), F.col("skill_path")).alias("skillUsages"),
        report_list.alias("leadership"),
        trend_part(trend).alias("usageTrend"),
        board_part(board).alias("taskBoard"),
        quota_part(quota).alias("quotaWindows"),
    )
    return spark.range(1).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("snapshot"))


def write_snapshot(document: DataFrame, path: str) -> None:
    """One row, one small text file."""
    document.coalesce(1).write.mode("overwrite").text(path)


def write_mart(df: DataFrame, path: str, partition_by: str | None = "day", mode: str = "overwrite") -> None:
    """A mart as Parquet; rows of one partition value meet in few files, hot days in several.

    The rebalance hint lets adaptive execution split a large day and merge small ones.
    """
    if partition_by:
        df.hint("rebalance", F.col(partition_by)).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
