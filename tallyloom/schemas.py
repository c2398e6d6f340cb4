"""Canonical tables: every operator reads and writes these shapes."""

from __future__ import annotations

#: The additive measure vector; five plain longs so sums stay in generated code.
TOKEN_COLUMNS = (
    "input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)

#: Exact money type.  Prices have at most three decimals per million tokens, so
#: nine decimals per token lose nothing and sums do not depend on row order.
MONEY = "decimal(38,9)"


# Schemas are DDL text: importing this module needs no running session.

USAGE_EVENT = (
    "runtime string, thread_id string, seq bigint, project_path string, model string, ts timestamp, "
    "input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, "
    "reasoning_output_tokens bigint, total_tokens bigint, cost_usd decimal(38,9), source_quality string"
)

THREAD = (
    "thread_id string, title string, preview string, cwd string, model string, tokens_used bigint, "
    "created_at timestamp, updated_at timestamp, recency_at timestamp, archived_at timestamp, "
    "archived boolean, thread_source string, log_path string, forked_from_id string"
)

TOOL_CALL = ("runtime string, thread_id string, seq bigint, tool_name string, ts timestamp")

SKILL_LOAD = (
    "runtime string, thread_id string, seq bigint, skill_name string, skill_path string, ts timestamp"
)

WORKER = ("worker_id string, worker_kind string, project_id string, project_name string, parent_id string")

WORK_INTERVAL = (
    "interval_id string, worker_id string, worker_kind string, project_id string, "
    "start_at timestamp, end_at timestamp, quality string, is_autonomous boolean"
)

QUOTA_SNAPSHOT = (
    "runtime string, captured_at timestamp, slot string, used_percent double, window_mins int, resets_at timestamp"
)

THREAD_EVENT = (
    "thread_id string, event_seq bigint, method string, status string, flag string, turn_id string, "
    "name string, ts timestamp"
)

_COUNTERS = (
    "struct<input_tokens:string,cached_input_tokens:string,output_tokens:string,"
    "reasoning_output_tokens:string,total_tokens:string>"
)

#: One session-log line.  Counters are read as text and cast leniently afterwards,
#: because writers emit numbers as well as numeric strings.
LOG_LINE = (
    "timestamp string, type string, payload struct<"
    "type:string, id:string, cwd:string, model:string, forked_from_id:string, name:string, "
    "arguments:string, input:string, cmd:string, command:string, "
    f"turn_id:string, started_at:string, completed_at:string, duration_ms:string, "
    f"info:struct<total_token_usage:{_COUNTERS}, last_token_usage:{_COUNTERS}>>"
)

#: One transcript line.
TRANSCRIPT_LINE = (
    "type string, subtype string, timestamp string, cwd string, projectPath string, sessionId string, "
    "model string, uuid string, id string, durationMs string, attributionSkill string, attribution_skill string, "
    "message struct<id:string, model:string, attributionSkill:string, attribution_skill:string, "
    "usage:struct<input_tokens:string,cache_creation_input_tokens:string,cache_read_input_tokens:string,"
    "output_tokens:string,reasoning_output_tokens:string,total_tokens:string>, "
    "content:array<struct<type:string,id:string,name:string>>>"
)
