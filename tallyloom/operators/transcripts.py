"""Per-message usage of the transcript runtime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import is_zero, with_cost
from tallyloom.operators import ordered
from tallyloom.schemas import TOKEN_COLUMNS


def carry_attributes(lines: DataFrame, lines_per_slot: int = ordered.LINES_PER_SLOT) -> DataFrame:
    """Model and project keep the last value seen in the file; the project starts
    from the directory's name (``seed_project``)."""
    carried = ordered.running(
        lines, ["file_path"], ["line_no"], ordered.line_slot("line_no", lines_per_slot),
        carried_model=ordered.last(F.when(F.col("model") != "", F.col("model"))),
        carried_cwd=ordered.last(F.when(F.col("cwd") != "", F.col("cwd"))),
    )
    return (
        carried.withColumn("model", F.col("carried_model"))
        .withColumn("project_path", F.coalesce("carried_cwd", "seed_project"))
        .drop("carried_model", "carried_cwd")
    )


def usage_vector(lines: DataFrame) -> DataFrame:
    """Token columns from the usage fields input, cache_create, cache_read, output,
    reasoning and total; rows without any token are dropped."""
    value = {n: F.coalesce(n, F.lit(0)) for n in ("input", "cache_create", "cache_read", "output", "reasoning")}
    everything = sum(value.values(), F.lit(0).cast("bigint"))
    return lines.withColumns(
        {
            "input_tokens": value["input"] + value["cache_create"] + value["cache_read"],
            "cached_input_tokens": value["cache_create"] + value["cache_read"],
            "output_tokens": value["output"],
            "reasoning_output_tokens": value["reasoning"],
            "total_tokens": F.coalesce("total", everything),
        }
    ).where(~is_zero())


def first_per_message(rows: DataFrame) -> DataFrame:
    """One usage row per message id: the first by file and line; rows without an id stay.

    A combinable aggregation keeps the first row, so a message id repeated a billion
    times is reduced before the shuffle and rows without an id never share a task.
    """
    columns = rows.columns
    named = rows.where("message_id is not null")
    kept = named.groupBy("message_id").agg(
        F.min_by(F.struct(*columns), F.struct("file_path", "line_no")).alias("row")
    ).select("row.*")
    return kept.unionByName(rows.where("message_id is null"))


def ledger(lines: DataFrame) -> DataFrame:
    """Transcript lines to priced usage events."""
    rows = first_per_message(usage_vector(carry_attributes(lines)))
    return with_cost(rows, "model", "transcript").select(
        F.lit("transcript").alias("runtime"),
        F.col("session_id").alias("thread_id"),
        F.col("line_no").alias("seq"),
        "project_path", "model", "ts", *TOKEN_COLUMNS, "cost_usd",
        F.lit("detailed").alias("source_quality"), "file_path", "message_id",
    )
