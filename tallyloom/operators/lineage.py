"""Model attribution and de-duplication of usage inherited by forked sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import model_name, resolve_model
from tallyloom.operators import ordered
from tallyloom.operators.counters import FIELDS


def carry_model(
    lines: DataFrame, threads: DataFrame | None = None, lines_per_slot: int = ordered.LINES_PER_SLOT
) -> DataFrame:
    """Model in force at every line: the latest turn context decides, one without a
    model clears it, and the thread's own model fills what is left.

    ``threads`` has thread_id and model.
    """
    turn = F.when(F.col("line_type") == "turn_context", F.struct(model_name("model").alias("m")))
    carried = ordered.running(
        lines, ["thread_id"], ["line_no"], ordered.line_slot("line_no", lines_per_slot), turn_model=ordered.last(turn)
    ).withColumn("turn_model", F.col("turn_model.m"))
    if threads is None:
        return carried.withColumn("model", F.col("turn_model")).drop("turn_model")
    own = threads.select("thread_id", F.col("model").alias("_thread_model"))
    return (
        carried.join(own, "thread_id", "left")
        .withColumn("model", resolve_model("turn_model", "_thread_model"))
        .drop("turn_model", "_thread_model")
    )


def fork_parents(meta_lines: DataFrame) -> DataFrame:
    """Last non-empty parent named by a session's metadata lines: (thread_id, parent_id)."""
    named = meta_lines.where("forked_from_id <> ''")
    return named.groupBy("thread_id").agg(F.max_by("forked_from_id", "line_no").alias("parent_id"))


def number_deltas(deltas: DataFrame, lines_per_slot: int = ordered.LINES_PER_SLOT) -> DataFrame:
    """1-based position ``idx`` of every counted event within its session."""
    return ordered.running(
        deltas, ["thread_id"], ["line_no"], ordered.line_slot("line_no", lines_per_slot), idx=ordered.rank()
    )


def inherited_prefix(numbered: DataFrame, parents: DataFrame) -> DataFrame:
    """Length of the prefix a child shares with its parent: (thread_id, parent_id, prefix).

    Counted events are compared by their ten raw counters, position by position.
    The join key holds the position, so neither a long session nor a parent with
    many children meets in one task; only forked sessions take part.
    """
    identity = F.struct(F.col("cum"), F.col("last"))
    children = numbered.select("thread_id", "idx", identity.alias("mine")).join(parents, "thread_id")
    wanted = parents.select(F.col("parent_id").alias("thread_id")).distinct()
    originals = numbered.join(wanted, "thread_id", "left_semi").select(
        F.col("thread_id").alias("parent_id"), "idx", identity.alias("theirs")
    )
    paired = children.join(originals, ["parent_id", "idx"], "left")
    # Sessions unknown to the ledger, and positions beyond the parent's end, break the prefix.
    broken = F.col("theirs").isNull() | ~F.col("mine").eqNullSafe(F.col("theirs"))
    return (
        paired.groupBy("thread_id", "parent_id")
        .agg(F.min(F.when(broken, F.col("idx"))).alias("_first"), F.count("*").alias("_n"))
        .select("thread_id", "parent_id", (F.coalesce(F.col("_first") - 1, F.col("_n"))).alias("prefix"))
    )


def drop_inherited(numbered: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The ledger without inherited events."""
    return (
        numbered.join(prefixes.select("thread_id", "prefix"), "thread_id", "left")
        .where("prefix is null or idx > prefix")
        .drop("prefix")
    )


def fork_baselines(numbered: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Tokens a child inherited: (thread_id, baseline), only where some were."""
    forked = prefixes.where("prefix > 0").select("thread_id", "prefix")
    return (
        numbered.join(forked, "thread_id").where("idx <= prefix")
        .groupBy("thread_id").agg(F.sum("total_tokens").alias("baseline"))
    )


def adjust_threads(threads: DataFrame, baselines: DataFrame) -> DataFrame:
    """Thread totals without inherited tokens, never below zero."""
    return (
        threads.join(baselines, "thread_id", "left")
        .withColumn(
            "tokens_used",
            F.greatest(F.col("tokens_used") - F.coalesce("baseline", F.lit(0)), F.lit(0)).cast("bigint"),
        )
        .drop("baseline")
    )


def event_counts(counter_lines: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Per session: counter events read, less the inherited ones."""
    seen = counter_lines.groupBy("thread_id").agg(F.count("*").alias("n"))
    return seen.join(prefixes.select("thread_id", "prefix"), "thread_id", "left").select(
        "thread_id", F.greatest(F.col("n") - F.coalesce("prefix", F.lit(0)), F.lit(0)).alias("token_events")
    )


__all__ = [
    "FIELDS", "adjust_threads", "carry_model", "drop_inherited", "event_counts", "fork_baselines",
    "fork_parents", "inherited_prefix", "number_deltas",
]
