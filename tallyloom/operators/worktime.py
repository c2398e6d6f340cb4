"""Work intervals and workers from turn events, duration marks and lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.times import as_instant
from tallyloom.operators import ordered


def pair_turns(events: DataFrame, as_of: str | Column, slot: Column, order: list[str]) -> DataFrame:
    """Turn starts and completions to intervals.

    Input: thread_id, turn_id, mark (started / completed), at, duration_ms, the
    thread's created_at, worker_kind, automation_id and the order columns.  A
    completion takes the last start of its turn before it, else its own duration;
    it counts when it is not older than the thread, not in the future, not empty.
    """
    now = as_instant(as_of)
    turns = events.where("turn_id is not null and mark in ('started', 'completed')")
    paired = ordered.running(
        turns, ["thread_id", "turn_id"], order, slot,
        begun=ordered.last(F.when(F.col("mark") == "started", F.col("at"))),
    ).where("mark = 'completed'")
    from_duration = F.timestamp_micros(F.unix_micros("at") - F.round(F.col("duration_ms") * 1000).cast("bigint"))
    return (
        paired.withColumn("start_at", F.coalesce("begun", from_duration))
        .withColumn("end_at", F.col("at"))
        .where(
            (F.col("start_at") >= F.col("created_at") - F.expr("interval 2 seconds"))
            & (F.col("end_at") <= now + F.expr("interval 5 seconds"))
            & (F.col("end_at") > F.col("start_at"))
        )
        .withColumn(
            "quality",
            F.when((F.col("worker_kind") == "automation") & F.col("automation_id").isNull(), "derived").otherwise("fact"),
        )
        .withColumn("is_autonomous", F.col("worker_kind") != "main")
        .withColumn("interval_id", F.concat_ws(":", "thread_id", "turn_id"))
        .drop("begun")
    )


def duration_marks(lines: DataFrame) -> DataFrame:
    """A line with a duration ends an interval of that length; main workers only."""
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    return (
        lines.where("worker_kind = 'main' and duration_ms is not null")
        .withColumn("start_at", F.timestamp_micros(F.unix_micros("ts") - micros))
        .withColumn("end_at", F.col("ts"))
        .where("end_at > start_at")
        .withColumn("interval_id", F.concat_ws(":", "file_id", F.unix_micros("ts")))
        .withColumn("quality", F.lit("fact"))
        .withColumn("is_autonomous", F.lit(False))
    )


def lifetimes(lines: DataFrame) -> DataFrame:
    """First to last time of a subagent's file, if at least one second apart."""
    spans = lines.where("ts is not null").groupBy("file_path").agg(
        F.min("ts").alias("start_at"), F.max("ts").alias("end_at")
    )
    return spans.where(F.col("end_at") >= F.col("start_at") + F.expr("interval 1 second")).select(
        F.concat_ws(":", "file_path", F.lit("lifecycle")).alias("interval_id"), "file_path", "start_at", "end_at",
        F.lit("derived").alias("quality"), F.lit(True).alias("is_autonomous"),
    )


def first_intervals(intervals: DataFrame, order: str = "load_order") -> DataFrame:
    """One interval per id: the first read."""
    columns = [c for c in intervals.columns if c != order]
    return intervals.groupBy("interval_id").agg(
        F.min_by(F.struct(*columns), F.col(order)).alias("row")
    ).select("row.*")


def distinct_workers(workers: DataFrame, order: str = "load_order") -> DataFrame:
    """One worker per id: the first that names a parent, else the last read."""
    columns = [c for c in workers.columns if c != order]
    whole = F.struct(*columns)
    with_parent = F.min_by(whole, F.when(F.col("parent_id").isNotNull(), F.col(order)))
    return workers.groupBy("worker_id").agg(
        F.coalesce(with_parent, F.max_by(whole, F.col(order))).alias("row")
    ).select("row.*")


def attach_parents(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Threads with the parent that spawned them, if any."""
    return threads.join(
        edges.select(F.col("child_thread_id").alias("thread_id"), F.col("parent_thread_id").alias("parent_id")),
        "thread_id", "left",
    )
