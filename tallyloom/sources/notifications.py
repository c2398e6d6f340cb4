"""Thread notifications as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.sources.tail import appended_lines

NOTIFICATION = (
    "method string, id string, seq bigint, at timestamp, params struct<"
    "threadId:string, status:struct<type:string,activeFlags:array<string>>, "
    "turn:struct<id:string,status:string>, item:struct<status:string>, "
    "name:string, threadSource:string, source:string, updatedAt:bigint>"
)


def notification_rows(raw: DataFrame) -> DataFrame:
    """Notifications only (replies carry an id), flattened:
    (thread_id, event_seq, method, status, flag, turn_id, name, hidden, ts)."""
    p = "params"
    status = F.coalesce(f"{p}.status.type", f"{p}.turn.status", f"{p}.item.status")
    waiting = F.array_contains(F.coalesce(F.col(f"{p}.status.activeFlags"), F.array().cast("array<string>")), "waitingOnUserInput")
    source = F.col(f"{p}.source")
    keys = F.when(source.startswith("{"), F.json_object_keys(source))
    return raw.where("method is not null and id is null").select(
        F.col(f"{p}.threadId").alias("thread_id"), F.col("seq").alias("event_seq"), "method", status.alias("status"),
        F.when(waiting, "waitingOnUserInput").alias("flag"), F.col(f"{p}.turn.id").alias("turn_id"),
        nm.blank_to_null(f"{p}.name").alias("name"),
        nm.is_subagent(F.coalesce(F.col(f"{p}.threadSource"), F.lit("")), source, keys).alias("hidden"),
        F.coalesce("at", F.timestamp_seconds(F.col(f"{p}.updatedAt"))).alias("ts"),
    )


def stream_notifications(spark: SparkSession, path: str, growing: bool = False, max_files: int | None = None) -> DataFrame:
    """Notifications of a folder as a stream: whole new files, or with ``growing`` the lines appended to any file."""
    if growing:
        lines = appended_lines(spark, path)
        return notification_rows(lines.select(F.from_json("value", NOTIFICATION).alias("n")).select("n.*"))
    reader = spark.readStream.schema(NOTIFICATION)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return notification_rows(reader.json(path))
