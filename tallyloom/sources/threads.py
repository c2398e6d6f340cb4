"""The thread table, file pruning and the union of runtimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.times import as_instant, day_start, local_day

PRUNE_DAYS = 34


def read_threads(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Thread rows from Parquet or JDBC; filters put on the result reach the source."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def with_logs(threads: DataFrame) -> DataFrame:
    """Threads with a log and usage; of several with one log the least recently updated."""
    usable = threads.where("log_path <> '' and tokens_used > 0")
    columns = threads.columns
    return usable.groupBy("log_path").agg(
        F.min_by(F.struct(*columns), F.struct("updated_at", "thread_id")).alias("row")
    ).select("row.*")


def updated_since(threads: DataFrame, as_of: str, tz: str = "UTC", days: int = PRUNE_DAYS) -> DataFrame:
    """Rows no older than ``days`` civil days before the day of the clock."""
    today = local_day(as_instant(as_of), tz)
    return threads.where(F.col("updated_at") >= day_start(F.date_sub(today, days), tz))


def prune_after(spark: SparkSession, as_of: str, tz: str = "UTC", days: int = PRUNE_DAYS) -> str:
    """The same bound as text for the ``modifiedAfter`` read option."""
    today = local_day(as_instant(as_of), tz)
    bound = spark.range(1).select(F.date_format(day_start(F.date_sub(today, days), tz), "yyyy-MM-dd'T'HH:mm:ss"))
    return bound.first()[0]


def union_runtimes(frames: list[DataFrame], allow: list[str] | None = None) -> DataFrame:
    """All runtimes in one table; an allow-list keeps the named ones."""
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return everything.where(F.col("runtime").isin(*allow)) if allow else everything
