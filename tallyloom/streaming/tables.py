"""Tables that streaming queries keep current through ``foreachBatch``.

A batch only writes its own small partial result, under its batch number; levels of partial
results are merged as they fill up (``levels``).  A batch that is run again overwrites its own
files, so retries change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import tokens as tok
from tallyloom.functions.times import local_day
from tallyloom.operators import usage
from tallyloom.streaming.levels import FAN, LevelledTable

DAY_PARTIAL = (
    "zone string, day date, from_batch bigint, is_base boolean, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, "
    "reasoning_output_tokens bigint, total_tokens bigint, cost_usd decimal(38,9)"
)


def combine_days(partials: DataFrame) -> DataFrame:
    """Per zone and day, the last rebuilt sums and what batches since then added."""
    last = F.max(F.when(F.col("is_base"), F.col("from_batch"))).over(Window.partitionBy("zone", "day"))
    valid = partials.withColumn("last_base", last).where("last_base is null or from_batch >= last_base")
    return valid.groupBy("zone", "day").agg(
        F.coalesce(F.max("last_base"), F.min("from_batch")).alias("from_batch"), F.max("last_base").isNotNull().alias("is_base"), *tok.sum_tokens(), tok.sum_cost().cast("decimal(38,9)").alias("cost_usd"))


class DailyMart:
    """Daily usage in one zone: sums that batches add, and sums of days that were counted anew.

    A day's rows are ordered by batch number.  A *base* row holds all of its day up to and including its batch and hides
    earlier rows, so a correction or another zone costs the touched days only, not the mart.
    """

    def __init__(self, spark: SparkSession, path: str, tz: str = "UTC", fan: int = FAN) -> None:
        self.tz = tz
        self.table = LevelledTable(spark, path, DAY_PARTIAL, lambda rows: combine_days(rows.where(F.col("zone") == self.tz)), fan)

    def _partial(self, days: DataFrame, batch: int, is_base: bool) -> DataFrame:
        return days.withColumns({"zone": F.lit(self.tz), "from_batch": F.lit(batch).cast("bigint"), "is_base": F.lit(is_base)})

    def append(self, batch: int, events: DataFrame) -> None:
        """Add a batch's daily sums."""
        self.table.append(batch, self._partial(usage.daily(events, self.tz), batch, False))

    def rebuild(self, batch: int, ledger: DataFrame, touched: DataFrame) -> None:
        """Count the days of the touched events anew, from the ledger as of this batch."""
        self.table.append(batch, self._partial(rebuild_days(ledger, touched, self.tz), batch, True))

    def rezone(self, batch: int, ledger: DataFrame, tz: str) -> None:
        """Another zone moves every day's bounds: all days so far are rebuilt, rows of the old zone go with the next merge."""
        self.tz = tz
        self.rebuild(batch, ledger, ledger)

    def keep(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        return lambda batch, number: self.append(number, batch)

    def current(self) -> DataFrame:
        return self.table.current().drop("zone", "from_batch", "is_base").withColumn("tokens", tok.visible_total())


def rebuild_days(ledger: DataFrame, touched: DataFrame, tz: str = "UTC") -> DataFrame:
    """Daily usage of the touched days only, from the whole ledger (day is the partition)."""
    days = touched.select(local_day("ts", tz).alias("day")).distinct()
    return usage.daily(ledger, tz).join(days, "day", "left_semi")


def discover_files(spark: SparkSession, path: str, schema: str = "value string") -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers what was seen."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"), "value",
    )
