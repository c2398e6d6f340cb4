"""The counter normaliser with state kept between micro-batches.

A session's state is five numbers.  A batch cuts its lines into slots of line numbers, exactly like the batch operator: tasks report
how each slot maps any incoming state to an outgoing one, the reports of a session are chained from the state it
had before the batch, and every slot is then walked from its true state.  So a session with a third of the rows spreads over
tasks, no task holds a session, and what is kept does not grow with the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import counters
from tallyloom.operators.counters import FIELDS
from tallyloom.operators.ordered import LINES_PER_SLOT
from tallyloom.session import materialise
from tallyloom.streaming.levels import FAN, LevelledTable

OUTPUT = "thread_id string, line_no bigint, ts timestamp, " + ", ".join(f"{n} bigint" for n in FIELDS)
STATE = "thread_id string, batch bigint, state array<bigint>"


def latest(rows: DataFrame) -> DataFrame:
    """The state of the last batch that saw the session."""
    return rows.groupBy("thread_id").agg(F.max("batch").alias("batch"), F.max_by("state", "batch").alias("state"))


class CounterStream:
    """Deltas of a growing counter log under ``path``, with the states from which it goes on.

    Lines of a session must arrive in line order over batches; within a batch they may have any order.  A batch that is
    tried again starts from the states before it and overwrites its own deltas.
    """

    def __init__(self, spark: SparkSession, path: str, lines_per_slot: int = LINES_PER_SLOT, fan: int = FAN) -> None:
        self.spark, self.path, self.lines_per_slot = spark, path.rstrip("/"), lines_per_slot
        self.states = LevelledTable(spark, f"{self.path}/states", STATE, latest, fan)

    def keep(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function over counter lines (columns as in ``counters.normalise``)."""
        def run(batch: DataFrame, number: int) -> None:
            counted = counters.with_slots(batch, self.lines_per_slot).select("thread_id", "line_no", "ts", "cum", "last", "_slot")
            touched = counted.select("thread_id").distinct()
            before = self.states.before(number).join(touched, "thread_id", "left_semi").select("thread_id", F.col("state").alias("_before"))
            slots = materialise(counters.slot_states(counted, before))
            ready = counted.join(slots.where("_slot is not null"), ["thread_id", "_slot"], "left")
            deltas = counters.walked(ready).select("thread_id", "line_no", "ts", *FIELDS)
            deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={number}")
            left = slots.where("_slot is null and _incoming is not null").select("thread_id", F.lit(number).cast("bigint").alias("batch"), F.col("_incoming").alias("state"))
            self.states.append(number, left)

        return run

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.path}/deltas")
