"""Live threads from one stream of notifications, full lists and connection rows.

A full list replaces all records, so every row belongs to a *generation*: the number of lists begun up to it.  A thread's
record survives a new generation only if that list names it; what it carries (name, turn, time) survives with it.  A lost
connection leaves the records but none of them is real time until a list that began later.  None of this touches all threads
when such a row arrives: a thread keeps the numbers of its own last rows, and they are compared with the last list and the
last loss when the table is read.

Batches must arrive in event order, as one connection delivers them; within a batch rows may have any order, and a batch
that is tried again changes nothing.  A list is one snapshot whose rows may come in many lines: ``thread/list/started``
opens it, the ``thread/list`` rows up to the next start belong to it and count as present from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ordered
from tallyloom.operators.board import is_realtime
from tallyloom.streaming.levels import FAN, LevelledTable
from tallyloom.streaming.live import DISCONNECT, LIST, event_state

LIST_START = "thread/list/started"

CONTROLS = "lists bigint, list_seq bigint, lost_seq bigint"

#: Columns that survive events which do not carry them.
CARRIED = ("name", "turn_id", "updated_at")

STATE = (
    "thread_id string, state string, event_seq bigint, generation bigint, name string, name_seq bigint, name_generation bigint, "
    "turn_id string, turn_id_seq bigint, turn_id_generation bigint, updated_at timestamp, updated_at_seq bigint, "
    "updated_at_generation bigint, listed_from bigint, listed_to bigint"
)


def controls(events: DataFrame) -> DataFrame:
    """One row: lists begun, and the numbers of the last list and the last loss."""
    seq, method = F.col("event_seq"), F.col("method")
    return events.where(method.isin(LIST_START, DISCONNECT)).agg(
        F.count_if(method == LIST_START).alias("lists"), F.max(F.when(method == LIST_START, seq)).alias("list_seq"),
        F.max(F.when(method == DISCONNECT, seq)).alias("lost_seq"))


def combine_controls(parts: DataFrame) -> DataFrame:
    return parts.agg(F.coalesce(F.sum("lists"), F.lit(0)).alias("lists"), F.max("list_seq").alias("list_seq"), F.max("lost_seq").alias("lost_seq"))


def numbered(events: DataFrame, lists_before: int) -> DataFrame:
    """Each row's generation; a list's start is the first row of its own."""
    started = (F.col("method") == LIST_START).cast("bigint")
    return ordered.running(events, [], ["event_seq"], ordered.line_slot("event_seq"), generation=ordered.total(started)).withColumn(
        "generation", F.col("generation") + lists_before)


def _latest_run(runs: Column) -> Column:
    """Of [listed_to, listed_from] ranges the last one, with all that join it end to end."""
    newest_first = F.sort_array(runs, asc=False)
    return F.aggregate(F.slice(newest_first, 2, F.greatest(F.size(newest_first), F.lit(1))), newest_first[0], lambda run, r: F.struct(
        run["to"].alias("to"), F.when(r["to"] >= run["from"] - 1, F.least(run["from"], r["from"])).otherwise(run["from"]).alias("from")))


def fold(rows: DataFrame) -> DataFrame:
    """Partial state per thread of rows with their generations; hidden list rows count for nothing."""
    state = event_state(F.col("method"), F.col("status"), F.col("flag"))
    seen = rows.where("thread_id is not null").where((F.col("method") != LIST) | ~F.coalesce(F.col("hidden"), F.lit(False)))
    seen = seen.withColumnRenamed("ts", "updated_at").withColumn("state", state).where("state is not null")
    carried = []
    for column in CARRIED:
        seq = F.when(F.col(column).isNotNull(), F.col("event_seq"))
        carried += [F.max_by(column, seq).alias(column), F.max(seq).alias(f"{column}_seq"), F.max_by("generation", seq).alias(f"{column}_generation")]
    # Lists are rare: a batch holds a handful, so the set per thread stays short.
    listed = F.collect_set(F.when(F.col("method") == LIST, F.struct(F.col("generation").alias("to"), F.col("generation").alias("from"))))
    out = seen.groupBy("thread_id").agg(
        F.max_by("state", "event_seq").alias("state"), F.max("event_seq").alias("event_seq"), F.max_by("generation", "event_seq").alias("generation"), *carried, listed.alias("runs"))
    return _with_run(out)


def _with_run(out: DataFrame) -> DataFrame:
    run = F.when(F.size("runs") > 0, _latest_run(F.col("runs")))
    return out.withColumn("run", run).withColumns({"listed_from": F.col("run.from"), "listed_to": F.col("run.to")}).drop("runs", "run")


def combine(partials: DataFrame) -> DataFrame:
    """Any number of partial states per thread to one, by the numbers they carry."""
    carried = []
    for column in CARRIED:
        seq = f"{column}_seq"
        carried += [F.max_by(column, seq).alias(column), F.max(seq).alias(seq), F.max_by(f"{column}_generation", seq).alias(f"{column}_generation")]
    runs = F.collect_list(F.when(F.col("listed_to").isNotNull(), F.struct(F.col("listed_to").alias("to"), F.col("listed_from").alias("from"))))
    return _with_run(partials.groupBy("thread_id").agg(
        F.max_by("state", "event_seq").alias("state"), F.max("event_seq").alias("event_seq"), F.max_by("generation", "event_seq").alias("generation"), *carried, runs.alias("runs")))


def seen_by(states: DataFrame, lists: int, list_seq: int | None, lost_seq: int | None) -> DataFrame:
    """Records as they stand after the last list and the last loss: thread_id, state, name, turn_id, updated_at, event_seq, is_realtime."""
    # The last generation whose list did not name the thread: whatever is older is gone.
    gone = F.when(F.col("listed_to") == lists, F.col("listed_from") - 1).otherwise(F.lit(lists))
    states = states.withColumn("gone", gone).where("generation >= gone")
    after_loss = F.lit(lost_seq is None) | (F.col("event_seq") > F.lit(lost_seq))
    state = F.when(~after_loss & F.col("state").isin("running", "waitingInput"), "disconnected").otherwise(F.col("state"))
    connected = list_seq is not None and (lost_seq is None or list_seq > lost_seq)
    carried = [F.when(F.col(f"{column}_generation") >= F.col("gone"), F.col(column)).alias(column) for column in CARRIED]
    return states.select("thread_id", state.alias("state"), *carried, "event_seq").withColumn("is_realtime", is_realtime(F.col("state"), F.lit(connected)))


class LiveThreads:
    """The state table of one connection and its list and loss numbers."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN) -> None:
        self.states = LevelledTable(spark, f"{path.rstrip('/')}/threads", STATE, combine, fan)
        self.controls = LevelledTable(spark, f"{path.rstrip('/')}/controls", CONTROLS, combine_controls, fan)

    def keep(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        def run(batch: DataFrame, number: int) -> None:
            self.controls.append(number, controls(batch))
            lists = self.controls.before(number).first()["lists"]
            self.states.append(number, fold(numbered(batch, lists)))

        return run

    def current(self) -> DataFrame:
        last = self.controls.current().first()
        return seen_by(self.states.current(), last["lists"], last["list_seq"], last["lost_seq"])
