"""Live thread state from notifications, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.board import is_realtime

TURN_STATES = {"completed": "completed", "interrupted": "interrupted", "failed": "failed", "inProgress": "running"}
DISCONNECT = "connection/lost"
CONNECT = "connection/opened"
LIST = "thread/list"


def runtime_state(status: Column, flag: Column) -> Column:
    """State of a thread from its status type and flags."""
    return (
        F.when((status == "active") & flag.eqNullSafe("waitingOnUserInput"), "waitingInput").when(status == "active", "running")
        .when(status == "idle", "idle").when(status == "systemError", "failed").otherwise("recorded")
    )


def event_state(method: Column, status: Column, flag: Column) -> Column:
    """State an event sets; null when the event changes nothing."""
    turn = None
    for word, state in TURN_STATES.items():
        turn = F.when(status == word, state) if turn is None else turn.when(status == word, state)
    return (
        F.when(method == "turn/started", "running")
        .when(method == "turn/completed", turn.otherwise("recorded"))
        .when(method.isin("thread/status/changed", LIST), runtime_state(status, flag))
        .when((method == "item/completed") & (status == "failed"), "failed")
    )


#: Columns that survive events which do not carry them, each with the number of its event.
CARRIED = {"name": "name_seq", "turn_id": "turn_seq", "updated_at": "updated_seq"}


def fold_events(events: DataFrame) -> DataFrame:
    """Latest state, name, turn and time per thread.

    A combinable aggregation: it runs unchanged on a batch and as a streaming query
    in update or complete mode.  Every column takes the value of the highest
    event_seq that has one, so neither order nor repetition of events matters.
    """
    state = event_state(F.col("method"), F.col("status"), F.col("flag"))
    effective = events.withColumnRenamed("ts", "updated_at").withColumn("state", state).where("state is not null")
    carried = []
    for column, number in CARRIED.items():
        seq = F.when(F.col(column).isNotNull(), F.col("event_seq"))
        carried += [F.max_by(column, seq).alias(column), F.max(seq).alias(number)]
    return effective.groupBy("thread_id").agg(
        F.max_by("state", "event_seq").alias("state"), F.max("event_seq").alias("event_seq"), *carried
    )


def downgrade(states: DataFrame, connected: bool) -> DataFrame:
    """Without a connection running work is disconnected and nothing is real time."""
    state = F.col("state")
    seen = state if connected else F.when(state.isin("running", "waitingInput"), "disconnected").otherwise(state)
    out = states.withColumn("state", seen)
    return out.withColumn("is_realtime", is_realtime(F.col("state"), F.lit(connected)))
