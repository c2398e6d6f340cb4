"""Cumulative token counters to per-event deltas.

A session log repeats running totals; a delta is the growth above the highest
value seen since the last restart, or the event's own usage when it is given.
The restart test compares a line with the state left by all earlier lines, which
no window can express, so a linear Python step walks sorted Arrow batches.  The rows
of a (thread, slot of line numbers) arrive together and in line order, because a row
number over that window is computed directly below the step: the window obliges the
planner to keep rows clustered and sorted also when it re-plans at run time, which a
bare ``repartition`` does not.  The step keeps five numbers of state and never holds
a session in memory.

Sessions longer than one slot are joined up exactly in three stages: every slot
reports how it maps *any* incoming state to an outgoing one (``slot_effects``; a
handful of thresholds, because only the two counters of the restart test matter),
the effects of a session are chained in slot order (``incoming_states``), and each
slot is then normalised from its true incoming state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import LINES_PER_SLOT, line_slot
from tallyloom.schemas import TOKEN_COLUMNS

FIELDS = TOKEN_COLUMNS
INPUT, TOTAL = 0, 4
ZERO = (0, 0, 0, 0, 0)

# Executors need not have this package installed: its step functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ----------------------------------------------------------- the step function


def is_usable(sample) -> bool:
    """A vector that is present and has no negative field."""
    return sample is not None and not any(v is not None and v < 0 for v in sample)


def filled(sample, state=ZERO):
    """Missing fields take the value of the state."""
    return tuple(max(old if new is None else new, 0) for new, old in zip(sample, state))


def restarts(sample, state) -> bool:
    """Total and input both fell below the state: the counters began again."""
    total, inputs = sample[TOTAL], sample[INPUT]
    return total is not None and inputs is not None and total < state[TOTAL] and inputs < state[INPUT]


def advance(state, sample):
    """State after a usable cumulative sample; no state yet counts as zeros."""
    if state is None or restarts(sample, state):
        return filled(sample)
    return tuple(map(max, state, filled(sample, state)))


def step(state, sample, own):
    """One log line: (state after, delta or None)."""
    event = filled(own) if is_usable(own) and any(own) else None
    if not is_usable(sample):
        return state, event
    after = advance(state, sample)
    if state is None or restarts(sample, state):
        growth, counted = after, True
    else:
        growth = tuple(new - old for new, old in zip(after, state))
        counted = any(growth)
    if not counted:
        return after, None
    delta = event or growth
    return after, (delta if any(delta) else None)


class SlotEffect:
    """How a slot maps an unknown incoming state to its outgoing state.

    ``entries`` lists, in line order, thresholds (total, input): an incoming state
    above both restarts at that line and leaves in the entry's state.  A state
    above none of them leaves as the field-wise maximum with ``peak``.
    """

    def __init__(self) -> None:
        self.entries: list[list] = []  # [total threshold, input threshold, index of a live state]
        self.live: list = []  # states after a restart inside the slot
        self.peak = ZERO
        self.open = True  # can a restart still be the first one?
        self.seen = False

    def add(self, sample) -> None:
        if not is_usable(sample):
            return
        self.seen = True
        hit = [restarts(sample, state) for state in self.live]
        fresh = self._first_restart(sample)
        if any(hit) or fresh is not None:
            self._merge(sample, hit, fresh)
        else:
            self.live = [advance(state, sample) for state in self.live]
        if self.open:
            self.peak = tuple(map(max, self.peak, filled(sample, self.peak)))
        if len(self.live) > 1:
            self._collapse()

    def _first_restart(self, sample):
        """Thresholds of a first restart at this line, unless an earlier line covers them."""
        total, inputs = sample[TOTAL], sample[INPUT]
        if not self.open or total is None or inputs is None:
            return None
        bound = (
            -1 if total < self.peak[TOTAL] else total,
            -1 if inputs < self.peak[INPUT] else inputs,
        )
        if any(t <= bound[0] and i <= bound[1] for t, i, _ in self.entries):
            return None
        return bound

    def _merge(self, sample, hit, fresh) -> None:
        states, moved = [], {}
        for index, state in enumerate(self.live):
            if not hit[index]:
                moved[index] = len(states)
                states.append(advance(state, sample))
        restart_at = len(states)
        states.append(filled(sample))
        for entry in self.entries:
            entry[2] = moved.get(entry[2], restart_at)
        if fresh is not None:
            self.entries.append([fresh[0], fresh[1], restart_at])
            if fresh == (-1, -1):
                self.open = False
        self.live = states

    def _collapse(self) -> None:
        """States that became equal stay equal: keep one of each."""
        first: dict = {}
        target = [first.setdefault(state, len(first)) for state in self.live]
        if len(first) < len(self.live):
            self.live = list(first)
            for entry in self.entries:
                entry[2] = target[entry[2]]

    def rows(self):
        return [(t, i, list(self.live[at])) for t, i, at in self.entries]


def apply_effect(state, entries, peak, seen):
    """Outgoing state for a known incoming one."""
    if not seen:
        return state
    known = state or ZERO
    for total, inputs, leaves in entries:
        if known[TOTAL] > total and known[INPUT] > inputs:
            return tuple(leaves)
    return tuple(map(max, known, peak))


# ------------------------------------------------------------- Spark operators


def _vectors(batch: pa.RecordBatch, name: str) -> list:
    """A struct column of five counters as tuples, None where the struct is null."""
    column = batch.column(name)
    fields = zip(*(column.field(at).to_pylist() for at in range(len(FIELDS))))
    return [None if missing else vector for missing, vector in zip(column.is_null().to_pylist(), fields)]


HELPERS = ("_slot", "_incoming", "_n")


def _in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows clustered by keys and sorted by order; ``_n`` is 1 on the first row of a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted events of slots that arrive in line order, with their deltas."""
    state = None
    for batch in batches:
        samples, owns = _vectors(batch, "cum"), _vectors(batch, "last")
        incoming = batch.column("_incoming").to_pylist()
        keep, deltas = [], []
        for at, number in enumerate(batch.column("_n").to_pylist()):
            if number == 1:
                state = tuple(incoming[at]) if incoming[at] is not None else None
            state, delta = step(state, samples[at], owns[at])
            if delta is not None:
                keep.append(at)
                deltas.append(delta)
        names = [n for n in batch.schema.names if n not in HELPERS]
        passed = batch.select(names).take(pa.array(keep, pa.int64()))
        fields = [pa.array([d[at] for d in deltas], pa.int64()) for at in range(len(FIELDS))]
        yield pa.RecordBatch.from_arrays([*passed.columns, *fields], names=[*names, *FIELDS])


_EFFECT = pa.schema(
    [
        ("thread_id", pa.string()),
        ("_slot", pa.int64()),
        ("entries", pa.list_(pa.struct(
            [("total", pa.int64()), ("input", pa.int64()), ("leaves", pa.list_(pa.int64()))]))),
        ("peak", pa.list_(pa.int64())),
        ("seen", pa.bool_()),
    ]
)
_EFFECT_DDL = (
    "thread_id string, _slot bigint, entries array<struct<total:bigint,input:bigint,leaves:array<bigint>>>, "
    "peak array<bigint>, seen boolean"
)
_INCOMING = pa.schema([("thread_id", pa.string()), ("_slot", pa.int64()), ("_incoming", pa.list_(pa.int64()))])
_INCOMING_DDL = "thread_id string, _slot bigint, _incoming array<bigint>"


def _effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = effect = None

    def finished() -> dict:
        entries = [{"total": t, "input": i, "leaves": leaves} for t, i, leaves in effect.rows()]
        return {"thread_id": key[0], "_slot": key[1], "entries": entries, "peak": list(effect.peak), "seen": effect.seen}

    for batch in batches:
        # One batch out for one batch in: short slots would cost a batch each.
        rows = []
        columns = (batch.column(name).to_pylist() for name in ("thread_id", "_slot", "_n"))
        for thread, slot, number, sample in zip(*columns, _vectors(batch, "cum")):
            if number == 1:
                if key is not None:
                    rows.append(finished())
                key, effect = (thread, slot), SlotEffect()
            effect.add(sample)
        yield pa.RecordBatch.from_pylist(rows, schema=_EFFECT)
    if key is not None:
        yield pa.RecordBatch.from_pylist([finished()], schema=_EFFECT)


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["_n"] == 1:
                state = None
            rows.append({"thread_id": row["thread_id"], "_slot": row["_slot"],
                         "_incoming": None if state is None else list(state)})
            entries = [(e["total"], e["input"], e["leaves"]) for e in row["entries"]]
            state = apply_effect(state, entries, row["peak"], row["seen"])
        yield pa.RecordBatch.from_pylist(rows, schema=_INCOMING)


def incoming_states(counted: DataFrame) -> DataFrame:
    """State in which every slot of a session of several slots begins: (thread_id, _slot, _incoming)."""
    spread = counted.groupBy("thread_id").agg(F.min("_slot").alias("_first"), F.max("_slot").alias("_end"))
    long_sessions = spread.where("_end > _first").select("thread_id")
    lines = counted.select("thread_id", "_slot", "line_no", "cum").join(long_sessions, "thread_id", "left_semi")
    effects = _in_order(lines, ["thread_id", "_slot"], "line_no").mapInArrow(_effects, _EFFECT_DDL)
    return _in_order(effects, ["thread_id"], "_slot").mapInArrow(_chain, _INCOMING_DDL)


def _chain_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_chain``, from the state before; a row without a slot ends each session with the state it leaves."""
    thread = state = None

    def left() -> dict:
        return {"thread_id": thread, "_slot": None, "_incoming": None if state is None else list(state)}

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["_n"] == 1:
                if thread is not None:
                    rows.append(left())
                thread, state = row["thread_id"], None if row["_before"] is None else tuple(row["_before"])
            rows.append({"thread_id": thread, "_slot": row["_slot"], "_incoming": None if state is None else list(state)})
            entries = [(e["total"], e["input"], e["leaves"]) for e in row["entries"]]
            state = apply_effect(state, entries, row["peak"], row["seen"])
        yield pa.RecordBatch.from_pylist(rows, schema=_INCOMING)
    if thread is not None:
        yield pa.RecordBatch.from_pylist([left()], schema=_INCOMING)


def slot_states(counted: DataFrame, before: DataFrame) -> DataFrame:
    """(thread_id, _slot, _incoming) of every slot, and with a null slot the state each session leaves behind.

    ``before`` has thread_id and _before, the state of five numbers in which a session begins; none means a new session.
    """
    effects = _in_order(counted.select("thread_id", "_slot", "line_no", "cum"), ["thread_id", "_slot"], "line_no").mapInArrow(_effects, _EFFECT_DDL)
    return _in_order(effects.join(before, "thread_id", "left"), ["thread_id"], "_slot").mapInArrow(_chain_on, _INCOMING_DDL)


def counter_events(lines: DataFrame) -> DataFrame:
    """Lines that carry at least one of the two vectors."""
    return lines.where("line_type = 'token_count' and (cum is not null or last is not null)")


def normalise(lines: DataFrame, lines_per_slot: int = LINES_PER_SLOT) -> DataFrame:
    """Counted events of a session log, with the five token columns added.

    Input columns: thread_id, line_no, line_type, cum and last (structs of five
    nullable longs in the order of ``FIELDS``); all others pass through.
    """
    counted = with_slots(lines, lines_per_slot)
    return walked(counted.join(incoming_states(counted), ["thread_id", "_slot"], "left"))


def with_slots(lines: DataFrame, lines_per_slot: int = LINES_PER_SLOT) -> DataFrame:
    """Counted lines, each with the range of line numbers it lies in."""
    return counter_events(lines).withColumn("_slot", line_slot("line_no", lines_per_slot))


def walked(ready: DataFrame) -> DataFrame:
    """Counted events of slots whose incoming state is known."""
    shape = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name not in HELPERS]
        + [f"{name} bigint" for name in FIELDS]
    )
    return _in_order(ready, ["thread_id", "_slot"], "line_no").mapInArrow(_walk, shape)
