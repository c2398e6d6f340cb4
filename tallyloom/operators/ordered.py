"""Ordered calculations per key that never put a hot key into one task.

``Window.partitionBy(key).orderBy(...)`` sorts all rows of a key in one task; one
hot key then decides the run time of the job.  ``running`` always cuts the keys into
*slots* along the order (a slice of time, a range of line numbers): each slot is
summarised with a map-side combined aggregation, the summaries are carried forward
over the short list of slots, and the calculation is finished inside each slot.
Results equal the plain window for every slot width, null keys included, and building
the plan starts no job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "_slot"

#: Lines per slot for file-ordered data.
LINES_PER_SLOT = 262_144


def minute_slot(ts: str | Column) -> Column:
    return F.date_trunc("minute", F.col(ts) if isinstance(ts, str) else ts)


def hour_slot(ts: str | Column) -> Column:
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts)


def line_slot(line: str | Column, width: int = LINES_PER_SLOT) -> Column:
    """First line number of the range of ``width`` lines that holds the line."""
    column = F.col(line) if isinstance(line, str) else line
    return column - F.pmod(column, F.lit(width).cast("bigint"))


@dataclass(frozen=True)
class Step:
    """One ordered calculation: how the slots combine and what they combine."""

    kind: str
    value: Column | None = None


def rank() -> Step:
    """1-based dense position within the key."""
    return Step("sum", F.lit(1).cast("bigint"))


def total(value: Column) -> Step:
    """Running sum including the row."""
    return Step("sum", value)


def highest(value: Column) -> Step:
    """Running maximum including the row."""
    return Step("max", value)


def highest_before(value: Column) -> Step:
    """Running maximum of the rows before this one."""
    return Step("max_before", value)


def last(value: Column) -> Step:
    """Latest non-null value, the row included."""
    return Step("last", value)


def following(value: Column) -> Step:
    """Value of the next row of the key."""
    return Step("next", value)


def running(df: DataFrame, keys: list[str], order: list[str], slot: Column, **steps: Step) -> DataFrame:
    """Add one column per step, evaluated per key in the given (total) order.

    ``slot`` must not decrease along the order.
    """
    staged = df.withColumn(SLOT, slot)
    for name, step in steps.items():
        staged = staged.withColumn(f"_v_{name}", step.value)
    carried = _carried(staged, keys, order, steps)
    same = [staged[c].eqNullSafe(carried[c]) for c in (*keys, SLOT)]
    joined = staged.join(carried, same, "left").select(staged["*"], *[carried[f"_c_{name}"] for name in steps])

    inside = Window.partitionBy(*keys, SLOT).orderBy(*order)
    results = []
    for name, step in steps.items():
        value, carry = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        here = _over(step.kind, value, inside)
        if step.kind == "sum":
            out = F.coalesce(carry, F.lit(0)) + here
        elif step.kind in ("max", "max_before"):
            out = F.greatest(carry, here)
        elif step.kind == "last":
            out = F.coalesce(here, carry)
        else:
            out = F.coalesce(F.lead(F.struct(value.alias("v"))).over(inside), carry)["v"]
        results.append(out.alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *results)


def _over(kind: str, value: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    if kind == "sum":
        return F.coalesce(F.sum(value).over(upto), F.lit(0))
    if kind == "max":
        return F.max(value).over(upto)
    if kind == "max_before":
        return F.max(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    return F.lead(value).over(window)


def _carried(staged: DataFrame, keys: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    """What each slot of a key takes over from the slots before (or after) it."""
    order_key = F.struct(*[F.col(c) for c in order])
    summaries = []
    for name, step in steps.items():
        value = F.col(f"_v_{name}")
        if step.kind == "sum":
            summary = F.sum(value)
        elif step.kind in ("max", "max_before"):
            summary = F.max(value)
        elif step.kind == "last":
            summary = F.max_by(value, F.when(value.isNotNull(), order_key))
        else:
            summary = F.min_by(F.struct(value.alias("v")), order_key)
        summaries.append(summary.alias(f"_s_{name}"))
    by_slot = staged.groupBy(*keys, SLOT).agg(*summaries)

    across = Window.partitionBy(*keys).orderBy(SLOT)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, step in steps.items():
        summary = F.col(f"_s_{name}")
        if step.kind == "sum":
            carry = F.sum(summary).over(earlier)
        elif step.kind in ("max", "max_before"):
            carry = F.max(summary).over(earlier)
        elif step.kind == "last":
            carry = F.last(summary, ignorenulls=True).over(earlier)
        else:
            carry = F.lead(summary).over(across)
        carries.append(carry.alias(f"_c_{name}"))
    return by_slot.select(*keys, SLOT, *carries)
