"""Quota snapshots: slots, window kinds, atomic commit, carry-over and status.

A snapshot is one row with up to two slots, so everything but the history
carry-over is a row-local expression and needs no shuffle.
Columns in: runtime, snapshot_id, captured_at, primary, secondary
(structs used_percent, window_mins, resets_at), optionally has_fields and malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.measures import remaining_percent
from tallyloom.functions.times import as_instant
from tallyloom.operators import ordered

# Window lengths in minutes.
FIVE_HOURS = 300
SEVEN_DAYS = 10_080
MONTH = (40_320, 44_640)
KINDS = ("fiveHour", "sevenDay", "monthly")
STALE_SECONDS = 900
STALE_SUFFIX = " · stale"
INLINE_CREDITS = 2


def window_kind(mins: Column) -> Column:
    return (
        F.when(mins == FIVE_HOURS, KINDS[0]).when(mins == SEVEN_DAYS, KINDS[1])
        .when(mins.between(*MONTH), KINDS[2]).otherwise("unclassified")
    )


def slot_rows(snapshots: DataFrame) -> DataFrame:
    """One row per present slot, classified; a slot without a percentage is malformed."""
    slots = F.array(
        F.struct(F.lit("primary").alias("slot"), F.col("primary").alias("w")),
        F.struct(F.lit("secondary").alias("slot"), F.col("secondary").alias("w")),
    )
    rows = snapshots.select("runtime", "snapshot_id", "captured_at", F.inline(F.filter(slots, lambda s: s["w"].isNotNull())))
    return rows.select(
        "runtime", "snapshot_id", "captured_at", "slot",
        F.col("w.used_percent").alias("used_percent"), F.col("w.window_mins").alias("window_mins"),
        F.col("w.resets_at").alias("resets_at"),
        remaining_percent("w.used_percent").alias("remaining_percent"),
        window_kind(F.col("w.window_mins")).alias("kind"),
        F.col("w.used_percent").isNull().alias("malformed"),
    )


def _windows() -> Column:
    """Well-formed slots of the row with their kind."""
    both = F.array_compact(F.array("primary", "secondary"))
    return F.transform(
        F.filter(both, lambda w: w["used_percent"].isNotNull()),
        lambda w: F.struct(w["used_percent"].alias("used_percent"), w["window_mins"].alias("window_mins"),
                           w["resets_at"].alias("resets_at"), window_kind(w["window_mins"]).alias("kind")),
    )


def _of_kind(kind: str):
    # A closure: Spark would read a second lambda argument as the element's index.
    return lambda w: w["kind"] == kind


def unique_windows(snapshots: DataFrame) -> DataFrame:
    """Windows by kind, kept only when exactly one slot has the kind; match counts kept."""
    out = snapshots.withColumn("windows", _windows())
    for kind in KINDS:
        matches = F.filter("windows", _of_kind(kind))
        out = out.withColumn(f"{kind}_count", F.size(matches).cast("bigint"))
        out = out.withColumn(kind, F.when(F.size(matches) == 1, F.try_element_at(matches, F.lit(1))))
    unknown = F.filter("windows", _of_kind("unclassified"))
    return out.withColumn("unclassified", unknown).drop("windows")


def commit(unique: DataFrame) -> DataFrame:
    """``ok`` when the snapshot is fully understood; otherwise every window is null."""
    has_fields = F.col("has_fields") if "has_fields" in unique.columns else F.lit(True)
    if "malformed" in unique.columns:
        malformed = F.col("malformed")
    else:
        malformed = F.coalesce(
            (F.col("primary").isNotNull() & F.col("primary.used_percent").isNull())
            | (F.col("secondary").isNotNull() & F.col("secondary.used_percent").isNull()),
            F.lit(False),
        )
    ok = has_fields & ~malformed & (F.size("unclassified") == 0)
    for kind in KINDS:
        ok = ok & (F.col(f"{kind}_count") <= 1)
    return unique.withColumn("ok", ok).withColumns({kind: F.when(F.col("ok"), F.col(kind)) for kind in KINDS})


def diagnostics(unique: DataFrame) -> DataFrame:
    """Why a snapshot was not understood, as an array of codes in a fixed order."""
    missing = F.exists("unclassified", lambda w: w["window_mins"].isNull())
    unknown = F.array_sort(
        F.array_distinct(F.filter(F.transform("unclassified", lambda w: w["window_mins"]), lambda m: m.isNotNull()))
    )
    messages = [F.when(F.col(f"{kind}_count") > 1, f"duplicate:{kind}") for kind in KINDS]
    messages.append(F.when(missing, "missing-duration"))
    messages.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown.cast("array<string>"), ","))))
    return unique.withColumn("messages", F.array_compact(F.array(*messages)))


def understand(snapshots: DataFrame) -> DataFrame:
    return commit(unique_windows(snapshots))


# ------------------------------------------------------------------ continuity


def _any_window() -> Column:
    test = F.lit(False)
    for kind in KINDS:
        test = test | F.col(kind).isNotNull()
    return test


def carry_history(committed: DataFrame) -> DataFrame:
    """A failed read repeats the last confirmed windows of its runtime and turns stale."""
    windows = F.struct(*KINDS)
    out = ordered.running(
        committed.withColumn("_has", _any_window()), ["runtime"], ["captured_at", "snapshot_id"],
        ordered.minute_slot("captured_at"),
        confirmed=ordered.last(F.when(F.col("ok"), F.struct(windows.alias("w"), F.col("_has").alias("has")))),
    )
    carried = ~F.col("ok") & F.coalesce(F.col("confirmed.has"), F.lit(False))
    return out.withColumns(
        {
            **{kind: F.when(carried, F.col(f"confirmed.w.{kind}")).otherwise(F.col(kind)) for kind in KINDS},
            "status": F.when(F.col("ok"), "available").when(carried, "stale").otherwise("unavailable"),
        }
    ).drop("confirmed", "_has")


def reconcile(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """One previous and one incoming row per runtime: (runtime, ok, status, label, kinds...)."""
    old = previous.select("runtime", F.struct("status", "label", *KINDS).alias("old"))
    usable = (
        ~F.col("ok")
        & F.coalesce(F.col("old.status").isin("available", "stale"), F.lit(False))
        & (F.col("old.fiveHour").isNotNull() | F.col("old.sevenDay").isNotNull() | F.col("old.monthly").isNotNull())
    )
    label = F.col("old.label")
    kept = F.when(label.endswith(STALE_SUFFIX), label).otherwise(F.concat(label, F.lit(STALE_SUFFIX)))
    return incoming.join(old, "runtime", "left").withColumn("_carry", usable).withColumns(
        {
            **{kind: F.when(F.col("_carry"), F.col(f"old.{kind}")).otherwise(F.col(kind)) for kind in KINDS},
            "status": F.when(F.col("_carry"), "stale").otherwise(F.col("status")),
            "label": F.when(F.col("_carry"), kept).otherwise(F.col("label")),
        }
    ).drop("old", "_carry")


def is_stale(captured_at: Column, as_of: str | Column) -> Column:
    age = F.unix_micros(as_instant(as_of)) - F.unix_micros(captured_at)
    return F.coalesce(age > STALE_SECONDS * 1_000_000, F.lit(False))


def status(as_of: str | Column, has_quota: Column, has_usage: Column, exists: Column, captured_at: Column) -> Column:
    """Stale, available, localOnly, snapshotNeeded or unavailable, in that precedence."""
    return (
        F.when(is_stale(captured_at, as_of), "stale").when(has_quota, "available")
        .when(exists, "localOnly").when(has_usage, "snapshotNeeded").otherwise("unavailable")
    )


def latest_status(committed: DataFrame, as_of: str | Column, runtimes: DataFrame | None = None) -> DataFrame:
    """Status of every runtime from its latest snapshot.

    ``runtimes`` names all runtimes with ``exists`` (its status file is there) and ``has_usage`` (local usage was found);
    ``as_of`` may be one of its columns.  Without it only runtimes that have a snapshot are reported, whose file then exists.
    """
    latest = committed.groupBy("runtime").agg(
        F.max_by(F.struct("captured_at", _any_window().alias("has_quota")), F.struct("captured_at", "snapshot_id")).alias("s")
    )
    known = latest.withColumns({"exists": F.lit(True), "has_usage": F.lit(True)}) if runtimes is None else runtimes.join(latest, "runtime", "left")
    held = F.coalesce("s.has_quota", F.lit(False))
    return known.select(
        "runtime", F.col("s.captured_at").alias("captured_at"),
        status(as_of, held, F.col("has_usage"), F.col("exists"), F.col("s.captured_at")).alias("status"),
    )


# --------------------------------------------------------------- reset credits


def reset_credits(docs: DataFrame) -> DataFrame:
    """Available reset credits of a document, soonest expiry first.

    Input: available_count (nullable) and credits, an array of structs
    (id, status, expires_at).  Adds details, inline_details, hidden and missing counts.
    """
    usable = F.filter("credits", lambda c: (c["status"] == "available") & c["id"].isNotNull())
    # Nulls last: the flag sorts before the time.
    keyed = F.array_sort(
        F.transform(usable, lambda c: F.struct(c["expires_at"].isNull().alias("open"), c["expires_at"].alias("expires_at"), c["id"].alias("id")))
    )
    count = F.when(F.col("available_count") >= 0, F.col("available_count"))
    details = F.transform(keyed, lambda c: F.struct(c["id"].alias("id"), c["expires_at"].alias("expires_at")))
    shown = F.slice("details", 1, F.greatest(F.coalesce(F.col("total_count"), F.lit(0)), F.lit(0)).cast("int"))
    return (
        docs.withColumn("total_count", count).withColumn("details", F.coalesce(details, F.array().cast(_CREDITS)))
        .withColumn("shown", shown)
        .withColumn("inline_details", F.slice("shown", 1, INLINE_CREDITS))
        .withColumn("hidden_count", F.greatest(F.coalesce("total_count", F.lit(0)) - F.size("inline_details"), F.lit(0)))
        .withColumn("missing_count", F.greatest(F.coalesce("total_count", F.lit(0)) - F.size("shown"), F.lit(0)))
    )


_CREDITS = "array<struct<id:string,expires_at:timestamp>>"
