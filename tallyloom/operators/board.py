"""The task board: threads, archives, schedules, live state and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.functions.times import as_instant, local_day, start_of_day

COLUMNS = ("active", "pending", "scheduled", "done")
WEEKDAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")
ATTENTION = {"userInput": 0, "failure": 1, "dataIssue": 2, "update": 3}

ITEM_COLUMNS = (
    "item_id", "thread_id", "title", "detail", "updated_at", "tokens", "column_kind", "display_state",
    "runtime_state", "is_realtime", "source_kind", "state_basis", "next_run_at",
)


def _thread_items(rows: DataFrame, when: Column, column: Column, state: Column, basis: str) -> DataFrame:
    tokens = F.when(F.col("tokens_used") > 0, F.col("tokens_used"))
    return rows.select(
        F.concat("thread_id", column).alias("item_id"), "thread_id",
        nm.title("title", "preview").alias("title"), nm.last_component("cwd").alias("detail"),
        when.alias("updated_at"), tokens.alias("tokens"), column.alias("column_kind"), state.alias("display_state"),
        F.lit("recorded").alias("runtime_state"), F.lit(False).alias("is_realtime"),
        F.lit("thread").alias("source_kind"), F.lit(basis).alias("state_basis"),
        F.lit(None).cast("timestamp").alias("next_run_at"),
    )


def _visible(threads: DataFrame) -> DataFrame:
    return threads.where(F.coalesce("thread_source", F.lit("")) != "subagent")


def thread_items(threads: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Open threads touched today."""
    now, since = as_instant(as_of), start_of_day(as_instant(as_of), tz)
    touched = (F.col("updated_at") >= since) | (F.col("recency_at") >= since) | (F.col("created_at") >= since)
    rows = _visible(threads).where(~F.col("archived") & (F.col("preview") != "") & touched)
    when = F.coalesce("recency_at", "updated_at")
    return _thread_items(rows, when, nm.activity_column(when, now), nm.activity_state(when, now), "activityWindow")


def archived_items(threads: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Threads archived today."""
    when = F.coalesce("archived_at", "updated_at")
    rows = _visible(threads).where(F.col("archived") & (when >= start_of_day(as_instant(as_of), tz)))
    return _thread_items(rows, when, F.lit("done"), F.lit("archived"), "archive")


def task_items(tasks: DataFrame) -> DataFrame:
    """Items from task documents (path, status, title, updated_at, project)."""
    state = nm.task_state("status")
    runtime = F.when(state.isin("running", "failed", "completed"), state).otherwise("recorded")
    return tasks.select(
        F.col("path").alias("item_id"), F.lit(None).cast("string").alias("thread_id"), "title",
        F.coalesce(nm.last_component("project"), F.lit("")).alias("detail"), "updated_at",
        F.lit(None).cast("bigint").alias("tokens"), nm.task_column("status").alias("column_kind"),
        state.alias("display_state"), runtime.alias("runtime_state"), F.lit(False).alias("is_realtime"),
        F.lit("task").alias("source_kind"), F.lit("explicit").alias("state_basis"),
        F.lit(None).cast("timestamp").alias("next_run_at"),
    )


def in_order(items: DataFrame) -> DataFrame:
    """Latest first, items without a time last."""
    return items.orderBy(F.desc_nulls_last("updated_at"), "item_id")


# ------------------------------------------------------------------- schedules


def _local_to_instant(local: Column, zone: Column) -> Column:
    """Wall-clock time to instant.  A time lost in a daylight gap becomes the end of the gap.

    Spark resolves a lost time with the offset before the gap.  The first lost
    quarter hour, resolved that way, is the instant of the change itself.
    """
    plain = F.to_utc_timestamp(local, zone)
    lost = F.filter(
        F.sequence(F.date_trunc("hour", local) - F.expr("interval 2 hours"), local, F.expr("interval 15 minutes")),
        lambda t: F.from_utc_timestamp(F.to_utc_timestamp(t, zone), zone) != t,
    )
    return F.when(F.from_utc_timestamp(plain, zone) == local, plain).otherwise(
        F.coalesce(F.to_utc_timestamp(F.array_min(lost), zone), plain)
    )


def parse_rules(schedules: DataFrame) -> DataFrame:
    """Recurrence text to zone, start, frequency, interval, time of day and weekdays."""
    text = F.coalesce(nm.strip("rrule"), F.lit(""))
    # The zones that the JVM, which converts the times, knows.
    zones = sorted(schedules.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    start_line = F.regexp_extract(text, r"(?im)^(DTSTART[^\n]*)$", 1)
    zone = F.regexp_extract(start_line, r"(?i)TZID=(.*):[^:]*$", 1)
    stamp = F.regexp_extract(start_line, r":([^:]*)$", 1)
    marked = F.regexp_extract(text, r"(?im)^RRULE:([^\n]*)$", 1)
    bare = F.regexp_extract(text, r"(?im)^([^\n]*FREQ=[^\n]*)$", 1)
    body = F.upper(F.when(marked != "", marked).when(bare != "", bare).otherwise(text))
    known = F.when(zone.isin(zones), zone)
    start = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmm")), F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")))
    parsed = schedules.withColumns(
        {
            "zone": known,
            "local_start": F.when(known.isNotNull(), start),
            "_pairs": F.filter(F.split(body, ";"), lambda p: p.rlike("^[^=]+=.+")),
        }
    )

    def field(name: str) -> Column:
        hits = F.filter("_pairs", lambda p: p.startswith(name + "="))
        return F.substr(F.try_element_at(hits, F.lit(-1)), F.lit(len(name) + 2))

    hour, minute = field("BYHOUR").try_cast("int"), field("BYMINUTE").try_cast("int")
    explicit = hour.isNotNull() & minute.isNotNull()
    days = F.filter(F.split(F.coalesce(field("BYDAY"), F.lit("")), ","), lambda d: d.isin(*WEEKDAYS))
    return parsed.withColumns(
        {
            "frequency": field("FREQ"),
            "every": F.coalesce(field("INTERVAL").try_cast("int"), F.lit(1)),
            "hour": F.when(explicit, hour).otherwise(F.hour("local_start")),
            "minute": F.when(explicit, minute).otherwise(F.minute("local_start")),
            "weekdays": days,
        }
    ).drop("_pairs")


def next_runs(schedules: DataFrame, as_of: str) -> DataFrame:
    """Next run of every schedule strictly after the clock (and not before its start)."""
    now = as_instant(as_of)
    parsed = parse_rules(schedules)
    start = F.when(F.col("local_start").isNotNull(), F.to_utc_timestamp("local_start", F.col("zone")))
    floor = F.greatest(now, start - F.expr("interval 1 second"))
    own_day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek("local_start"))
    wanted = F.when(F.size("weekdays") > 0, F.col("weekdays")).when(
        F.col("local_start").isNotNull(), F.array(own_day)
    )
    staged = parsed.withColumns({"_floor": floor, "_wanted": wanted}).withColumn(
        "_first", F.to_date(F.from_utc_timestamp("_floor", F.col("zone")))
    )
    week = F.array(*[F.lit(d) for d in WEEKDAYS])
    days = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: F.date_add("_first", n))
    eligible = F.when(F.col("frequency") == "DAILY", days).otherwise(
        F.filter(days, lambda d: F.array_contains("_wanted", F.element_at(week, F.dayofweek(d))))
    )
    local = F.transform(
        eligible,
        lambda d: d.cast("timestamp") + F.make_dt_interval(hours=F.col("hour"), mins=F.col("minute")),
    )
    instants = F.filter(
        F.transform(local, lambda t: _local_to_instant(t, F.col("zone"))), lambda t: t > F.col("_floor")
    )
    usable = (
        (F.col("every") == 1) & F.col("zone").isNotNull() & F.col("hour").between(0, 23)
        & F.col("minute").between(0, 59) & F.col("frequency").isin("DAILY", "WEEKLY")
    )
    return staged.withColumn("next_run_at", F.when(usable, F.array_min(instants))).drop("_floor", "_wanted", "_first")


def cadence(parsed: DataFrame) -> DataFrame:
    """Readable cadence: frequency, weekdays or interval, and time of day."""
    at = F.when(F.col("hour").isNotNull() & F.col("minute").isNotNull(),
                F.format_string("%02d:%02d", "hour", "minute"))
    every = F.when(F.col("every") == 1, "").otherwise(F.concat(F.lit(" "), F.col("every").cast("string")))
    text = (
        F.when(F.col("frequency") == "DAILY", F.concat_ws(" ", F.lit("daily"), at))
        .when(F.col("frequency") == "WEEKLY", F.concat_ws(" ", F.lit("weekly"), F.when(F.size("weekdays") > 0, F.array_join("weekdays", ",")), at))
        .when(F.col("frequency").isin("HOURLY", "MINUTELY"), F.concat(F.lower("frequency"), every))
        .otherwise(F.coalesce(at, F.lit("scheduled")))
    )
    return parsed.withColumn("cadence", text)


def schedule_items(schedules: DataFrame, as_of: str) -> DataFrame:
    """Scheduled items, soonest first."""
    rows = cadence(next_runs(schedules, as_of))
    return rows.select(
        F.concat(F.lit("schedule-"), "schedule_id").alias("item_id"), F.lit(None).cast("string").alias("thread_id"),
        F.col("name").alias("title"), F.col("cadence").alias("detail"), F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("bigint").alias("tokens"), F.lit("scheduled").alias("column_kind"),
        F.lit("scheduled").alias("display_state"), F.lit("recorded").alias("runtime_state"),
        F.lit(False).alias("is_realtime"), F.lit("schedule").alias("source_kind"),
        F.lit("scheduleConfig").alias("state_basis"), "next_run_at",
    ).orderBy(F.asc_nulls_last("next_run_at"), "title", "item_id")


# ------------------------------------------------------------- summary, merge


def column_summary(items: DataFrame) -> DataFrame:
    """Item counts of the four columns, zero where a column is empty, and the total."""
    rows = [F.struct(F.lit(c).alias("column_kind"), F.count_if(F.col("column_kind") == c).alias("item_count")) for c in COLUMNS]
    return items.agg(F.array(*rows).alias("rows"), F.count("*").alias("total_count")).select(F.inline("rows"), "total_count")


def is_realtime(state: Column, connected: Column) -> Column:
    return connected & ~state.isin("recorded", "disconnected")


def merge_live(items: DataFrame, live: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Board items overlaid with live state (thread_id, state, updated_at, name, is_realtime).

    A live row overrides time and state; unknown threads appear when touched on the
    day of the clock; archived items stay archived; non-live rows are ignored.
    """
    now = as_instant(as_of)
    fixed = items.where("thread_id is null or column_kind = 'scheduled'")
    board = items.where("thread_id is not null and column_kind <> 'scheduled'")
    rows = live.where("is_realtime").select(
        "thread_id", F.struct(F.col("state"), F.col("updated_at").alias("at"), F.col("name")).alias("live")
    )
    both = board.withColumn("_known", F.lit(True)).join(rows, "thread_id", "full_outer")
    known = F.coalesce("_known", F.lit(False))
    touched = F.col("live").isNotNull()
    same_day = local_day(F.coalesce(F.col("live.at"), now), tz) == local_day(now, tz)
    at = F.coalesce("live.at", "updated_at")
    moved = known & touched
    archived = F.col("display_state") == "archived"
    state = F.col("live.state")
    live_column = F.when(state.isin("running", "waitingInput"), "active").when(state == "completed", "done").otherwise("pending")
    merged = both.where(known | same_day).select(
        F.when(known, F.col("item_id")).otherwise(F.concat(F.lit("live-"), F.col("thread_id"))).alias("item_id"),
        "thread_id",
        F.when(known, F.col("title")).otherwise(F.coalesce("live.name", F.lit("Live task"))).alias("title"),
        F.coalesce("detail", F.lit("")).alias("detail"),
        F.when(known & ~touched, F.col("updated_at")).when(known, at).otherwise(F.col("live.at")).alias("updated_at"),
        "tokens",
        F.when(~known, live_column).when(moved & archived, "done").when(moved, nm.activity_column(at, now))
        .otherwise(F.col("column_kind")).alias("column_kind"),
        F.when(~known, "recentlyActive").when(moved & archived, "archived").when(moved, nm.activity_state(at, now))
        .otherwise(F.col("display_state")).alias("display_state"),
        F.when(touched, state).otherwise(F.col("runtime_state")).alias("runtime_state"),
        touched.alias("is_realtime"),
        F.coalesce("source_kind", F.lit("thread")).alias("source_kind"),
        F.coalesce("state_basis", F.lit("activityWindow")).alias("state_basis"),
        "next_run_at",
    )
    return merged.unionByName(fixed)


def attention(items: DataFrame, statuses: DataFrame, k: int = 1) -> DataFrame:
    """Most urgent item: failed tasks, then runtimes without usable data; oldest first.

    ``statuses`` has runtime, status and since.  Waiting for input is not reported.
    """
    failed = items.where("runtime_state = 'failed'").select(
        F.concat_ws("-", F.lit("task"), "item_id", F.lit(ATTENTION["failure"]).cast("string")).alias("attention_id"),
        F.lit(ATTENTION["failure"]).cast("bigint").alias("kind"), "thread_id", "title", F.col("updated_at").alias("since"),
    )
    broken = statuses.where(F.col("status").isin("unavailable", "stale", "snapshotNeeded")).select(
        F.concat_ws("-", F.lit("data"), "runtime", "status").alias("attention_id"),
        F.lit(ATTENTION["dataIssue"]).cast("bigint").alias("kind"), F.lit(None).cast("string").alias("thread_id"),
        F.col("runtime").alias("title"), "since",
    )
    return failed.unionByName(broken).orderBy("kind", F.asc_nulls_last("since"), "attention_id").limit(k)
