"""Concurrency analytics over work intervals: islands, sweeps and daily points.

``period`` (today, 7 days, 28 days) is a grouping column throughout, so one job
answers all three.  Every ordered step runs through ``ordered.running`` over rows
that were first combined per instant; a hot key is cut into slots of a minute, so
the largest group any task sorts is the distinct instants of one minute.
All durations are whole microseconds, so sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.times import as_instant, day_start, local_day, micros_between
from tallyloom.operators import ordered
from tallyloom.session import materialise

# Fixed values.
PERIODS = {"today": 1, "sevenDays": 7, "twentyEightDays": 28}
CONFIDENCE = {"fact": "1.0", "derived": "0.9", "estimated": "0.6"}
HOUR = 3_600_000_000
ACTIVE_DAY_HOURS = 0.25


def confidence(quality: str | Column = "quality") -> Column:
    q = F.col(quality) if isinstance(quality, str) else quality
    chain = None
    for name, value in CONFIDENCE.items():
        lit = F.lit(value).cast("decimal(2,1)")
        chain = F.when(q == name, lit) if chain is None else chain.when(q == name, lit)
    return chain


def hours(micros: str | Column) -> Column:
    value = F.col(micros) if isinstance(micros, str) else micros
    return value.cast("double") / float(HOUR)


def _periods(as_of: str, tz: str) -> Column:
    today = local_day(as_instant(as_of), tz)
    return F.array(
        *[F.struct(F.lit(name).alias("period"), day_start(F.date_sub(today, n - 1), tz).alias("since"))
          for name, n in PERIODS.items()]
    )


def period_rows(spark, as_of: str, tz: str = "UTC") -> DataFrame:
    """The three periods with their first and last civil day."""
    today = local_day(as_instant(as_of), tz)
    return spark.range(1).select(F.inline(_periods(as_of, tz))).select(
        "period", "since", local_day("since", tz).alias("first_day"), today.alias("last_day")
    )


def clip(intervals: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Scorable intervals cut to every period they overlap; one row per period."""
    now = as_instant(as_of)
    usable = intervals.where((F.col("quality") != "estimated") & (F.col("start_at") < now))
    hit = F.filter(_periods(as_of, tz), lambda p: (F.col("end_at") > p["since"]))
    cut = usable.select("*", F.explode(hit).alias("p")).select(
        F.col("p.period").alias("period"),
        *[c for c in intervals.columns if c not in ("start_at", "end_at")],
        F.greatest("start_at", "p.since").alias("start_at"),
        F.least(F.col("end_at"), now).alias("end_at"),
    )
    return cut.where("end_at > start_at")


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Label rows with the start of the island they belong to.

    Rows have one line per (keys, start_at) with the largest end there.  A row opens
    an island when it starts after everything before it has ended; touching merges.
    """
    slot = ordered.hour_slot("start_at")
    # An ordered step reads its input twice, two of them four times.
    reach = materialise(ordered.running(materialise(rows), keys, ["start_at"], slot, reach=ordered.highest_before(F.col("end_at"))))
    opens = F.when(F.col("reach").isNull() | (F.col("start_at") > F.col("reach")), F.col("start_at"))
    return ordered.running(reach, keys, ["start_at"], slot, island=ordered.highest(opens))


def merge_per_worker(clipped: DataFrame) -> DataFrame:
    """Islands of a worker: identity of the first interval, lowest quality, autonomy if any."""
    keys = ["period", "worker_id"]
    first = F.struct("interval_id", "project_id", "worker_kind")
    combined = clipped.groupBy(*keys, "start_at").agg(
        F.max("end_at").alias("end_at"),
        F.min_by(first, "interval_id").alias("first"),
        F.min_by("quality", confidence()).alias("quality"),
        F.bool_or("is_autonomous").alias("is_autonomous"),
    )
    labelled = _islands(combined, keys)
    return labelled.groupBy(*keys, "island").agg(
        F.min_by("first", "start_at").alias("first"),
        F.max("end_at").alias("end_at"),
        F.min_by("quality", confidence()).alias("quality"),
        F.bool_or("is_autonomous").alias("is_autonomous"),
    ).select(
        "period", "worker_id", F.col("first.interval_id").alias("interval_id"),
        F.col("first.project_id").alias("project_id"), F.col("first.worker_kind").alias("worker_kind"),
        F.col("island").alias("start_at"), "end_at", "quality", "is_autonomous",
    )


def islands(intervals: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    return merge_per_worker(clip(intervals, as_of, tz))


def merge_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals per key as disjoint islands."""
    combined = rows.groupBy(*keys, "start_at").agg(F.max("end_at").alias("end_at"))
    labelled = _islands(combined, keys)
    return labelled.groupBy(*keys, F.col("island").alias("start_at")).agg(F.max("end_at").alias("end_at"))


def sweep(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many intervals are open between any two consecutive instants.

    One row per (keys, instant): ``open`` from that instant for ``span`` microseconds.
    Starts and ends at the same instant cancel.
    """
    edges = rows.select(
        *keys,
        F.inline(F.array(
            F.struct(F.col("start_at").alias("t"), F.lit(1).alias("step")),
            F.struct(F.col("end_at").alias("t"), F.lit(-1).alias("step")),
        )),
    ).groupBy(*keys, "t").agg(F.sum("step").alias("step"))
    opened = ordered.running(
        edges, keys, ["t"], ordered.hour_slot("t"),
        open=ordered.total(F.col("step")), until=ordered.following(F.col("t")),
    )
    return opened.select(*keys, "t", "open", F.coalesce(micros_between("t", "until"), F.lit(0)).alias("span"))


def timeline(islands_df: DataFrame, keys: list[str]) -> DataFrame:
    """Active and parallel time and peak concurrency per key."""
    span = F.col("span")
    return sweep(islands_df, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("open") > 0, span)), F.lit(0)).alias("active_micros"),
        F.coalesce(F.sum(F.when(F.col("open") >= 2, span)), F.lit(0)).alias("parallel_micros"),
        F.max("open").alias("peak"),
    )


def concurrency(islands_df: DataFrame) -> DataFrame:
    """Timeline per period with average parallelism."""
    worked = islands_df.groupBy("period").agg(F.sum(micros_between("start_at", "end_at")).alias("worked_micros"))
    return timeline(islands_df, ["period"]).join(worked, "period").withColumn(
        "average_parallelism",
        F.when(F.col("active_micros") > 0, F.col("worked_micros").cast("double") / F.col("active_micros")).otherwise(0.0),
    )


def multi_project(islands_df: DataFrame) -> DataFrame:
    """Time with at least two projects active, per period."""
    projects = merge_union(islands_df, ["period", "project_id"])
    return sweep(projects, ["period"]).groupBy("period").agg(
        F.coalesce(F.sum(F.when(F.col("open") >= 2, F.col("span"))), F.lit(0)).alias("multi_micros")
    )


# --------------------------------------------------------------------- per day


def by_day(islands_df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Islands cut at the civil days they touch: at most 28 pieces each."""
    last_instant = F.timestamp_micros(F.unix_micros("end_at") - 1)
    days = F.sequence(local_day("start_at", tz), local_day(last_instant, tz), F.expr("interval 1 day"))
    return islands_df.select("*", F.explode(days).alias("day")).withColumns(
        {
            "start_at": F.greatest(F.col("start_at"), day_start("day", tz)),
            "end_at": F.least(F.col("end_at"), day_start(F.date_add("day", 1), tz)),
        }
    )


def daily_points(islands_df: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Agents, hours, peak and autonomy for every day of every period, zero days included."""
    pieces = by_day(islands_df, tz)
    keys = ["period", "day"]
    sums = pieces.groupBy(*keys).agg(
        F.count_distinct("worker_id").alias("agents"),
        F.sum(micros_between("start_at", "end_at")).alias("micros"),
        F.bool_or("is_autonomous").alias("autonomous"),
    )
    peaks = sweep(pieces, keys).groupBy(*keys).agg(F.max("open").alias("peak"))
    spine = period_rows(islands_df.sparkSession, as_of, tz).select(
        "period", F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("day")
    )
    return (
        spine.join(sums, keys, "left").join(peaks, keys, "left")
        .select(
            "period", "day", F.coalesce("agents", F.lit(0)).alias("agents"),
            F.coalesce("micros", F.lit(0)).alias("micros"), F.coalesce("peak", F.lit(0)).alias("peak"),
            F.coalesce("autonomous", F.lit(False)).alias("autonomous"),
        )
    )


def active_days(points: DataFrame) -> DataFrame:
    """Days with a quarter hour of work, or any autonomous work."""
    active = (F.col("micros") >= int(ACTIVE_DAY_HOURS * HOUR)) | ((F.col("agents") > 0) & F.col("autonomous"))
    return points.groupBy("period").agg(F.count_if(active).alias("active_days"))


# -------------------------------------------------------------------- measures


def work_measures(islands_df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Hours, shares, longest autonomous stretch and evidence confidence per period."""
    span = micros_between("start_at", "end_at")
    auto = F.col("is_autonomous")
    zero = F.lit(0)
    sums = islands_df.groupBy("period").agg(
        F.sum(span).alias("worked"),
        F.coalesce(F.sum(F.when(auto, span)), zero).alias("autonomous"),
        F.coalesce(F.sum(F.when(F.col("worker_kind") == "subagent", span)), zero).alias("delegated"),
        F.coalesce(F.max(F.when(auto, span)), zero).alias("longest"),
        F.count_distinct(F.when(auto, local_day("start_at", tz))).alias("autonomous_days"),
        F.count_distinct("worker_id").alias("agents"),
        F.count_distinct("project_id").alias("projects"),
        F.sum(span.cast("decimal(20,0)") * confidence()).alias("weighted"),
    )

    def share(part: str) -> Column:
        return F.when(F.col("worked") > 0, F.col(part).cast("double") / F.col("worked")).otherwise(0.0)

    return sums.select(
        "period", hours("worked").alias("ai_hours"), hours("autonomous").alias("autonomous_hours"),
        hours("delegated").alias("delegated_hours"), share("autonomous").alias("autonomous_share"),
        share("delegated").alias("delegated_share"), hours("longest").alias("longest_autonomous_hours"),
        "autonomous_days", "agents", "projects", share("weighted").alias("confidence"),
    )


def effective_workers(islands_df: DataFrame) -> DataFrame:
    """Sum over workers of their hours, each counted up to one."""
    per_worker = islands_df.groupBy("period", "worker_id").agg(
        F.sum(micros_between("start_at", "end_at")).alias("micros")
    )
    return per_worker.groupBy("period").agg(
        hours(F.sum(F.least(F.col("micros"), F.lit(HOUR)))).alias("effective_workers")
    )


def active_workers(workers: DataFrame, islands_df: DataFrame) -> DataFrame:
    """Workers that own an interval in a period."""
    owners = islands_df.select("period", "worker_id").distinct()
    return owners.join(workers, "worker_id")


def project_contributions(islands_df: DataFrame, workers: DataFrame) -> DataFrame:
    """Agents and hours per period and project, named by the project's first known worker."""
    span = micros_between("start_at", "end_at")
    per_worker = islands_df.groupBy("period", "project_id", "worker_id").agg(
        F.sum(span).alias("micros"),
        F.coalesce(F.sum(F.when(F.col("is_autonomous"), span)), F.lit(0)).alias("auto_micros"),
        F.min("start_at").alias("first_at"),
    )
    named = per_worker.join(workers.select("worker_id", "project_name"), "worker_id", "left")
    known = F.when(F.col("project_name").isNotNull(), F.struct("first_at", "worker_id"))
    return named.groupBy("period", "project_id").agg(
        F.coalesce(F.min_by("project_name", known), F.lit("uncategorized")).alias("project_name"),
        F.count("*").alias("agents"),
        hours(F.sum("micros")).alias("ai_hours"),
        hours(F.sum("auto_micros")).alias("autonomous_hours"),
    )
