"""Islands, sweeps, daily points and the score: literal cases and a brute-force walk."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals as iv
from tallyloom.operators import ordered, scoring, worktime

AS_OF = "2026-07-21 18:00:00"
DAY = dt.datetime(2026, 7, 21)
SCHEMA = ("interval_id string, worker_id string, worker_kind string, project_id string, start_at timestamp, "
          "end_at timestamp, quality string, is_autonomous boolean")


def at(hours):
    return DAY + dt.timedelta(hours=hours)


CASE = [
    ("a1", "a", "main", "p1", at(9), at(10), "fact", False),
    ("a2", "a", "main", "p1", at(9.75), at(10.25), "fact", False),
    ("b1", "b", "subagent", "p1", at(9.5), at(10.5), "fact", True),
    ("c1", "c", "automation", "p2", at(15), at(16), "fact", True),
    ("e1", "ignored", "main", "p3", at(8), at(17), "estimated", False),
]


def test_self_check_day(spark, one):
    report = scoring.report(spark.createDataFrame(CASE, SCHEMA), AS_OF).where("period = 'today'")
    row = one(report)
    assert abs(row["ai_hours"] - 3.25) < 1e-9
    assert (row["peak"], row["agents"], row["projects"]) == (2, 3, 2)
    assert row["active_micros"] == 2.5 * iv.HOUR and row["parallel_micros"] == 0.75 * iv.HOUR
    assert row["coverage"] == pytest.approx(1)
    assert row["autonomy"] > 0 and row["score"] <= 33
    assert row["effective_workers"] == 3.0


def test_only_main_work_has_no_autonomy(spark, one):
    row = one(scoring.report(spark.createDataFrame(CASE[:1], SCHEMA), AS_OF).where("period = 'today'"))
    assert row["autonomy"] == 0


def test_no_work_gives_no_score(spark, one):
    row = one(scoring.report(spark.createDataFrame(CASE[4:], SCHEMA), AS_OF).where("period = 'today'"))
    assert row["score"] is None and row["level"] is None and row["active_days"] == 0


def test_touching_intervals_merge(spark, rows):
    data = [("1", "w", "main", "p", at(1), at(2), "fact", False), ("2", "w", "main", "q", at(2), at(3), "derived", True),
            ("3", "w", "main", "p", at(4), at(5), "fact", False)]
    out = iv.islands(spark.createDataFrame(data, SCHEMA), AS_OF).where("period = 'today'")
    assert rows(out, "interval_id", "project_id", "start_at", "end_at", "quality", "is_autonomous") == [
        ("1", "p", at(1), at(3), "derived", True), ("3", "p", at(4), at(5), "fact", False)]


def _walk(data, since, until):
    """Brute force: merge per worker, then step through all instants."""
    merged = []
    for worker in sorted({r[1] for r in data}):
        last = None
        mine = sorted((max(r[4], since), min(r[5], until), r[0], r[3]) for r in data if r[1] == worker and r[6] != "estimated" and min(r[5], until) > max(r[4], since))
        for s, e, _, p in mine:
            if last and s <= last[1]:
                last[1] = max(last[1], e)
            else:
                last = [s, e, worker, p]
                merged.append(last)
    times = sorted({t for m in merged for t in m[:2]})
    active = parallel = multi = peak = 0
    for a, b in zip(times, times[1:]):
        on = [m for m in merged if m[0] <= a < m[1]]
        span = (b - a) // dt.timedelta(microseconds=1)
        active += span * bool(on)
        parallel += span * (len(on) >= 2)
        multi += span * (len({m[3] for m in on}) >= 2)
        peak = max(peak, len(on))
    return len(merged), active, parallel, multi, peak


def test_matches_brute_force(spark, one):
    rng = random.Random(5)
    data = []
    for n in range(250):
        start = DAY - dt.timedelta(days=3) + dt.timedelta(seconds=rng.randint(0, 3 * 86400), microseconds=rng.choice([0, 0, 7]))
        data.append((f"{n:04d}", f"w{rng.randint(0, 6)}", "main", f"p{rng.randint(0, 3)}", start,
                     start + dt.timedelta(minutes=rng.randint(0, 200)), rng.choice(["fact", "derived", "estimated"]), False))
    isl = iv.islands(spark.createDataFrame(data, SCHEMA), AS_OF)
    seven = isl.where("period = 'sevenDays'")
    n, active, parallel, multi, peak = _walk(data, DAY - dt.timedelta(days=6), dt.datetime(2026, 7, 21, 18))
    assert seven.count() == n
    line = one(iv.concurrency(isl).where("period = 'sevenDays'"))
    assert (line["active_micros"], line["parallel_micros"], line["peak"]) == (active, parallel, peak)
    assert one(iv.multi_project(isl).where("period = 'sevenDays'"))["multi_micros"] == multi
    points = iv.daily_points(isl, AS_OF).where("period = 'sevenDays'")
    assert points.count() == 7
    assert points.agg(F.sum("micros")).first()[0] == line["worked_micros"]
    projects = iv.project_contributions(isl, spark.createDataFrame([("w0", "zero")], "worker_id string, project_name string"))
    total = projects.where("period = 'sevenDays'").agg(F.sum("ai_hours")).first()[0]
    assert total == pytest.approx(line["worked_micros"] / iv.HOUR)


def test_days_of_23_and_25_hours(spark, rows):
    data = [("1", "w", "main", "p", dt.datetime(2026, 3, 7, 8), dt.datetime(2026, 3, 10, 7), "fact", False)]
    isl = iv.islands(spark.createDataFrame(data, SCHEMA), "2026-03-10 06:59:59", "America/Los_Angeles")
    points = iv.daily_points(isl, "2026-03-10 06:59:59", "America/Los_Angeles").where("period = 'sevenDays' and micros > 0")
    assert [round(r["micros"] / iv.HOUR) for r in points.orderBy("day").collect()] == [24, 23, 24]


@pytest.mark.parametrize("score,level,low,high,following", [
    (0, 1, 0, 19, 20), (19, 1, 0, 19, 20), (20, 2, 20, 34, 35), (34, 2, 20, 34, 35), (35, 3, 35, 49, 50), (64, 4, 50, 64, 65),
    (65, 5, 65, 79, 80), (79, 5, 65, 79, 80), (80, 6, 80, 92, 93), (92, 6, 80, 92, 93), (93, 7, 93, 100, None), (100, 7, 93, 100, None)])
def test_bands(spark, one, score, level, low, high, following):
    s = F.lit(score)
    row = one(spark.range(1).select(scoring.band_column(s, -1).alias("l"), scoring.band_column(s, 0).alias("a"),
                                    scoring.band_column(s, 1).alias("b"), scoring.next_lower_bound(s).alias("n")))
    assert tuple(row.values()) == (level, low, high, following)


@pytest.mark.parametrize("days,confidence,score", [(1, 1.0, 33), (28, 1.0, 100), (27, 1.0, 99), (28, 0.94, 99), (28, 0.69, None), (0, 1.0, None)])
def test_final_score(spark, one, days, confidence, score):
    df = spark.range(1).select(F.lit(days).alias("active_days"), F.lit(confidence).alias("confidence"),
                               *[F.lit(100.0).alias(n) for n in scoring.WEIGHTS])
    got = one(scoring.composite(df))["score"]
    assert got == score or (days == 1 and got <= score)


def test_turn_pairs(spark, rows):
    t = lambda s: DAY + dt.timedelta(seconds=s)
    data = [
        (1, "a", "x", "started", t(10), None), (2, "a", "x", "started", t(20), None), (3, "a", "x", "completed", t(50), 1000.0),
        (4, "a", "y", "completed", t(60), 5000.0), (5, "a", "z", "completed", t(70), None), (6, "a", "v", "completed", t(80), -1000.0),
        (7, "a", "u", "started", t(-100), None), (8, "a", "u", "completed", t(90), None), (9, "a", "n", "completed", t(86400), 100.0),
    ]
    events = spark.createDataFrame(data, "line_no bigint, thread_id string, turn_id string, mark string, at timestamp, duration_ms double").selectExpr(
        "*", "timestamp'2026-07-21 00:00:00' as created_at", "'automation' as worker_kind", "cast(null as string) as automation_id")
    out = worktime.pair_turns(events, AS_OF, ordered.line_slot("line_no"), ["line_no"])
    assert rows(out, "turn_id", "start_at", "end_at", "quality") == [("x", t(20), t(50), "derived"), ("y", t(55), t(60), "derived")]


def test_measures_read_islands_once(spark):
    """The intervals are read for the islands alone; every measure reads the written islands."""
    work = spark.range(40).select(
        F.col("id").cast("string").alias("interval_id"), (F.col("id") % 4).cast("string").alias("worker_id"), F.lit("main").alias("worker_kind"),
        F.lit("p").alias("project_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("start_at"),
        F.timestamp_seconds(F.lit(1_700_000_090) + F.col("id") * 60).alias("end_at"), F.lit("fact").alias("quality"), F.lit(False).alias("is_autonomous"))
    measures = scoring.metrics(work, "2023-11-14 23:30:00")
    assert "(0, 40, step=1" not in measures._jdf.queryExecution().optimizedPlan().toString()
    # One minute apart and a minute and a half long: two at a time.
    assert {r.period: r.peak for r in measures.collect()} == {"today": 2, "sevenDays": 2, "twentyEightDays": 2}
