"""Dimension scores, the composite score and its rank band."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import intervals as iv
from tallyloom.session import materialise

# References, weights and bounds of the score.
WEIGHTS = {"span": 0.30, "leverage": 0.30, "orchestration": 0.25, "autonomy": 0.15}
MINIMUM_COVERAGE = 0.70
FULL_COVERAGE = 0.95
FULL_DAYS = 28
BANDS = ((0, 19), (20, 34), (35, 49), (50, 64), (65, 79), (80, 92), (93, 100))


def _log_ratio(value: str, reference: float) -> Column:
    return F.when(F.col(value) > 0, F.least(F.lit(1.0), F.log1p(F.col(value)) / F.lit(math.log1p(reference)))).otherwise(0.0)


def _ratio(value: str, reference: float) -> Column:
    return F.least(F.greatest(F.col(value) / F.lit(reference), F.lit(0.0)), F.lit(1.0))


def _bounded(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def metrics(intervals: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Every measure the scores need: one row per period that exists, work or not."""
    # Seven measures read the islands, some of them several times.
    return metrics_of(materialise(iv.islands(intervals, as_of, tz)), as_of, tz)


def metrics_of(islands_df: DataFrame, as_of: str, tz: str = "UTC", points: DataFrame | None = None) -> DataFrame:
    points = iv.daily_points(islands_df, as_of, tz) if points is None else points
    parts = (
        iv.period_rows(islands_df.sparkSession, as_of, tz).select("period")
        .join(iv.concurrency(islands_df), "period", "left")
        .join(iv.multi_project(islands_df), "period", "left")
        .join(iv.work_measures(islands_df, tz), "period", "left")
        .join(iv.effective_workers(islands_df), "period", "left")
        .join(iv.active_days(points), "period", "left")
    )
    active = F.col("active_micros")

    def share(part: str) -> Column:
        return F.when(active > 0, F.col(part).cast("double") / active).otherwise(0.0)

    days = F.col("active_days")
    filled = parts.fillna(0)
    return filled.withColumns(
        {
            "parallel_share": share("parallel_micros"),
            "multi_share": share("multi_micros"),
            "daily_hours": F.when(days > 0, F.col("ai_hours") / days).otherwise(0.0),
            "autonomous_day_share": F.when(days > 0, F.col("autonomous_days").cast("double") / days).otherwise(0.0),
        }
    )


def with_dimensions(measures: DataFrame) -> DataFrame:
    """The four dimension scores as columns."""
    return measures.withColumns(
        {
            "span": _bounded(100 * (0.70 * _log_ratio("effective_workers", 12.0) + 0.30 * _log_ratio("peak", 6.0))),
            "leverage": _bounded(100 * (0.70 * _log_ratio("daily_hours", 8.0) + 0.30 * _log_ratio("average_parallelism", 3.0))),
            "orchestration": _bounded(
                100 * (0.45 * _ratio("delegated_share", 0.60) + 0.35 * _ratio("parallel_share", 0.50) + 0.20 * _ratio("multi_share", 0.35))
            ),
            "autonomy": _bounded(
                100 * (0.50 * _ratio("autonomous_share", 0.60) + 0.30 * _log_ratio("longest_autonomous_hours", 2.0)
                       + 0.20 * _ratio("autonomous_day_share", 0.70))
            ),
        }
    )


def dimension_rows(measures: DataFrame) -> DataFrame:
    """Scores as rows (period, dimension, score, confidence), only for periods with an active day."""
    wide = with_dimensions(measures).where("active_days > 0").select("period", "confidence", *WEIGHTS)
    return wide.unpivot(["period", "confidence"], list(WEIGHTS), "dimension", "score")


def maturity(days: Column) -> Column:
    growing = F.least(F.lit(1.0), 0.2 + 0.8 * (1 - F.exp(-days.cast("double") / 6)))
    return F.when(days <= 0, 0.0).when(days >= FULL_DAYS, 1.0).otherwise(growing)


def core_score() -> Column:
    """Weighted geometric mean; a dimension below one point counts as one."""
    exponent = sum(w * F.ln(F.greatest(F.col(name), F.lit(1.0)) / 100) for name, w in WEIGHTS.items())
    return _bounded(100 * F.exp(exponent))


def band_column(score: Column, at: int) -> Column:
    chain = None
    for level, bounds in reversed(list(enumerate(BANDS, start=1))):
        value = level if at < 0 else bounds[at]
        chain = F.when(score >= bounds[0], value) if chain is None else chain.when(score >= bounds[0], value)
    return F.when(score.isNotNull(), chain).cast("bigint")


def next_lower_bound(score: Column) -> Column:
    """Lower bound of the band after the score's band; null at the top."""
    chain = None
    for (low, _), (following, _) in reversed(list(zip(BANDS, BANDS[1:]))):
        hit = (score >= low) & (score < following)
        chain = F.when(hit, following) if chain is None else chain.when(hit, following)
    return chain.cast("bigint")


def composite(dimensioned: DataFrame) -> DataFrame:
    """Score, core score, maturity, coverage and rank band per period."""
    days = F.col("active_days")
    coverage = F.when(days > 0, sum(w * F.col("confidence") for w in WEIGHTS.values())).otherwise(0.0)
    df = dimensioned.withColumns({"coverage": coverage, "maturity": maturity(days), "_core": core_score()})
    ok = (F.round("coverage", 9) >= MINIMUM_COVERAGE) & (days > 0)
    raw = F.least(F.greatest(F.round(F.col("_core") * F.col("maturity")), F.lit(0.0)), F.lit(100.0)).cast("bigint")
    capped = F.when((raw == 100) & ((days < FULL_DAYS) | (F.col("coverage") < FULL_COVERAGE)), 99).otherwise(raw)
    return (
        df.withColumn("score", F.when(ok, capped).cast("bigint"))
        .withColumn("core", F.when(ok, F.col("_core")))
        .drop("_core")
        .withColumns(
            {
                "level": band_column(F.col("score"), -1),
                "level_low": band_column(F.col("score"), 0),
                "level_high": band_column(F.col("score"), 1),
                "next_level_low": next_lower_bound(F.col("score")),
            }
        )
    )


def report(intervals: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """One row per period: measures, dimensions, score and band."""
    return composite(with_dimensions(metrics(intervals, as_of, tz)))
