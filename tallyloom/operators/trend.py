"""Trend summaries, heat maps and model series over dense daily usage.

A dense series has one row per civil day (at most 191 per key), so everything
here works on data whose size does not depend on the ledger, except the number of
models, which stays a grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import tokens as tok
from tallyloom.functions.times import as_instant, day_start, local_day
from tallyloom.operators import usage
from tallyloom.schemas import TOKEN_COLUMNS

OTHER_MODELS = "other-models"
VISIBLE_MODELS = 8
TREND_WINDOWS = (30, 60, 90, 180)
HEAT_QUANTILES = {"log": (0.25, 0.50, 0.75, 0.90), "transcript": (0.25, 0.50, 0.75, 0.95)}
HEAT_EMPTY = (1, 10, 100, 1000)


def _today(as_of: str, tz: str) -> Column:
    return local_day(as_instant(as_of), tz)


def _recent(today: Column, days: int = 7, shift: int = 0) -> Column:
    """Day lies in the ``days`` days that end ``shift`` days before today."""
    return F.col("day").between(F.date_sub(today, days - 1 + shift), F.date_sub(today, shift))


def _summary_columns(today: Column, profile: str) -> list[Column]:
    week = _recent(today)
    before = _recent(today, shift=7)
    tokens = F.col("tokens")
    previous = (
        F.sum(F.when(before, tokens))
        if profile == "log"
        else tok.visible_total(*[F.sum(F.when(before, F.col(c))) for c in ("total_tokens", "input_tokens", "output_tokens")])
    )
    # Latest maximum is replaced by the earliest: the order key falls with the day.
    in_peak_range = week if profile == "log" else F.lit(True)
    peak_key = F.when(in_peak_range & (tokens > 0), F.struct(tokens.alias("t"), (-F.unix_date("day")).alias("d")))
    return [
        *tok.sum_tokens(when=week, prefix="week_"),
        tok.sum_cost(when=week, name="week_cost"),
        F.coalesce(previous, F.lit(0)).cast("bigint").alias("previous_tokens"),
        F.max_by("day", peak_key).alias("peak_day"),
        F.max_by("tokens", peak_key).alias("peak_tokens"),
        F.count_if(tokens > 0).alias("active_days"),
        F.sum("tokens").alias("range_tokens"),
    ]


def _finish_summary(df: DataFrame) -> DataFrame:
    week = tok.visible_total("week_total_tokens", "week_input_tokens", "week_output_tokens")
    previous = F.col("previous_tokens")
    return df.withColumn("week_tokens", week).withColumns(
        {
            "daily_average": F.expr("week_tokens div 7"),
            "change_percent": F.when(
                previous > 0, F.round((F.col("week_tokens").cast("double") - previous) / previous * 100, 6)
            ),
            "is_new": (previous == 0) & (F.col("week_tokens") > 0),
        }
    ).drop(*[f"week_{c}" for c in TOKEN_COLUMNS])


def summary(dense: DataFrame, as_of: str, tz: str = "UTC", profile: str = "log") -> DataFrame:
    """Seven days against the seven before, average, earliest peak and active days: one row."""
    return _finish_summary(dense.agg(*_summary_columns(_today(as_of, tz), profile)))


def projected_month_cost(dense: DataFrame, as_of: str, tz: str = "UTC", profile: str = "log") -> DataFrame:
    """Month cost scaled to the whole month; the log profile waits for the second day."""
    today = _today(as_of, tz)
    in_month = F.col("day").between(F.trunc(today, "month"), today)
    month = dense.agg(tok.sum_cost(when=in_month, name="month_cost"))
    scaled = F.col("month_cost").cast("double") / F.day(today) * F.day(F.last_day(today))
    if profile == "log":
        scaled = F.when((F.day(today) >= 2) & (F.col("month_cost") > 0), scaled)
    return month.select(tok.usd("month_cost").alias("month_cost"), F.round(scaled, 6).alias("projected_cost"))


def active_days(dense: DataFrame) -> DataFrame:
    return dense.agg(F.count_if(F.col("tokens") > 0).alias("active_days"))


# ------------------------------------------------------------------- heat map


def heat_grid(dense: DataFrame, as_of: str, tz: str = "UTC", profile: str = "log") -> DataFrame:
    """Cells (week_index, weekday_index, day, tokens, is_future).

    Log: 26 weeks from Monday, later days empty.  Transcript: 180 rolling days in rows of seven.
    """
    today = _today(as_of, tz)
    if profile == "log":
        monday = F.date_sub(F.trunc(today, "week"), 25 * 7)
        days = F.sequence(monday, F.date_add(monday, 26 * 7 - 1), F.expr("interval 1 day"))
        first = monday
    else:
        first = F.date_sub(today, 179)
        days = F.sequence(first, today, F.expr("interval 1 day"))
    cells = dense.sparkSession.range(1).select(F.posexplode(days).alias("at", "day"), today.alias("today"))
    joined = cells.join(dense.select("day", "tokens"), "day", "left")
    future = F.col("day") > F.col("today")
    return joined.select(
        F.expr("at div 7").alias("week_index"),
        (F.col("at") % 7).cast("bigint").alias("weekday_index"),
        "day",
        F.when(~future, F.coalesce("tokens", F.lit(0))).alias("tokens"),
        future.alias("is_future"),
    )


def heat_thresholds(cells: DataFrame, profile: str = "log") -> DataFrame:
    """Four level bounds from the non-zero days (at most 182 of them)."""
    values = cells.agg(F.array_sort(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens")))).alias("v"))
    n = F.size("v")

    def quantile(q: float) -> Column:
        return F.greatest(F.element_at("v", F.round((n - 1) * F.lit(q)).cast("int") + 1), F.lit(1))

    quantiles = [quantile(q) for q in HEAT_QUANTILES[profile]]
    if profile == "log":
        top = F.greatest(F.coalesce(F.array_max("v"), F.lit(1)), F.lit(1)).cast("bigint")
        spare = [F.greatest(F.floor(top * k / 5), F.lit(1)) for k in (1, 2, 3, 4)]
        few = n < 5
    else:
        spare = [F.lit(k) for k in HEAT_EMPTY]
        few = n == 0
    return values.select(
        *[F.when(few, s.cast("bigint")).otherwise(q.cast("bigint")).alias(f"bound_{i}")
          for i, (s, q) in enumerate(zip(spare, quantiles), start=1)]
    )


def heat_levels(cells: DataFrame, profile: str = "log") -> DataFrame:
    """Cells with their level 0..4 (the fourth bound only labels the legend)."""
    bounds = heat_thresholds(cells, profile).select(F.struct("bound_1", "bound_2", "bound_3")).scalar()
    first, second, third = (bounds[f"bound_{i}"] for i in (1, 2, 3))
    tokens = F.coalesce("tokens", F.lit(0))
    return cells.withColumn(
        "level",
        F.when(tokens <= 0, 0).when(tokens <= first, 1).when(tokens <= second, 2).when(tokens <= third, 3)
        .otherwise(4).cast("bigint"),
    )


# --------------------------------------------------------------- model series


def model_daily(ledger: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Daily usage by model within the trend range (sparse)."""
    first = F.date_sub(_today(as_of, tz), usage.TREND_DAYS["log"])
    return usage.daily_by_model(ledger.where(F.col("ts") >= day_start(first, tz)), tz)


def model_dense(by_model: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """One zero-filled series per active model: every model lists the calendar itself."""
    today = _today(as_of, tz)
    active = by_model.groupBy("model_id").agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("day"))).alias("model"),
                                             F.sum("tokens").alias("_n")).where("_n > 0")
    days = F.sequence(F.date_sub(today, usage.TREND_DAYS["log"]), today, F.expr("interval 1 day"))
    grid = active.select("model_id", "model", F.explode(days).alias("day"))
    measures = ["tokens", "cost_usd", *TOKEN_COLUMNS]
    joined = grid.join(by_model.drop("model"), ["model_id", "day"], "left")
    return joined.select("model_id", "model", "day", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def model_trends(by_model: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Trend summary per active model, ranked by seven-day tokens, total and name.

    Sums over missing days are zero, so the sparse series gives the summary of the dense one.
    """
    rows = by_model.groupBy("model_id").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("day"))).alias("model"),
        *_summary_columns(_today(as_of, tz), "log"),
    )
    return _finish_summary(rows).where("active_days > 0").orderBy(
        F.desc("week_tokens"), F.desc("range_tokens"), F.coalesce("model", F.lit("")), "model_id"
    )


def select_window(series: DataFrame, as_of: str, days: int, tz: str = "UTC") -> DataFrame:
    """The last ``days`` days that are not after the reference day."""
    return series.where(_recent(_today(as_of, tz), days))


def top_models(by_model: DataFrame, as_of: str, days: int, tz: str = "UTC") -> DataFrame:
    """At most eight models by window total, last seven days and id."""
    today = _today(as_of, tz)
    return (
        by_model.where(_recent(today, days)).groupBy("model_id")
        .agg(F.sum("tokens").alias("window_tokens"), F.coalesce(F.sum(F.when(_recent(today), F.col("tokens"))), F.lit(0)).alias("week_tokens"))
        .where("window_tokens > 0")
        .orderBy(F.desc("window_tokens"), F.desc("week_tokens"), "model_id")
        .limit(VISIBLE_MODELS)
    )


def area_series(by_model: DataFrame, as_of: str, days: int, tz: str = "UTC", quality: str = "detailed") -> DataFrame:
    """Eight largest models plus one series for the rest: at most nine dense series.

    Day sums equal the sums over all models.  Cost is null for approximate usage.
    """
    today = _today(as_of, tz)
    window = by_model.where(_recent(today, days))
    # At most eight rows: the broadcast side is bounded by construction.
    top = F.broadcast(top_models(by_model, as_of, days, tz).select("model_id", F.lit(True).alias("_top")))
    measures = ["cost_usd", *TOKEN_COLUMNS]
    series = (
        window.join(top, "model_id", "left")
        .where("_top or tokens > 0")
        .withColumn("series_id", F.when(F.col("_top"), F.col("model_id")).otherwise(OTHER_MODELS))
        .groupBy("series_id", "day").agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("tokens", tok.visible_total())
    )
    calendar = F.sequence(F.date_sub(today, days - 1), today, F.expr("interval 1 day"))
    grid = series.select("series_id").distinct().select("series_id", F.explode(calendar).alias("day"))
    full = grid.join(series, ["series_id", "day"], "left")
    return full.select(
        "series_id",
        (F.col("series_id") == OTHER_MODELS).alias("is_aggregate"),
        "day",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (tok.usd(F.coalesce("cost_usd", F.lit(0))) if quality == "detailed" else F.lit(None).cast("double")).alias("cost_usd"),
    )


def metric_summary(
    dense: DataFrame, as_of: str, tz: str = "UTC", metrics: tuple[str, ...] = ("tokens", "cost_usd")
) -> DataFrame:
    """Seven days against the seven before by tokens and by cost, as doubles: one row per metric."""
    today = _today(as_of, tz)

    def amount(metric: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(metric))), F.lit(0)).cast("double")

    rows = [
        F.struct(F.lit(m).alias("metric"), amount(m, _recent(today)).alias("recent"), amount(m, _recent(today, shift=7)).alias("previous"))
        for m in metrics
    ]
    sums = dense.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    change = F.when(F.col("previous") > 0, (F.col("recent") - F.col("previous")) / F.col("previous") * 100)
    return sums.select(
        "metric",
        F.round("recent", 6).alias("recent_value"),
        F.round(F.col("recent") / 7, 6).alias("daily_average_value"),
        F.round(change, 6).alias("change_percent"),
        ((F.col("previous") <= 0) & (F.col("recent") > 0)).alias("is_new"),
    )


def model_overview(dense: DataFrame, by_model: DataFrame, as_of: str, days: int, tz: str = "UTC") -> DataFrame:
    """Top model, its tokens, active days and models, average per day: one row."""
    today = _today(as_of, tz)
    window = dense.where(_recent(today, days)).agg(
        F.count_if(F.col("tokens") > 0).alias("active_days"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_total")
    )
    top = top_models(by_model, as_of, days, tz).limit(1)
    models = by_model.where(_recent(today, days) & (F.col("tokens") > 0)).agg(F.count_distinct("model_id").alias("n"))
    return window.select(
        top.select("model_id").scalar().alias("top_model"),
        F.coalesce(top.select("window_tokens").scalar(), F.lit(0)).alias("top_model_tokens"),
        "active_days",
        F.lit(days).cast("bigint").alias("window_days"),
        models.scalar().alias("active_models"),
        F.expr(f"_total div {max(days, 1)}").alias("daily_average"),
    )
