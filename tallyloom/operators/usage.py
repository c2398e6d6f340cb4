"""Roll-ups of the usage ledger by window and by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import tokens as tok
from tallyloom.functions.times import as_instant, day_start, local_day, window_starts
from tallyloom.schemas import MONEY, TOKEN_COLUMNS

WINDOWS = ("today", "seven_day", "month", "lifetime")
TREND_DAYS = {"log": 190, "transcript": 179}


def rollup_windows(ledger: DataFrame, as_of: str, tz: str = "UTC", events: DataFrame | None = None) -> DataFrame:
    """Today, seven days, month and lifetime in one pass: one row per window.

    ``events`` has token_events per thread (``lineage.event_counts``): counter events read less the inherited ones.
    Then ``token_events`` is their sum and ``parsed_files`` the threads that have some; without it, usage rows and
    the sessions with usage are counted.
    """
    starts = window_starts(as_of, tz)
    aggs: list[Column] = [
        F.count_distinct("runtime", "thread_id").alias("parsed_files"), F.count("*").alias("token_events")
    ]
    for name in WINDOWS:
        inside = None if name == "lifetime" else F.col("ts") >= starts[name]
        aggs += tok.sum_tokens(when=inside, prefix=f"{name}_")
        aggs.append(tok.sum_cost(when=inside, name=f"{name}_cost"))
    wide = ledger.agg(*aggs)
    row = [
        F.struct(
            F.lit(name).alias("usage_window"),
            *[F.col(f"{name}_{c}").alias(c) for c in TOKEN_COLUMNS],
            F.col(f"{name}_cost").alias("cost_usd"),
        )
        for name in WINDOWS
    ]
    if events is not None:
        wide = wide.withColumns({
            "token_events": F.coalesce(events.agg(F.sum("token_events")).scalar(), F.lit(0)),
            "parsed_files": events.agg(F.count_if(F.col("token_events") > 0)).scalar(),
        })
    return wide.select("parsed_files", "token_events", F.inline(F.array(*row))).withColumn(
        "visible_tokens", tok.visible_total()
    )


def cached_windows(stats: DataFrame) -> DataFrame:
    """Totals of stats caches (``documents.parse_stats_cache``) as a window roll-up: no row without a cache.

    A cache has no split and no month, so everything counts as input, the month is the lifetime, and only these two cost.
    """
    sums = stats.agg(F.count("*").alias("parsed_files"), *(F.sum(c).alias(c) for c in ("today_tokens", "seven_day_tokens", "lifetime_tokens", "cost_usd"))).where("parsed_files > 0")
    held = {"today": "today_tokens", "seven_day": "seven_day_tokens", "month": "lifetime_tokens", "lifetime": "lifetime_tokens"}
    rows = [F.struct(F.lit(name).alias("usage_window"), F.col(c).alias("tokens"), (F.col("cost_usd") if c == "lifetime_tokens" else F.lit(0.0)).alias("cost")) for name, c in held.items()]
    zero = F.lit(0).cast("bigint")
    counts = {c: F.col("tokens") if c in ("input_tokens", "total_tokens") else zero for c in TOKEN_COLUMNS}
    return sums.select("parsed_files", F.inline(F.array(*rows))).select(
        "parsed_files", zero.alias("token_events"), "usage_window", *(v.alias(c) for c, v in counts.items()), F.col("cost").cast(MONEY).alias("cost_usd")).withColumn("visible_tokens", tok.visible_total())


def or_cached(rollup: DataFrame, stats: DataFrame) -> DataFrame:
    """The roll-up, or that of the stats caches if no usage event was found and there is a cache."""
    columns = [c for c in rollup.columns if c != "usage_window"]
    cached = cached_windows(stats).select("usage_window", F.struct(*columns).alias("cached"))
    missing = (F.col("token_events") == 0) & F.col("cached").isNotNull()
    both = rollup.join(cached, "usage_window", "left")
    return both.select(*(c if c == "usage_window" else F.when(missing, F.col(f"cached.{c}")).otherwise(F.col(c)).alias(c) for c in rollup.columns))


def daily(ledger: DataFrame, tz: str = "UTC", by: tuple[str, ...] = ()) -> DataFrame:
    """Usage per civil day and the extra keys, with the visible total."""
    return (
        ledger.groupBy(*by, local_day("ts", tz).alias("day"))
        .agg(*tok.sum_tokens(), tok.sum_cost())
        .withColumn("tokens", tok.visible_total())
    )


def daily_by_model(ledger: DataFrame, tz: str = "UTC") -> DataFrame:
    """Usage per model and day; the display name is the latest spelling seen."""
    ident = tok.model_id("model")
    named = tok.model_name("model")
    return (
        ledger.withColumn("model_id", ident)
        .groupBy("model_id", local_day("ts", tz).alias("day"))
        .agg(
            F.max_by(named, F.when(named.isNotNull(), F.struct("ts", "seq"))).alias("model"),
            *tok.sum_tokens(), tok.sum_cost(),
        )
        .withColumn("tokens", tok.visible_total())
    )


def day_spine(spark, as_of: str, days_back: int, tz: str = "UTC") -> DataFrame:
    """Every civil day from ``days_back`` days before the day of ``as_of`` to that day."""
    today = local_day(as_instant(as_of), tz)
    days = F.sequence(F.date_sub(today, days_back), today, F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def fill_days(dense: DataFrame, spine: DataFrame, measures: list[str]) -> DataFrame:
    """Left join onto the calendar, zero where nothing happened.

    The daily side has at most one row per day of the spine after the join filter.
    """
    joined = spine.join(dense, "day", "left")
    return joined.select("day", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def daily_dense(ledger: DataFrame, as_of: str, tz: str = "UTC", profile: str = "log") -> DataFrame:
    """Zero-filled daily usage of the trend range: day, tokens, cost_usd and counters."""
    back = TREND_DAYS[profile]
    today = local_day(as_instant(as_of), tz)
    recent = ledger.where(F.col("ts") >= day_start(F.date_sub(today, back), tz))
    return fill_days(
        daily(recent, tz), day_spine(ledger.sparkSession, as_of, back, tz), ["tokens", "cost_usd", *TOKEN_COLUMNS]
    )


def seven_day_strip(ledger: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Visible tokens of the seven days that end with ``as_of``."""
    today = local_day(as_instant(as_of), tz)
    recent = ledger.where(F.col("ts") >= day_start(F.date_sub(today, 6), tz))
    return fill_days(daily(recent, tz), day_spine(ledger.sparkSession, as_of, 6, tz), ["tokens"])


def seven_day_threads(threads: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """The same strip from thread totals, placed on the day of the last update."""
    today = local_day(as_instant(as_of), tz)
    recent = threads.where(F.col("updated_at") >= day_start(F.date_sub(today, 6), tz))
    per_day = recent.groupBy(local_day("updated_at", tz).alias("day")).agg(F.sum("tokens_used").alias("tokens"))
    return fill_days(per_day, day_spine(threads.sparkSession, as_of, 6, tz), ["tokens"])


def thread_totals(threads: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Approximate totals from (baseline-adjusted) thread rows: one row."""
    starts = window_starts(as_of, tz)
    updated = F.col("updated_at").isNotNull()

    def amount(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("tokens_used"))), F.lit(0))

    return threads.agg(
        amount(updated).alias("lifetime_tokens"),
        amount(F.col("updated_at") >= starts["today"]).alias("today_tokens"),
        amount(F.col("updated_at") >= starts["seven_day"]).alias("seven_day_tokens"),
        F.count("*").alias("thread_count"),
        F.max("updated_at").alias("last_updated_at"),
    )


def preferred_today(detailed: DataFrame, approximate: DataFrame) -> DataFrame:
    """Today's tokens per runtime: detailed when known, else approximate; and the sum.

    Both sides have one row per runtime: (runtime, today_tokens).
    """
    both = detailed.withColumnRenamed("today_tokens", "d").join(
        approximate.withColumnRenamed("today_tokens", "a"), "runtime", "full_outer"
    )
    per_runtime = both.select("runtime", F.coalesce("d", "a").alias("today_tokens"))
    return per_runtime.rollup("runtime").agg(
        F.coalesce(F.sum("today_tokens"), F.lit(0)).alias("today_tokens"), F.grouping("runtime").alias("_all")
    ).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("runtime")).alias("runtime"), "today_tokens")


def is_suspicious(detailed: Column, approximate: Column) -> Column:
    """Detailed usage far beyond the thread totals: by 500 M tokens and eight times."""
    return (
        (approximate >= 1_000_000)
        & (detailed - approximate >= 500_000_000)
        & (detailed.cast("double") / approximate.cast("double") >= 8)
    )


def choose_source(rollup: DataFrame, approximate: DataFrame) -> DataFrame:
    """Compare both sources for today and seven days: (usage_window, detailed, approximate, suspicious, source)."""
    approx = approximate.select(
        F.inline(
            F.array(
                F.struct(F.lit("today").alias("usage_window"), F.col("today_tokens").alias("approximate_tokens")),
                F.struct(F.lit("seven_day").alias("usage_window"), F.col("seven_day_tokens").alias("approximate_tokens")),
            )
        )
    )
    both = rollup.select("usage_window", F.col("visible_tokens").alias("detailed_tokens")).join(approx, "usage_window")
    flagged = both.withColumn("suspicious", is_suspicious(F.col("detailed_tokens"), F.col("approximate_tokens")))
    # Two rows: they are gathered once instead of evaluating both sources again for the verdict.
    pair = flagged.agg(F.collect_list(F.struct(*flagged.columns)).alias("rows"), F.bool_or("suspicious").alias("any"))
    source = F.when(F.coalesce("any", F.lit(False)), "approximate").otherwise("detailed")
    return pair.select(source.alias("source"), F.inline("rows"))


def null_tool_estimates(tools: DataFrame, choice: DataFrame) -> DataFrame:
    """Tool rows keep calls but lose estimates when detailed usage was discarded."""
    rejected = F.coalesce(choice.agg(F.bool_or("suspicious")).scalar(), F.lit(False))
    return tools.withColumns(
        {c: F.when(~rejected, F.col(c)) for c in ("estimated_tokens", "estimated_cost_usd") if c in tools.columns}
    )


def approximate_ledger(threads: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """Thread totals as a ledger on the update day, without cost: feeds the trend operators."""
    today = local_day(as_instant(as_of), tz)
    zero = F.lit(0).cast("bigint")
    return threads.where(F.col("updated_at") >= day_start(F.date_sub(today, TREND_DAYS["log"]), tz)).select(
        F.lit("log").alias("runtime"), "thread_id", F.xxhash64("thread_id").alias("seq"),
        F.col("cwd").alias("project_path"), "model", F.col("updated_at").alias("ts"),
        zero.alias("input_tokens"), zero.alias("cached_input_tokens"), zero.alias("output_tokens"),
        zero.alias("reasoning_output_tokens"), F.col("tokens_used").alias("total_tokens"),
        F.lit(0).cast("decimal(38,9)").alias("cost_usd"), F.lit("approximate").alias("source_quality"),
    )
