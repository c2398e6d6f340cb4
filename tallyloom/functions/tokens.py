"""Token splits, prices and cost: native expressions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.schemas import MONEY, TOKEN_COLUMNS

# Price rules of the log runtime, first match wins.
# (how to compare, text, USD per million: uncached input, cached input, output)
LOG_PRICE_RULES = (
    ("contains", "gpt-5.5-pro", "30", "30", "180"),
    ("contains", "gpt-5.5", "5", "0.5", "30"),
    ("equals", "chat-latest", "5", "0.5", "30"),
    ("contains", "gpt-5.4-mini", "0.75", "0.075", "4.5"),
    ("contains", "gpt-5.4-nano", "0.2", "0.02", "1.25"),
    ("contains", "gpt-5.4-pro", "30", "30", "180"),
    ("contains", "gpt-5.4", "2.5", "0.25", "15"),
    ("contains", "gpt-5.3-codex", "1.75", "0.175", "14"),
    ("contains", "gpt-5.2-codex", "1.75", "0.175", "14"),
    ("contains", "gpt-5.3-chat", "1.75", "0.175", "14"),
    ("contains", "gpt-5.2", "1.75", "0.175", "14"),
    ("contains", "gpt-5-codex", "1.25", "0.125", "10"),
    ("equals", "gpt-5", "1.25", "0.125", "10"),
)
LOG_DEFAULT_PRICE = ("5", "0.5", "30")

# Price rules of the transcript runtime; no default.
TRANSCRIPT_PRICE_RULES = (
    ("contains", "opus", "15", "1.5", "75"),
    ("contains", "sonnet", "3", "0.3", "15"),
    ("contains", "haiku", "0.8", "0.08", "4"),
)

UNRECORDED_MODEL = "unrecorded-model"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---------------------------------------------------------------- token split


def billable_cached(input_tokens="input_tokens", cached="cached_input_tokens") -> Column:
    zero = F.lit(0).cast("bigint")
    return F.least(F.greatest(_col(cached), zero), F.greatest(_col(input_tokens), zero))


def uncached_input(input_tokens="input_tokens", cached="cached_input_tokens") -> Column:
    return F.greatest(F.lit(0).cast("bigint"), _col(input_tokens) - billable_cached(input_tokens, cached))


def visible_total(total="total_tokens", input_tokens="input_tokens", output="output_tokens") -> Column:
    """Apply to *summed* vectors: the maximum does not distribute over rows."""
    return F.greatest(_col(total), _col(input_tokens) + _col(output))


def split_total(input_tokens="input_tokens", cached="cached_input_tokens", output="output_tokens") -> Column:
    zero = F.lit(0).cast("bigint")
    return uncached_input(input_tokens, cached) + billable_cached(input_tokens, cached) + F.greatest(_col(output), zero)


def sum_tokens(*, when: Column | None = None, prefix: str = "") -> list[Column]:
    """Sums of the five counters, zero when nothing matches."""
    picked = [F.when(when, F.col(c)) if when is not None else F.col(c) for c in TOKEN_COLUMNS]
    return [F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(prefix + c) for v, c in zip(picked, TOKEN_COLUMNS)]


def is_zero() -> Column:
    test = F.lit(True)
    for name in TOKEN_COLUMNS:
        test = test & (F.col(name) == 0)
    return test


# --------------------------------------------------------------------- models


def model_name(model: str | Column) -> Column:
    """Trimmed name, null when blank."""
    trimmed = F.regexp_replace(_col(model), r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def model_id(model: str | Column) -> Column:
    return F.coalesce(F.lower(model_name(model)), F.lit(UNRECORDED_MODEL))


def resolve_model(turn_model: str | Column, thread_model: str | Column) -> Column:
    return F.coalesce(model_name(turn_model), model_name(thread_model))


def _rules(profile: str):
    return LOG_PRICE_RULES if profile == "log" else TRANSCRIPT_PRICE_RULES


def price_rule(model: str | Column, profile: str = "log") -> Column:
    """1-based number of the first matching rule; null when none matches."""
    name = F.lower(_col(model))
    chain = None
    for number, (how, text, *_prices) in enumerate(_rules(profile), start=1):
        hit = name.contains(text) if how == "contains" else name == text
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


def model_price(model: str | Column, part: str, profile: str = "log") -> Column:
    """USD per million tokens; ``part`` is input, cached or output."""
    where = {"input": 2, "cached": 3, "output": 4}[part]
    prices = F.array(*[F.lit(rule[where]).cast("decimal(9,3)") for rule in _rules(profile)])
    picked = F.element_at(prices, price_rule(model, profile))
    if profile == "log":
        return F.coalesce(picked, F.lit(LOG_DEFAULT_PRICE[where - 2]).cast("decimal(9,3)"))
    return picked


def with_cost(df: DataFrame, model: str = "model", profile: str = "log") -> DataFrame:
    """Add ``cost_usd``, the exact cost of the row's token vector.

    Reasoning tokens are part of the output; a model without a price costs nothing.
    The price of a model is looked up once per row, as a struct of per-token prices.
    """

    def per_token(*prices: str) -> Column:
        exact = (Decimal(p) / 1_000_000 for p in prices)
        return F.struct(*[F.lit(v).cast("decimal(12,9)").alias(n) for n, v in zip(("input", "cached", "output"), exact)])

    rules = _rules(profile)
    unmatched = LOG_DEFAULT_PRICE if profile == "log" else ("0", "0", "0")
    table = F.array(*[per_token(*rule[2:]) for rule in rules], per_token(*unmatched))
    price = F.element_at(table, F.coalesce(price_rule(model, profile), F.lit(len(rules) + 1)))

    def part(tokens: Column, kind: str) -> Column:
        return tokens.cast("decimal(19,0)") * F.col(f"_price.{kind}")

    total = (
        part(uncached_input(), "input")
        + part(billable_cached(), "cached")
        + part(F.greatest(F.col("output_tokens"), F.lit(0).cast("bigint")), "output")
    )
    return (
        df.withColumn("_price", price)
        .withColumn("cost_usd", F.coalesce(total, F.lit(0)).cast(MONEY))
        .drop("_price")
    )


def sum_cost(*, when: Column | None = None, name: str = "cost_usd") -> Column:
    value = F.when(when, F.col("cost_usd")) if when is not None else F.col("cost_usd")
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY).alias(name)


def usd(amount: str | Column) -> Column:
    """Money for a report: a double with six decimals."""
    return F.round(_col(amount), 6).cast("double")
