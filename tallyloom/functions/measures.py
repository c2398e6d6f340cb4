"""Text size, percentages and progress scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges counted as one token per character.
WIDE_RANGES = ("\\x{4E00}-\\x{9FFF}", "\\x{3400}-\\x{4DBF}", "\\x{3040}-\\x{30FF}", "\\x{AC00}-\\x{D7AF}")

# Subscription milestones in USD, and the monthly ceiling
# (200 million tokens a day, 30 days, blended price of the default model).
MILESTONES = (20, 100, 200)
VALUE_CEILING = 200 * 30 * (0.30 * 5 + 0.50 * 0.5 + 0.20 * 30)
MILESTONE_BAND = 0.28

_SPACE = r"[\p{Z}\t\n\x{0B}\f\r\x{85}]"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_tokens(text: str | Column) -> Column:
    """Static token estimate: wide characters count 1, other visible ones 1/3.8."""
    raw = _col(text)
    # Plain ASCII has no wide characters and only six blanks; the patterns run on other texts alone.
    plain = F.octet_length(raw) == F.char_length(raw)
    visible = F.when(plain, F.translate(raw, " \t\n\x0b\f\r", "")).otherwise(F.regexp_replace(raw, _SPACE, ""))
    seen = F.char_length(visible)
    narrow = F.when(plain, seen).otherwise(F.char_length(F.regexp_replace(visible, "[" + "".join(WIDE_RANGES) + "]", "")))
    wide = seen - narrow
    estimate = F.ceil(narrow / F.lit(3.8) + wide).cast("bigint")
    return F.when(raw == "", F.lit(0).cast("bigint")).otherwise(F.greatest(estimate, F.lit(1).cast("bigint")))


def remaining_percent(used: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - _col(used)))


def value_fraction(cost: str | Column) -> Column:
    """Linear over the milestones, then logarithmic up to the ceiling; 0..1."""
    top = float(MILESTONES[-1])
    amount = F.greatest(F.lit(0.0), F.least(_col(cost).cast("double"), F.lit(float(VALUE_CEILING))))
    tail = F.log1p((amount - top) / top) / F.lit(math.log1p((VALUE_CEILING - top) / top))
    return F.when(amount <= top, MILESTONE_BAND * (amount / top)).otherwise(
        MILESTONE_BAND + (1 - MILESTONE_BAND) * tail
    )


def milestone(cost: str | Column) -> Column:
    """Highest milestone reached, null below the first."""
    value = _col(cost).cast("double")
    chain = None
    for amount in reversed(MILESTONES):
        chain = F.when(value >= amount, amount) if chain is None else chain.when(value >= amount, amount)
    return chain.cast("bigint")


def bar_ratio(value: str | Column, largest: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(value).cast("double") / F.greatest(largest, F.lit(1))))
