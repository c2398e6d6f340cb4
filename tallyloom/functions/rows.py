"""Columns that are costly to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however many expressions and filters read them.

    A filter over a plain column is pushed below it with the column's expression copied in at every mention, so a parser
    named in a filter runs many times a row.  Nothing is pushed or copied through a generator; this one gives one row for one.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
