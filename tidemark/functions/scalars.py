"""Aggregates over a whole table as values for every row of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame, **aggregates: Column) -> Column:
    """Struct of ``aggregates`` over all rows of ``df``: a scalar subquery, so one row that is never joined."""
    return df.agg(F.struct(*[c.alias(name) for name, c in aggregates.items()]).alias("whole")).scalar()
