"""Helpers by which a query and its SQL give comparable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 7
#: Added before values are cut to ``DIGITS``: data with few decimals have many means just at a half, none at this.
OFFSET = 0.31830989


def rounded(df: DataFrame) -> DataFrame:
    """``df`` with doubles brought to the nearest steps below, and no negative zero."""
    step = 10**DIGITS
    cut = lambda c: F.floor(F.col(f"`{c}`") * float(step) + OFFSET).cast("double") / float(step) + F.lit(0.0)
    return df.select(*[cut(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def sql(ctes: list[str], body: str, keys: list[str], values: list[str] = ()) -> str:
    """SELECT of ``keys`` and of ``values``, rounded, from ``body`` under the ``ctes``."""
    columns = ", ".join([f'"{k}"' for k in keys] + [f'floor(CAST("{v}" AS DOUBLE) * {float(10**DIGITS)} + {OFFSET}) / {float(10**DIGITS)} + 0.0 AS "{v}"' for v in values])
    head = "WITH " + ", ".join(ctes) + " " if ctes else ""
    return f"{head}SELECT {columns} FROM ({body}) q"
