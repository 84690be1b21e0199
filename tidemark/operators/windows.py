"""Window algebra of panels: row frames with a minimum of values, ranks, fills and recursive means.

All frames of one entity share one specification, so Catalyst plans one sort for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def series(entity: str = "symbol", ts: str = "ts") -> WindowSpec:
    """Rows of an entity in time order."""
    return Window.partitionBy(entity).orderBy(ts)


def trailing(n: int, entity: str = "symbol", ts: str = "ts") -> WindowSpec:
    """The row and the n - 1 rows before it."""
    return series(entity, ts).rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column, at_least: int | None = None, entity: str = "symbol", ts: str = "ts") -> Column:
    """``value`` where the last n rows have ``at_least`` (default n) values of ``x``, else null."""
    return F.when(F.count(x).over(trailing(n, entity, ts)) >= (at_least or n), value)


def rolling_mean(x: Column, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.avg(x).over(trailing(n)), at_least)


def rolling_std(x: Column, n: int, at_least: int | None = None) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    return full(x, n, F.stddev_samp(x).over(trailing(n)), at_least)


def rolling_sum(x: Column, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.sum(x).over(trailing(n)), at_least)


def rolling_quantile(x: Column, n: int, q: float, at_least: int | None = None) -> Column:
    """Exact quantile with linear interpolation over a row frame."""
    return full(x, n, F.percentile(x, F.lit(q)).over(trailing(n)), at_least)


def zscore(x: Column, n: int, at_least: int | None = None) -> Column:
    """Distance from the rolling mean in sample deviations; null where they are 0."""
    return F.try_divide(x - rolling_mean(x, n, at_least), F.nullif(rolling_std(x, n, at_least), F.lit(0.0)))


def change(x: Column, w: int = 1) -> Column:
    """x / x[-w] - 1; null without such a row or where it is 0."""
    return F.try_divide(x, F.lag(x, w).over(series())) - 1


def running(x: Column, how=F.sum) -> Column:
    return how(x).over(series().rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(x: Column, entity: str = "symbol", ts: str = "ts") -> Column:
    """The latest value that is not null up to the row."""
    return F.last(x, ignorenulls=True).over(series(entity, ts).rowsBetween(Window.unboundedPreceding, 0))


def percentile_rank(x: Column, *partition: str) -> Column:
    """Average-tie rank over the number of values in the partition, in (0, 1]; null gives null."""
    part = [F.col(p) for p in partition]
    rank = F.rank().over(Window.partitionBy(*part).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*part, x))
    n = F.count(x).over(Window.partitionBy(*part))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / n)


def finite(x: Column) -> Column:
    """``x`` without NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, float]], entity: str = "symbol", ts: str = "ts") -> DataFrame:
    """``df`` with recursive means y = a x + (1 - a) y[-1], starting at the first value.

    ``specs`` maps an output column to (input column, a). A null input keeps
    the mean and decays its weight, as the recursion over positions does; rows
    before the first value are null. An input may be the difference of two
    outputs before it, written ``"a-b"``. Only time and inputs go to Python,
    once, where the recursion is compiled; an entity's series is one group, as
    long as it has sessions, and its rows are joined back by position.
    """
    sources = list(dict.fromkeys(s for s, _ in specs.values() if "-" not in s))
    placed = df.withColumn("__at", F.row_number().over(series(entity, ts)))
    schema = T.StructType([df.schema[entity], T.StructField("__at", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in specs]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        out = {entity: pdf[entity].to_numpy(), "__at": pdf["__at"].to_numpy()}
        for name, (source, alpha) in specs.items():
            a, _, b = source.partition("-")
            x = pd.Series(out[a] - out[b] if b else pdf[source].to_numpy(dtype=float, na_value=np.nan))
            out[name] = x.ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()
        return pd.DataFrame(out)

    means = placed.select(entity, "__at", *sources).groupBy(entity).applyInPandas(run, schema)
    return placed.join(means, [entity, "__at"], "left").drop("__at")


def fractional_weights(d: float, threshold: float = 1e-5, most: int = 200) -> list[float]:
    """Binomial weights of a fractional difference, up to the first one below ``threshold``."""
    k = np.arange(1, most)
    weights = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])  # the coefficients of (1 - x) ** d
    small = np.flatnonzero(np.abs(weights) < threshold)
    return weights[: small[0] + 1 if len(small) else most].tolist()


def fractional_difference(x: Column, weights: Iterable[float]) -> Column:
    """Sum of weights[k] * x[-k] where all those rows have values."""
    weights = list(weights)
    rows = trailing(len(weights))
    newest_first = F.reverse(F.collect_list(x).over(rows))
    dot = F.aggregate(F.zip_with(newest_first, F.array(*map(F.lit, weights)), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.count(x).over(rows) == len(weights), dot)
