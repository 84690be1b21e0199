"""Totals and averages over trailing calendar periods.

Each entity gets a row for every calendar day between its first and its last
row. Prefix sums run over those days; days without a row carry the prefix of
the day before. A trailing total is the difference of two prefixes, so windows
of any length cost the same and share one sort.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes are decimals, so that differences are exact and don't depend on the order of sums.
EXACT = "decimal(38,18)"
#: Values from here on have no place in those decimals and are summed window by window, as doubles.
LARGE = 1e12


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _has_large(panel: DataFrame, measures: list[str]) -> bool:
    """Whether any value is large: a filter that Parquet answers from its statistics, so that nothing is read where none is."""
    large = [(F.col(m) >= LARGE) | (F.col(m) <= -LARGE) for m in measures]
    return not panel.select(*measures).where(functools.reduce(operator.or_, large)).isEmpty()


def latest_rows(panel: DataFrame, keys: list[str], updated: str, values: list[str]) -> DataFrame:
    """One row for each key: that with the latest ``updated`` (null counts as earliest), ties by the largest values.

    A maximum, hence combined before the shuffle, however many rows repeat a key.
    """
    newest = F.max(F.struct(F.col(updated), *[F.col(v) for v in values])).alias("__newest")
    chosen = panel.where(F.greatest(*[F.col(k).isNotNull().cast("int") for k in keys]) == 1).groupBy(*keys).agg(newest)
    return chosen.select(*keys, *[F.col(f"__newest.{v}").alias(v) for v in values])


def trailing_totals(
    panel: DataFrame,
    measures: list[str],
    windows: list[int],
    entity: str = "symbol",
    day: str = "ts",
    updated: str = "updated_at",
) -> DataFrame:
    """(entity, cal_day date, then for each window and measure total, obs and avg).

    For measure m and window w: ``m_total_w`` sums the non-null values of the
    day and the w - 1 days before, ``m_obs_w`` counts them, ``m_avg_w`` is the
    mean over the days of the window since the entity's first row (days without
    a row count with 0). Of several rows with one (entity, day) the latest
    ``updated`` counts; null and NaN values are 0. Days before the first row add
    nothing, and neither do infinities. Rows without entity or day are left out.
    Values below 1e12 are exact to eighteen decimals, since prefixes are
    decimals; larger ones, if there are any, are summed as doubles over each
    window by itself, so that no difference of large prefixes loses digits.
    """
    rows = panel.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        F.col(entity).alias("__entity"), F.col(day).cast("date").alias("cal_day"), F.col(updated).alias("__updated"), *[_finite(F.col(m)).alias(m) for m in measures]
    )
    with_large = _has_large(panel, measures)
    rows = latest_rows(rows, ["__entity", "cal_day"], "__updated", measures)
    in_order = Window.partitionBy("__entity").orderBy("cal_day")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    sessions = rows.select(
        "__entity",
        "cal_day",
        F.coalesce(F.lead("cal_day").over(in_order), F.date_add("cal_day", 1)).alias("__next"),
        F.min("cal_day").over(so_far).alias("__first"),
        *[F.coalesce(F.sum(F.when(F.abs(m) < LARGE, F.col(m).cast("decimal(30,18)"))).over(so_far), F.lit(0)).cast(EXACT).alias(f"__p_{m}") for m in measures],
        *[F.when(F.abs(m) >= LARGE, F.col(m)).alias(f"__l_{m}") for m in measures if with_large],
        *[F.count(m).over(so_far).alias(f"__n_{m}") for m in measures],
    )
    # The prefix of a session holds until the day before the next one: that is the forward fill.
    days = sessions.select("*", F.explode(F.sequence("cal_day", F.date_sub("__next", 1))).alias("__day"))
    if with_large:
        days = days.withColumns({f"__l_{m}": F.when(F.col("__day") == F.col("cal_day"), F.col(f"__l_{m}")) for m in measures})
    days = days.drop("cal_day").withColumnRenamed("__day", "cal_day")
    out = [F.col("__entity").alias(entity), F.col("cal_day")]
    for w in windows:
        elapsed = F.least(F.lit(w), F.datediff("cal_day", "__first") + 1)
        for m in measures:
            total = (F.col(f"__p_{m}") - F.coalesce(F.lag(f"__p_{m}", w).over(in_order), F.lit(0))).cast("double")
            if with_large:
                total = total + F.coalesce(F.sum(f"__l_{m}").over(in_order.rowsBetween(-(w - 1), 0)), F.lit(0.0))
            seen = F.col(f"__n_{m}") - F.coalesce(F.lag(f"__n_{m}", w).over(in_order), F.lit(0))
            out += [
                total.alias(f"{m}_total_{w}"),
                seen.cast("long").alias(f"{m}_obs_{w}"),
                (total / elapsed).alias(f"{m}_avg_{w}"),
            ]
    return days.select(*out)


def idle_days(panel: DataFrame, measure: str = "news_count", windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(symbol, cal_day string, window_days) of the days whose trailing total of ``measure`` is 0."""
    totals = trailing_totals(panel, [measure], list(windows))
    pairs = F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"{measure}_total_{w}").alias("total")) for w in windows])
    flat = totals.select("symbol", F.date_format("cal_day", "yyyy-MM-dd").alias("cal_day"), F.explode(pairs).alias("w"))
    return flat.where(F.col("w.total") == 0).select("symbol", "cal_day", "w.window_days")
