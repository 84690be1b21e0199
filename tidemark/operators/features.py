"""Point-in-time features of price panels, macro series, calendars and scored texts.

Columns of a price panel: symbol, ts, open, high, low, close, volume. Missing
values are null; counts and flags are true zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.operators import windows as W

# Keywords of the event families in announcement subjects.
EVENT_KEYWORDS = {
    "earnings": ["result", "financial", "dividend", "bonus", "split", "buyback", "payout"],
    "acquisition": ["acquis", "merger", "amalgamat", "stake", "takeover", "divest", "disposal", "slump sale"],
    "analyst": ["analyst", "investor meet", "con. call", "concall", "presentation", "investor day"],
    "regulatory": ["sebi", "disclosure under", "insider trading", "show-cause", "show cause", "penalty", "takeover regulations"],
}


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it doesn't or is null."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def price_features(bars: DataFrame) -> DataFrame:
    """Returns, distances from means, volatility and candle ratios."""
    c = F.col("close")
    out = bars.withColumn("ret_1", W.change(c))
    out = out.withColumns({f"ret_{w}": W.change(c, w) for w in (3, 5, 10, 20, 60)})
    out = out.withColumns({f"sma_ratio_{w}": F.try_divide(c, W.rolling_mean(c, w)) - 1 for w in (5, 10, 20, 50, 100, 200)})
    out = out.withColumns({f"volatility_{w}": W.rolling_std(F.col("ret_1"), w) * F.sqrt(F.lit(252.0)) for w in (5, 10, 20, 60)})
    mean, std = W.rolling_mean(c, 20), W.rolling_std(c, 20)
    return out.withColumns(
        {
            "range_ratio": F.try_divide(F.col("high") - F.col("low"), F.nullif(c, F.lit(0.0))),
            "body_ratio": F.try_divide(c - F.col("open"), F.nullif(F.col("open"), F.lit(0.0))),
            "gap_ratio": F.try_divide(F.col("open"), F.nullif(F.lag("close").over(W.series()), F.lit(0.0))) - 1,
            "bollinger_position": F.try_divide(c - mean, F.nullif(std * 2, F.lit(0.0))),
            "bollinger_width": F.try_divide(std * 4, F.nullif(mean, F.lit(0.0))),
        }
    )


def volume_features(bars: DataFrame) -> DataFrame:
    """Relative volume, on-balance volume, turnover and the flag of locked bars."""
    v, c = F.col("volume"), F.col("close")
    out = bars.withColumns({f"rel_volume_{w}": F.try_divide(v, F.nullif(W.rolling_mean(v, w), F.lit(0.0))) for w in (5, 20, 60)})
    out = out.withColumns({f"volume_z_{w}": W.zscore(v, w) for w in (5, 20, 60)})
    step = F.coalesce(F.signum(c - F.lag("close").over(W.series())), F.lit(0.0)) * v
    out = out.withColumn("__step", step).withColumn("obv", W.running(F.col("__step"))).drop("__step")
    out = out.withColumn("turnover", c * v / 1e7)
    return out.withColumns(
        {"obv_z20": W.zscore(F.col("obv"), 20), "turnover_z20": W.zscore(F.col("turnover"), 20), "locked": flag((c == F.col("high")) & (c == F.col("low")))}
    )


def true_range(bars: DataFrame) -> DataFrame:
    """``bars`` with true_range, the largest of the three distances that exist."""
    before = F.lag("close").over(W.series())
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def recursive_features(bars: DataFrame) -> DataFrame:
    """Exponential means of closes, MACD, RSI and average true range."""
    c = F.col("close")
    step = c - F.lag("close").over(W.series())
    prepared = true_range(bars).withColumns({"__gain": F.greatest(step, F.lit(0.0)), "__loss": F.greatest(-step, F.lit(0.0))})
    prepared = prepared.withColumns({k: F.when(step.isNotNull(), F.col(k)) for k in ("__gain", "__loss")})
    specs = {f"ema_{s}": ("close", 2 / (s + 1)) for s in (10, 12, 20, 26, 50)}
    specs |= {"__avg_gain": ("__gain", 1 / 14), "__avg_loss": ("__loss", 1 / 14), "atr_14": ("true_range", 1 / 14), "macd_signal": ("ema_12-ema_26", 2 / 10)}
    means = W.ewm_means(prepared, specs).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    ratio = F.try_divide(F.col("__avg_gain"), F.nullif(F.col("__avg_loss"), F.lit(0.0)))
    out = means.withColumns(
        {
            "macd_hist": F.col("macd") - F.col("macd_signal"),
            "rsi_14": 100 - 100 / (1 + ratio),
            "atr_pct": F.try_divide(F.col("atr_14"), F.nullif(c, F.lit(0.0))),
            **{f"ema_ratio_{s}": F.try_divide(c, F.col(f"ema_{s}")) - 1 for s in (10, 20, 50)},
        }
    )
    return out.drop("__gain", "__loss", "__avg_gain", "__avg_loss", "ema_12", "ema_26")


def lagged_publication(panel: DataFrame, published: DataFrame, values: list[str]) -> DataFrame:
    """Values of the session before, for data that is published after the close; with their z-scores and a flag of availability."""
    joined = panel.join(published.select("symbol", "ts", *values), ["symbol", "ts"], "left")
    out = joined.withColumns({f"{v}_lag1": F.lag(v).over(W.series()) for v in values})
    return out.withColumns(
        {f"{v}_z20": W.zscore(F.col(f"{v}_lag1"), 20) for v in values} | {f"{v}_available": flag(F.col(f"{v}_lag1").isNotNull()) for v in values}
    ).drop(*values)


def macro_features(panel: DataFrame, macro: DataFrame, columns: list[str], index: str | None = None) -> DataFrame:
    """Macro series on each symbol's sessions: matched by exact date, carried forward, and shifted by one session.

    A macro date that is no session of the symbol is lost, not carried. With an
    ``index`` among the columns, asset_minus_index_ret20 is the symbol's return
    over twenty sessions less the index's, a session late as well.
    """
    joined = panel.join(macro.select("ts", *columns), "ts", "left")
    filled = joined.withColumns({c: W.forward_fill(F.col(c)) for c in columns})
    filled = filled.withColumns({f"__{c}_step": W.change(F.col(c)) for c in columns})
    derived = {}
    for c in columns:
        x = F.col(c)
        derived |= {f"__{c}": x, f"__{c}_ret5": W.change(x, 5), f"__{c}_ret20": W.change(x, 20), f"__{c}_z60": W.zscore(x, 60, 20), f"__{c}_vol20": W.rolling_std(F.col(f"__{c}_step"), 20)}
    if index:
        derived["__asset_minus_index_ret20"] = W.change(F.col("close"), 20) - W.change(F.col(index), 20)
    staged = filled.withColumns(derived)
    lag = {name[2:] + "_lag1": F.lag(name).over(W.series()) for name in derived}
    return staged.withColumns(lag).drop(*derived, *columns, *[f"__{c}_step" for c in columns])


def regime_features(panel: DataFrame, level: str) -> DataFrame:
    """Regimes of a level, a session late: above its trailing third quartile, above its trailing mean, and its five-session return.

    The high regime of the first session is unknown, the bull regime is 0 there.
    """
    x = F.col(level)
    out = panel.withColumns(
        {
            "__high": flag(x > W.rolling_quantile(x, 252, 0.75, 60)),
            "__bull": flag(x > W.rolling_mean(x, 200, 60)),
            "__chg": W.change(x, 5),
        }
    )
    late = lambda c: F.lag(c).over(W.series())
    return out.withColumns({f"{level}_high_regime": late("__high"), f"{level}_bull_regime": F.coalesce(late("__bull"), F.lit(0.0)), f"{level}_change_5": late("__chg")}).drop("__high", "__bull", "__chg")


def expiry_week(panel: DataFrame, weekday: int = 3) -> DataFrame:
    """1.0 on days at most four days before the month's last row of ``weekday`` (Monday is 0) that the symbol has; else 0.0."""
    month = F.trunc("ts", "month")
    last = F.max(F.when(F.weekday("ts") == weekday, F.col("ts"))).over(Window.partitionBy("symbol", month))
    ahead = F.min(F.when(F.col("__exp") >= F.col("ts"), F.col("__exp"))).over(W.series().rowsBetween(0, Window.unboundedFollowing))
    return panel.withColumn("__exp", last).withColumn("__next", ahead).withColumn("expiry_week", flag(F.datediff("__next", "ts").between(0, 4))).drop("__exp", "__next")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Month, quarter, ISO week, weekday (Monday is 0), circles of month and quarter, fiscal quarter and year (from April), bounds, and the months in which results come."""
    d = F.col(ts)
    month, quarter = F.month(d), F.quarter(d)
    return df.withColumns(
        {
            "calendar_month": month,
            "calendar_quarter": quarter,
            "calendar_weekofyear": F.weekofyear(d),
            "calendar_dayofweek": F.weekday(d),
            "calendar_month_sin": F.sin(2 * F.pi() * month / 12),
            "calendar_month_cos": F.cos(2 * F.pi() * month / 12),
            "calendar_quarter_sin": F.sin(2 * F.pi() * quarter / 4),
            "calendar_quarter_cos": F.cos(2 * F.pi() * quarter / 4),
            "fiscal_quarter": F.quarter(F.add_months(d, -3)),
            "fiscal_year": F.year(F.add_months(d, 9)),
            "days_to_month_end": F.datediff(F.last_day(d), d),
            "is_quarter_end": ((d == F.last_day(d)) & (month % 3 == 0)).cast("int"),
            "is_month_end": (d == F.last_day(d)).cast("int"),
            "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
            "earnings_season_proxy": (month % 3 == 1).cast("int"),
        }
    )


# Columns that trend by nature, and marks of transformed macro columns that don't.
LEVEL_COLUMNS = ["open", "high", "low", "close", "adj_close", "adjclose", "volume", "obv", "turnover_cr_proxy", "turnover_lacs", "no_trades", "ttl_qty", "delivery_qty"]
MACRO_MARKS = ["_ret", "_z", "_vol", "_regime", "_change", "asset_minus"]


def drift_columns(df: DataFrame) -> list[str]:
    """Numeric columns that can drift: no levels, no calendar, no raw macro levels."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    clock = lambda c: c.startswith(("calendar_", "fiscal_", "is_month_", "is_quarter_")) or c in ("days_to_month_end", "earnings_season_proxy")
    raw = lambda c: c.startswith("macro_") and not any(m in c for m in MACRO_MARKS)
    return [c for c in numeric if not (c.lower() in LEVEL_COLUMNS or clock(c.lower()) or raw(c))]


def rank_features(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Percentile rank of each column across the symbols of a session."""
    return panel.withColumns({f"{c}_xs_rank": W.percentile_rank(F.col(c), "ts") for c in columns})


def bucket_features(panel: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """Distance from the bucket's mean, rank and deviation within it, by session; null without a bucket."""
    part = Window.partitionBy("ts", bucket)
    inside = F.col(bucket).isNotNull()
    out = {}
    for c in columns:
        out[f"{c}_vs_{bucket}"] = F.when(inside, F.col(c) - F.avg(c).over(part))
        out[f"{c}_{bucket}_rank"] = F.when(inside, W.percentile_rank(F.col(c), "ts", bucket))
        out[f"{c}_{bucket}_std"] = F.when(inside, F.stddev_samp(c).over(part))
    return panel.withColumns(out)


def event_flags(subject: Column) -> dict[str, Column]:
    """Whether any keyword of a family is in the subject, by family."""
    low = F.lower(F.coalesce(subject, F.lit("")))
    out = {}
    for family, words in EVENT_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out[f"event_{family}"] = hit.cast("double")
    return out


def announcement_features(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Announcements by decision date on the sessions of ``grid`` (symbol, ts): counts, trailing sums, recency, event flags, coverage.

    ``events`` has (symbol, decision_date, subject). Counts are 0 on quiet
    days; days_since_last is null before the first announcement.
    """
    flagged = events.select("symbol", F.col("decision_date").alias("ts"), *[c.alias(n) for n, c in event_flags(F.col("subject")).items()])
    names = [f"event_{f}" for f in EVENT_KEYWORDS]
    daily = flagged.groupBy("symbol", "ts").agg(F.count(F.lit(1)).cast("double").alias("ann_count"), *[F.max(n).alias(n) for n in names])
    joined = grid.join(daily, ["symbol", "ts"], "left").fillna(0.0, ["ann_count", *names])
    seen = W.forward_fill(F.when(F.col("ann_count") > 0, F.col("ts")))
    return joined.withColumns(
        {
            "ann_count_5d": F.sum("ann_count").over(W.trailing(5)),
            "ann_count_20d": F.sum("ann_count").over(W.trailing(20)),
            "days_since_last_ann": F.datediff("ts", seen).cast("double"),
            "ann_available": flag(F.sum("ann_count").over(W.trailing(252)) > 0),
        }
    )


def scored_text_features(grid: DataFrame, scored: DataFrame, prefix: str, score: str = "score") -> DataFrame:
    """Scored texts by decision date on the sessions of ``grid``: count, mean, z-score, shock, trailing sums, coverage.

    Counts are 0 on quiet days; means, z-scores and shocks are null there.
    """
    daily = scored.groupBy("symbol", F.col("decision_date").alias("ts")).agg(F.count(score).cast("double").alias(f"{prefix}_count"), F.avg(score).alias(f"{prefix}_mean"))
    joined = grid.join(daily, ["symbol", "ts"], "left").fillna(0.0, [f"{prefix}_count"])
    mean, n = F.col(f"{prefix}_mean"), F.col(f"{prefix}_count")
    return joined.withColumns(
        {
            f"{prefix}_z20": W.zscore(mean, 20, 5),
            f"{prefix}_shock": mean - W.rolling_mean(mean, 20, 5),
            f"{prefix}_count_5d": F.sum(n).over(W.trailing(5)),
            f"{prefix}_count_20d": F.sum(n).over(W.trailing(20)),
            f"{prefix}_available": flag(n > 0),
            f"{prefix}_coverage_60": flag(F.sum(n).over(W.trailing(60)) > 0),
        }
    )


def news_day_features(grid: DataFrame, news: DataFrame) -> DataFrame:
    """News grouped on the UTC day, 0 where there is none, with trailing figures shifted by one session.

    ``news`` has (symbol, ts date, article_id, source, title, sentiment,
    relevance). news_count, news_sources, news_positive and news_negative
    stay on their own day.
    """
    s = F.col("sentiment")
    daily = news.groupBy("symbol", "ts").agg(
        F.count_distinct("article_id").cast("double").alias("news_count"), F.count_distinct("source").cast("double").alias("news_sources"),
        F.avg(s).alias("news_mean"), F.stddev_samp(s).alias("news_std"), F.count_if(s > 0).cast("double").alias("news_positive"), F.count_if(s < 0).cast("double").alias("news_negative"),
        F.avg("relevance").alias("news_relevance"), F.avg(F.length("title")).alias("news_headline_length"),
    )
    names = [c for c in daily.columns if c not in ("symbol", "ts")]
    joined = grid.join(daily, ["symbol", "ts"], "left").fillna(0.0, names)
    ws = (1, 3, 5, 10, 20)
    staged = joined.withColumns(
        {f"__n{w}": F.sum("news_count").over(W.trailing(w)) for w in ws}
        | {f"__m{w}": F.avg("news_mean").over(W.trailing(w)) for w in ws}
        | {f"__p{w}": F.sum("news_positive").over(W.trailing(w)) for w in ws}
    )
    late = lambda c: F.coalesce(F.lag(c).over(W.series()), F.lit(0.0))
    out = staged.withColumns(
        {f"news_count_{w}d": late(F.col(f"__n{w}")) for w in ws}
        | {f"news_mean_{w}d": late(F.col(f"__m{w}")) for w in ws}
        | {f"news_positive_ratio_{w}d": late(F.coalesce(F.try_divide(F.col(f"__p{w}"), F.nullif(F.col(f"__n{w}"), F.lit(0.0))), F.lit(0.0))) for w in ws}
    )
    return out.drop(*[f"__{k}{w}" for k in "nmp" for w in ws])


def market_features(scored: DataFrame, sessions: DataFrame) -> DataFrame:
    """Texts of all symbols by decision date: count, mean score and its z-score over sessions."""
    daily = scored.groupBy(F.col("decision_date").alias("ts")).agg(F.count("score").cast("double").alias("market_count"), F.avg("score").alias("market_mean"))
    # One row a session: a calendar is small by nature, so a single ordered partition is enough.
    joined = sessions.select(F.col("session").alias("ts")).join(daily, "ts", "left").fillna(0.0, ["market_count"]).withColumn("symbol", F.lit("*"))
    return joined.withColumn("market_z20", W.zscore(F.col("market_mean"), 20, 5)).drop("symbol")


def complete_rows(df: DataFrame, features: list[str], may_miss: list[str]) -> DataFrame:
    """Rows whose features are all finite, except those of ``may_miss``; infinities and NaN become null."""
    clean = df.withColumns({c: W.finite(F.col(c)) for c in features})
    return clean.na.drop(subset=[c for c in features if c not in may_miss])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (K n) for each of K classes."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_of = whole(counts, total=F.sum("n"), k=F.count(F.lit(1)))
    return counts.select(label, "n", (all_of["total"] / (all_of["k"] * F.col("n"))).alias("weight"))
