"""Behaviour panels and slice studies of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.operators.quality import quantile_bucket


def with_era(rows: DataFrame, ts: str = "ts", eras: int = 4) -> DataFrame:
    """``rows`` with era: which of the quantile bins (lo, hi] of time they are in."""
    timed = rows.withColumn("__t", F.unix_date(ts).cast("double"))
    return quantile_bucket(timed, "__t", eras, "era").drop("__t")


def slice_miss_rates(rows: DataFrame, slice_by: Column, label: int = 2, least: int = 200) -> DataFrame:
    """(slice, era, n, miss_rate, reliable): how often rows of a class are missed, by slice overall (era null) and by era.

    One pass over grouping sets; a null slice is one of its own.
    """
    base = with_era(rows.where(F.col("actual") == label)).select(slice_by.alias("slice"), "era", (F.col("predicted") != label).cast("double").alias("miss"))
    g = base.groupingSets([["slice"], ["slice", "era"]], "slice", "era").agg(F.count(F.lit(1)).alias("n"), F.avg("miss").alias("miss_rate"))
    return g.withColumn("reliable", F.col("n") >= least)


def stable_slices(rates: DataFrame, spread: float = 0.25) -> DataFrame:
    """(slice, n_eras, spread, stable) over the reliable eras of a slice."""
    by_era = rates.where("era is not null and reliable").groupBy("slice").agg(F.count(F.lit(1)).alias("n_eras"), (F.max("miss_rate") - F.min("miss_rate")).alias("spread"))
    return by_era.withColumn("stable", (F.col("n_eras") >= 3) & (F.col("spread") < spread))


def class_cells(rows: DataFrame, label: int = 2) -> DataFrame:
    """(predicted, n, p_down, p_flat, p_up): where rows of a class go, with mean probabilities."""
    return rows.where(F.col("actual") == label).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in ("p_down", "p_flat", "p_up")])


def worst_misses(rows: DataFrame, k: int, label: int = 2) -> DataFrame:
    """The k rows of a class that were missed with the largest probability of another."""
    wrong = F.greatest(*[F.col(p) for c, p in enumerate(("p_down", "p_flat", "p_up")) if c != label])
    missed = rows.where((F.col("actual") == label) & (F.col("predicted") != label)).withColumn("confidence", wrong)
    return missed.orderBy(F.desc("confidence"), "id").limit(k).select("id", "symbol", "ts", "predicted", "confidence")


def prediction_bias(rows: DataFrame) -> DataFrame:
    """(class, actual_share, predicted_share, bias_pp)."""
    flat = rows.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    g = flat.groupBy("class").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    n = F.sum("a").over(Window.partitionBy())
    return g.select("class", (F.col("a") / n).alias("actual_share"), (F.col("p") / n).alias("predicted_share"), ((F.col("p") - F.col("a")) / n * 100).alias("bias_pp"))


def separation(rows: DataFrame) -> DataFrame:
    """(separation): mean total variation between the mean probability vectors of the three true classes; one row."""
    names = ["p_down", "p_flat", "p_up"]
    means = rows.agg(*[F.avg(F.when(F.col("actual") == c, F.col(p))).alias(f"m{c}_{p}") for c in range(3) for p in names])
    tv = lambda a, b: sum((F.abs(F.col(f"m{a}_{p}") - F.col(f"m{b}_{p}")) for p in names), F.lit(0.0)) / 2
    return means.select(((tv(0, 1) + tv(0, 2) + tv(1, 2)) / 3).alias("separation"))


def conviction(rows: DataFrame) -> DataFrame:
    """(predicted, n, mean_top, share_below_half, median_margin): how sure the model is by predicted class."""
    ordered = F.sort_array(F.array("p_down", "p_flat", "p_up"), asc=False)
    x = rows.select("predicted", ordered[0].alias("top"), (ordered[0] - ordered[1]).alias("margin"))
    return x.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.avg("top").alias("mean_top"), F.avg((F.col("top") < 0.5).cast("double")).alias("share_below_half"), F.percentile("margin", F.lit(0.5)).alias("median_margin"))


def rolling_daily(rows: DataFrame, n: int = 30) -> DataFrame:
    """(ts, accuracy, rolling): mean of the last n dates' accuracies. One row a date: a single ordered partition is enough."""
    d = rows.groupBy("ts").agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    return d.withColumn("rolling", F.avg("accuracy").over(Window.orderBy("ts").rowsBetween(-(n - 1), 0)))


def leaders(panel: DataFrame, bucket: str, size: str, share: float = 0.8) -> DataFrame:
    """``panel`` with leader: whether ``size`` is at or above the bucket's quantile; null without a bucket."""
    cut = F.percentile(size, F.lit(share)).over(Window.partitionBy(bucket))
    return panel.withColumn("leader", F.when(F.col(bucket).isNotNull(), F.col(size) >= cut))


def lead_lag(panel: DataFrame, bucket: str, value: str) -> DataFrame:
    """Laggards with the mean ``value`` of their bucket's leaders on the session before."""
    lead = panel.where("leader").groupBy(bucket, "ts").agg(F.avg(value).alias("m"))
    days = panel.select("ts").distinct()
    # One row a session.
    previous = days.withColumn("prev", F.lag("ts").over(Window.orderBy("ts")))
    late = lead.join(previous.select(F.col("ts").alias("day"), F.col("prev").alias("ts")), "ts").select(bucket, F.col("day").alias("ts"), F.col("m").alias("leaders_before"))
    return panel.where("not leader").join(late, [bucket, "ts"], "left")


def proximity(days: Column) -> Column:
    """Bucket of the number of days since an event."""
    return F.when(days <= 5, "0-5").when(days <= 10, "6-10").when(days <= 20, "11-20").when(days.isNotNull(), "21+").otherwise("none")


def overfitting(daily: DataFrame, strategies: list[str], blocks: int = 16, splits: int = 500, seed: int = 7) -> DataFrame:
    """(n_splits, pbo): share of half-splits of the days in which the strategy that is best inside ranks below the median outside.

    ``daily`` has a column of returns for each strategy, one row a day. Blocks are
    contiguous and have twenty days at least, so short series have fewer; each
    split takes half of them, drawn with a fixed seed, and the mean of their
    Sharpe ratios. Null for fewer than two strategies or four blocks.
    """
    import random

    n = daily.count()
    blocks = min(blocks, n // 20)
    if len(strategies) < 2 or blocks < 4:
        return daily.sparkSession.createDataFrame([(0, None)], "n_splits int, pbo double")
    pos = daily.withColumn("__b", F.floor((F.row_number().over(Window.orderBy("day")) - 1) * blocks / n).cast("int"))
    sums = {r["__b"]: r for r in pos.groupBy("__b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s_{s}") for s in strategies], *[F.sum(F.col(s) * F.col(s)).alias(f"q_{s}") for s in strategies]).collect()}

    def block_sharpe(b: int, s: str) -> float:
        mean = sums[b][f"s_{s}"] / sums[b]["n"]
        var = sums[b][f"q_{s}"] / sums[b]["n"] - mean * mean
        return mean / var**0.5 if var > 1e-18 else 0.0

    by_block = {s: [block_sharpe(b, s) for b in range(blocks)] for s in strategies}

    def sharpe(chosen: list[int], s: str) -> float:
        return sum(by_block[s][b] for b in chosen) / len(chosen)

    rng, below = random.Random(seed), 0
    for _ in range(splits):
        inside = sorted(rng.sample(range(blocks), blocks // 2))
        outside = [b for b in range(blocks) if b not in inside]
        best = max(strategies, key=lambda s: sharpe(inside, s))
        out = {s: sharpe(outside, s) for s in strategies}
        rank = (sum(v < out[best] for v in out.values()) + 0.5 * (sum(v == out[best] for v in out.values()) - 1)) / (len(strategies) - 1)
        below += rank < 0.5
    return daily.sparkSession.createDataFrame([(splits, below / splits)], "n_splits int, pbo double")


def sentiment_context(grid: DataFrame, scored: DataFrame) -> DataFrame:
    """``grid`` (symbol, ts) with mean, max, min and count of the day's scores, and the sign of their mean; none without any."""
    daily = scored.groupBy("symbol", F.col("decision_date").alias("ts")).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.count("score").alias("n"))
    sign = F.when(F.col("mean") > 0, "positive").when(F.col("mean") < 0, "negative").when(F.col("mean") == 0, "neutral").otherwise("none")
    return grid.join(daily, ["symbol", "ts"], "left").fillna(0, ["n"]).withColumn("sign", sign)


def conviction_bins(rows: DataFrame, edges: list[float]) -> DataFrame:
    """(predicted, bucket, n): top probability by bucket [lo, hi) and predicted class."""
    from tidemark.operators.quality import bucket_of, top_probability

    return rows.groupBy("predicted", bucket_of(top_probability(), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def prediction_mode(rows: DataFrame, floor: float = 0.05) -> DataFrame:
    """(class, actual_share, predicted_share, state): starved and over-produced classes, against half and twice the true share."""
    b = prediction_bias(rows)
    state = F.when((F.col("predicted_share") < F.col("actual_share") / 2) | (F.col("predicted_share") < floor), "starved").when(F.col("predicted_share") > 2 * F.col("actual_share"), "over-produced").otherwise("normal")
    return b.withColumn("state", state).drop("bias_pp")


def fallback_share(rows: DataFrame, tau: float) -> DataFrame:
    """(n_down, share_below): how many DOWN predictions have a probability below ``tau``."""
    return rows.where("predicted = 0").agg(F.count(F.lit(1)).alias("n_down"), F.avg((F.col("p_down") < tau).cast("double")).alias("share_below"))


def case_pool(cases: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, ts, trend5, volume_z): five-row trend and volume against the twenty rows before, of the cases' sessions; null with fewer rows."""
    from tidemark.operators import windows as W

    w = W.series()
    prior = w.rowsBetween(-20, -1)
    n = F.row_number().over(w)
    b = bars.select(
        "symbol", "ts", F.when(n > 5, F.try_divide("close", F.nullif(F.lag("close", 5).over(w), F.lit(0.0))) - 1).alias("trend5"),
        F.when(n > 20, F.try_divide(F.col("volume") - F.avg("volume").over(prior), F.nullif(F.stddev_samp("volume").over(prior), F.lit(0.0)))).alias("volume_z"),
    )
    return cases.join(b, ["symbol", "ts"], "left")


def united_cases(sources: list[DataFrame]) -> DataFrame:
    """Cases (symbol, decision_date, text) of several sources with ``case_id`` = symbol|date|hash, each once."""
    out = None
    for s in sources:
        s = s.select("symbol", "decision_date", "text")
        out = s if out is None else out.unionByName(s)
    case = F.concat_ws("|", "symbol", F.col("decision_date").cast("string"), F.substring(F.md5("text"), 1, 8))
    return out.withColumn("case_id", case).dropDuplicates(["case_id"])


def recent_samples(samples: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Samples of the last ``seconds`` before the newest one."""
    newest = whole(samples, ts=F.max(ts))
    return samples.where(F.unix_micros(newest["ts"]) - F.unix_micros(ts) <= seconds * 1_000_000)
