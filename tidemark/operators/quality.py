"""Model quality: confusion family, ranking, calibration, tests, resampling, drift."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole

CLASSES = [0, 1, 2]


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for all nine cells, empty ones too."""
    cells = rows.sparkSession.createDataFrame([(a, p) for a in CLASSES for p in CLASSES], "actual int, predicted int")
    n = rows.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["actual", "predicted"], "left").fillna(0, ["n"])


def class_report(rows: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1), 0 where undefined."""
    c = confusion(rows)
    truth = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    called = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return truth.join(called, "class").select(
        "class", "support", zero(F.try_divide("tp", "called")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("called") + F.col("support"))).alias("f1")
    )


def scores(rows: DataFrame) -> DataFrame:
    """(n, accuracy, balanced_accuracy, macro_f1, mcc) in one row, all from the nine cells."""
    c = confusion(rows)
    a, p, n = F.col("actual"), F.col("predicted"), F.col("n")
    cell = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    sums = c.agg(F.sum(n).alias("n"), *[cell((a == k) & (p == k)).alias(f"tp{k}") for k in CLASSES], *[cell(a == k).alias(f"t{k}") for k in CLASSES], *[cell(p == k).alias(f"p{k}") for k in CLASSES])
    s = lambda x: F.col(x).cast("double")
    right = sum((s(f"tp{k}") for k in CLASSES), F.lit(0.0))
    recalls = [F.try_divide(s(f"tp{k}"), s(f"t{k}")) for k in CLASSES]
    seen = sum((r.isNotNull().cast("int") for r in recalls), F.lit(0))
    f1 = [F.coalesce(F.try_divide(2 * s(f"tp{k}"), s(f"t{k}") + s(f"p{k}")), F.lit(0.0)) for k in CLASSES]
    cross = sum((s(f"t{k}") * s(f"p{k}") for k in CLASSES), F.lit(0.0))
    tt = sum((s(f"t{k}") * s(f"t{k}") for k in CLASSES), F.lit(0.0))
    pp = sum((s(f"p{k}") * s(f"p{k}") for k in CLASSES), F.lit(0.0))
    total = s("n")
    return sums.select(
        "n", F.try_divide(right, total).alias("accuracy"), F.try_divide(sum((F.coalesce(r, F.lit(0.0)) for r in recalls), F.lit(0.0)), seen).alias("balanced_accuracy"), (sum(f1, F.lit(0.0)) / 3).alias("macro_f1"),
        F.coalesce(F.try_divide(right * total - cross, F.sqrt((total * total - pp) * (total * total - tt))), F.lit(0.0)).alias("mcc"),
    )


def directional(rows: DataFrame) -> DataFrame:
    """(n_nonflat, accuracy_nonflat, accuracy_called, coverage): how good directions are, where truth and model have one."""
    moved, called = F.col("actual") != 1, F.col("predicted") != 1
    right = F.col("actual") == F.col("predicted")
    return rows.agg(
        F.count_if(moved).alias("n_nonflat"), F.try_divide(F.count_if(moved & right), F.count_if(moved)).alias("accuracy_nonflat"), F.try_divide(F.count_if(moved & called & right), F.count_if(moved & called)).alias("accuracy_called"),
        F.try_divide(F.count_if(moved & called), F.count_if(moved)).alias("coverage"),
    )


def auc_by(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_pos, n_neg, auc) of rows (by, score, pos): areas with average ranks on ties; null where a side is empty.

    Scores are counted before they are ranked, and the rank of a score is a
    prefix sum over distinct scores, taken in two levels: within ranges of
    scores, and over the ranges.
    """
    counts = rows.where("score is not null").groupBy(by, "score").agg(F.count_if("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    part = F.floor(F.col("score") * 4096).cast("long")
    parts = counts.groupBy(by, part.alias("part")).agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(by, "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy(by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("part", part).withColumn("upto", inside).join(offsets, [by, "part"])
    rank = F.col("before") + F.col("upto") - (F.col("n") - 1) / 2
    sums = ranked.groupBy(by).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.sum(rank * F.col("pos")).alias("r"))
    auc = F.try_divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos").cast("double") * F.col("n_neg"))
    return sums.select(by, "n_pos", "n_neg", auc.alias("auc"))


def auc_by_class(rows: DataFrame, probabilities: dict[int, str]) -> DataFrame:
    """(class, n_pos, n_neg, auc): one-versus-rest areas; see ``auc_by``."""
    flat = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(p).alias("score"), (F.col("actual") == k).alias("pos")) for k, p in probabilities.items()])).alias("x")
    return auc_by(rows.select(flat).select("x.*"), "class")


def top_probability() -> Column:
    return F.greatest("p_down", "p_flat", "p_up")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap): bins (lo, hi] of the top probability, the first one closed."""
    b = F.greatest(F.ceil(top_probability() * bins) - 1, F.lit(0)).cast("int")
    g = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(top_probability()).alias("confidence"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(n, ece): gaps weighted by bin size."""
    return calibration(rows, bins).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"))


def bucket_of(x: Column, edges: list[float]) -> Column:
    """Number of the bucket [edge, next edge) that ``x`` is in; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((x >= edges[k]) & (x < edges[k + 1]), k).otherwise(out)
    return out


def bucket_table(rows: DataFrame, x: Column, edges: list[float], hit: Column) -> DataFrame:
    """(bucket, low, high, n, accuracy) of all buckets, empty ones too."""
    dim = rows.sparkSession.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bucket int, low double, high double")
    g = rows.groupBy(bucket_of(x, edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))
    return dim.join(g, "bucket", "left").fillna(0, ["n"])


def majority_baseline(rows: DataFrame) -> DataFrame:
    """(majority_class, baseline, accuracy, edge, beats): the most frequent class, the lowest on ties."""
    c = confusion(rows)
    truth = c.groupBy("actual").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    top = truth.agg(F.max(F.struct(F.col("n"), (-F.col("actual")).alias("minus"))).alias("top"), F.sum("n").alias("total"), F.sum("right").alias("right"))
    base, acc = F.col("top.n") / F.col("total"), F.col("right") / F.col("total")
    return top.select((-F.col("top.minus")).alias("majority_class"), base.alias("baseline"), acc.alias("accuracy"), (acc - base).alias("edge"), (acc > base).alias("beats"))


def daily_statistics(rows: DataFrame, day: str = "ts") -> DataFrame:
    """One row a date with sums that all scores can be had from: counts, hits, calls, log loss, the nine cells, ten confidence bins."""
    a, p = F.col("actual"), F.col("predicted")
    own = F.when(a == 0, F.col("p_down")).when(a == 1, F.col("p_flat")).otherwise(F.col("p_up"))
    b = F.greatest(F.ceil(top_probability() * 10) - 1, F.lit(0))
    hit = (a == p).cast("long")
    return rows.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.count_if(p != 1).alias("calls"), F.sum(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("log_loss"),
        *[F.count_if((a == i) & (p == j)).alias(f"c{i}{j}") for i in CLASSES for j in CLASSES],
        *[F.count_if(b == k).alias(f"n{k}") for k in range(10)], *[F.coalesce(F.sum(F.when(b == k, hit)), F.lit(0)).alias(f"h{k}") for k in range(10)], *[F.coalesce(F.sum(F.when(b == k, top_probability())), F.lit(0.0)).alias(f"s{k}") for k in range(10)],
    )


def paired_days(pairs: DataFrame, day: str = "ts") -> DataFrame:
    """(day, delta): mean difference of hits of b over a, a row for each date."""
    d = (F.col("predicted_b") == F.col("actual_b")).cast("double") - (F.col("predicted_a") == F.col("actual_a")).cast("double")
    return pairs.where("labels_agree").groupBy(day).agg(F.avg(d).alias("delta"))


def paired_test(pairs: DataFrame, day: str = "ts") -> DataFrame:
    """(n_dates, mean_delta, t): each date weighs the same."""
    m, s, n = F.avg("delta"), F.stddev_samp("delta"), F.count("delta")
    return paired_days(pairs, day).agg(n.alias("n_dates"), m.alias("mean_delta"), F.try_divide(m, F.nullif(s / F.sqrt(n), F.lit(0.0))).alias("t"))


def clustered_bootstrap(pairs: DataFrame, reps: int = 1000, seed: int = 7, day: str = "ts") -> DataFrame:
    """(n_dates, mean_delta, low, high): 95 % interval over dates drawn with replacement.

    Each date takes a Poisson(1) weight in each replicate, which is drawing with
    replacement as the number of dates grows, needs no draw across rows, and is
    a hash of date and replicate: the same on every run and cluster.
    """
    days = paired_days(pairs, day)
    drawn = days.select(day, "delta", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("w", poisson_weight(F.col(day), F.col("rep"), seed))
    means = drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("delta")), F.sum("w")).alias("m"))
    bounds = whole(means, low=F.percentile("m", F.lit(0.025)), high=F.percentile("m", F.lit(0.975)))
    return days.agg(F.count("delta").alias("n_dates"), F.avg("delta").alias("mean_delta")).select("n_dates", "mean_delta", bounds["low"].alias("low"), bounds["high"].alias("high"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(n, only_a, only_b, p_value): exact two-sided test on the pairs that one side alone has right."""
    ra, rb = F.col("predicted_a") == F.col("actual_a"), F.col("predicted_b") == F.col("actual_b")
    counts = pairs.where("labels_agree").agg(F.count(F.lit(1)).alias("n"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(rb & ~ra).alias("only_b"))
    return counts.withColumn("p_value", two_sided("only_a", "only_b"))


def two_sided(a: str, b: str) -> Column:
    """Exact two-sided chance of counts at least as uneven as those of two columns; one row a comparison."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(x), int(y)) for x, y in zip(a, b)], dtype="float64")

    return run(F.col(a), F.col(b))


def binomial_two_sided(a: int, b: int) -> float:
    """Chance of a split at least as uneven as a : b if both were equally likely."""
    n, k = a + b, min(a, b)
    if n == 0:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def diebold_mariano(losses: DataFrame, order: str = "ts", loss_a: str = "loss_a", loss_b: str = "loss_b", lags: int = 5) -> DataFrame:
    """(n, mean_diff, variance, dm, p_value) of daily loss differences, with Bartlett weights; null for fewer than ten or no variance.

    ``losses`` has one row a date, so its order needs a single partition.
    """
    d = losses.select(order, (F.col(loss_a) - F.col(loss_b)).alias("d")).where("d is not null")
    mean = whole(d, m=F.avg("d"), n=F.count(F.lit(1)))
    w = Window.orderBy(order)
    x = d.withColumns({"m": mean["m"], "n": mean["n"]}).withColumn("e", F.col("d") - F.col("m"))
    x = x.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, lags + 1)})
    sums = x.agg(F.first("n").alias("n"), F.first("m").alias("m"), F.avg(F.col("e") * F.col("e")).alias("g0"), *[F.avg(f"g{k}").alias(f"g{k}") for k in range(1, lags + 1)])
    var = F.col("g0")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))
    out = sums.select("n", F.col("m").alias("mean_diff"), var.alias("variance"))
    dm = F.when((F.col("n") >= 10) & (F.col("variance") > 0), F.col("mean_diff") / F.sqrt(F.col("variance") / F.col("n")))
    r = out.withColumn("dm", dm).first()
    p = None if r is None or r["dm"] is None else math.erfc(abs(r["dm"]) / math.sqrt(2))
    return losses.sparkSession.createDataFrame([(r["n"] or 0, r["mean_diff"], r["variance"], r["dm"], p)], "n long, mean_diff double, variance double, dm double, p_value double")


def stability_index(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(feature, n_reference, n_current, psi) of many columns at once.

    Bins are the distinct quantiles of the reference; values of the current set
    outside its range are dropped; shares are at least 1e-6. Null where the
    reference has fewer than 30 values, the current set fewer than 10, or there
    are fewer than three edges.
    """
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*").where("x is not null and not isnan(x)")
    ref, cur = long(reference), long(current)
    qs = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    edges = ref.groupBy("feature").agg(F.array_distinct(F.percentile("x", qs)).alias("edges"), F.count(F.lit(1)).alias("n_reference"))
    # One row a feature.
    at = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    last = F.size("edges")
    b = F.when(F.col("x") == F.element_at("edges", -1), last - 1).when((at >= 1) & (at < last), at)
    count = lambda df, name: df.join(F.broadcast(edges), "feature").where(last >= 3).groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias(name)).where("bin is not null")
    bins_all = edges.where(last >= 3).select("feature", F.explode(F.sequence(F.lit(1), last - 1)).alias("bin"))
    both = bins_all.join(count(ref, "r"), ["feature", "bin"], "left").join(count(cur, "c"), ["feature", "bin"], "left").fillna(0, ["r", "c"])
    part = Window.partitionBy("feature")
    share = lambda n: F.greatest(F.coalesce(F.try_divide(F.col(n), F.sum(n).over(part)), F.lit(0.0)), F.lit(1e-6))
    shares = both.select("feature", share("r").alias("r"), share("c").alias("c"))
    psi = shares.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))
    n_cur = cur.groupBy("feature").agg(F.count(F.lit(1)).alias("n_current"))
    out = edges.select("feature", "n_reference").join(n_cur, "feature", "left").join(psi, "feature", "left").fillna(0, ["n_current"])
    return out.select("feature", "n_reference", "n_current", F.when((F.col("n_reference") >= 30) & (F.col("n_current") >= 10), F.col("psi")).alias("psi"))


def segments(rows: DataFrame, segment: Column, least_rows: int = 100, least_dates: int = 20, day: str = "ts") -> DataFrame:
    """(segment, n, n_dates, accuracy, coverage, enough): scores by any segment; null is one of its own."""
    g = rows.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_dates"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg((F.col("predicted") != 1).cast("double")).alias("coverage")
    )
    return g.withColumn("enough", (F.col("n") >= least_rows) & (F.col("n_dates") >= least_dates))


def quantile_bucket(rows: DataFrame, x: str, k: int, out: str) -> DataFrame:
    """``rows`` with ``out``: which of k quantile bins (lo, hi] holds ``x``, 1 to k; equal edges fall together, ties share a bin."""
    edges = whole(rows, edges=F.array_distinct(F.percentile(x, F.array(*[F.lit(i / k) for i in range(k + 1)]))))
    b = F.greatest(F.size(F.filter("__edges", lambda e: e < F.col(x))), F.lit(1))
    return rows.withColumn("__edges", edges["edges"]).withColumn(out, F.when(F.col(x).isNotNull(), b)).drop("__edges")


def flips(pairs: DataFrame) -> DataFrame:
    """(predicted_a, predicted_b, n, hit_a, hit_b) of pairs whose predictions differ."""
    differ = pairs.where("labels_agree").where("predicted_a <> predicted_b")
    return differ.groupBy("predicted_a", "predicted_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted_a") == F.col("actual_a")).cast("double")).alias("hit_a"), F.avg((F.col("predicted_b") == F.col("actual_b")).cast("double")).alias("hit_b"))


def rank_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, spearman): Pearson correlation of average-tie ranks. Rows are names of a list, few enough for one order."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    ranked = pairs.select(rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def rolling_accuracy(rows: DataFrame, n: int, at_least: int = 5, ts: str = "ts", key: str = "id") -> DataFrame:
    """(key, rolling): accuracy of the last n rows in order of time and key over all rows, where there are ``at_least``.

    Prefix sums in two levels, dates and rows within a date, and an equi-join
    with the prefix n rows before: no task holds the whole order.
    """
    hit = (F.col("actual") == F.col("predicted")).cast("long")
    r = rows.select(ts, key, hit.alias("hit"))
    days = r.groupBy(ts).agg(F.count(F.lit(1)).alias("m"), F.sum("hit").alias("h"))
    before = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(ts, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    inside = Window.partitionBy(ts).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    x = r.withColumns({"i": F.count(F.lit(1)).over(inside), "h": F.sum("hit").over(inside)}).join(offsets, ts)
    x = x.select(key, (F.col("i") + F.col("m0")).alias("i"), (F.col("h") + F.col("h0")).alias("h"))
    past = x.select((F.col("i") + n).alias("i"), F.col("h").alias("past"))
    joined = x.join(past, "i", "left")
    value = (F.col("h") - F.coalesce("past", F.lit(0))) / F.least(F.col("i"), F.lit(n))
    return joined.select(key, F.when(F.col("i") >= at_least, value).alias("rolling"))


def recent_drift(rows: DataFrame, columns: list[str], last: int, ts: str = "ts") -> DataFrame:
    """Stability index of the last ``last`` dates against all dates up to five times as far back."""
    from tidemark.operators.labels import date_positions

    pos = date_positions(rows, ts)
    placed = rows.join(pos, ts)
    current = placed.where(F.col("pos") >= F.col("n_dates") - last)
    reference = placed.where(F.col("pos") <= F.col("n_dates") - 5 * last)
    return stability_index(reference, current, columns)


def two_proportions(rows: DataFrame, group, hit, least: int = 30) -> DataFrame:
    """(rate_in, rate_out, delta, two_se, passed): whether a group's rate is above the rest's by two standard errors; fails on few rows."""
    g, h = F.coalesce(group, F.lit(False)), hit.cast("double")
    a = rows.agg(F.count_if(g).alias("n_in"), F.count_if(~g).alias("n_out"), F.avg(F.when(g, h)).alias("rate_in"), F.avg(F.when(~g, h)).alias("rate_out"))
    p, q = F.col("rate_in"), F.col("rate_out")
    a = a.withColumns({"delta": p - q, "two_se": 2 * F.sqrt(F.try_divide(p * (1 - p), F.col("n_in")) + F.try_divide(q * (1 - q), F.col("n_out")))})
    return a.withColumn("passed", F.coalesce((F.col("n_in") >= least) & (F.col("n_out") >= least) & (F.col("delta") > F.col("two_se")), F.lit(False)))


def scores_by(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, accuracy, recall and share of each class): a score table of folds, splits or groups."""
    a, p = F.col("actual"), F.col("predicted")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((a == p).cast("double")).alias("accuracy"),
        *[F.try_divide(F.count_if((a == k) & (p == k)), F.count_if(a == k)).alias(f"recall_{k}") for k in CLASSES], *[F.avg((p == k).cast("double")).alias(f"share_{k}") for k in CLASSES],
    )


def split_gaps(scored: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(measure, a, b, gap_pp) of a score table's two rows, gaps in percentage points."""
    names = [c for c in scored.columns if c not in (by, "n")]
    flat = scored.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in names])).alias("x")).select(by, "x.*")
    g = flat.groupBy("measure").agg(F.max(F.when(F.col(by) == a, F.col("v"))).alias("a"), F.max(F.when(F.col(by) == b, F.col("v"))).alias("b"))
    return g.withColumn("gap_pp", (F.col("a") - F.col("b")) * 100)


def contributions(explanations: DataFrame, k: int) -> DataFrame:
    """(class, feature, mean, mean_abs, rank): features with the largest absolute mean contribution. mean_abs is the absolute of the mean, not the mean of absolutes."""
    m = explanations.groupBy("class", "feature").agg(F.avg("contribution").alias("mean"))
    m = m.withColumn("mean_abs", F.abs("mean"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mean_abs"), "feature"))
    return m.withColumn("rank", rank).where(F.col("rank") <= k)


def waterfall(explanations: DataFrame, row: str = "id") -> DataFrame:
    """(row, feature, contribution, running): contributions of each row by size, with their running sum."""
    w = Window.partitionBy(row).orderBy(F.desc(F.abs("contribution")), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return explanations.select(row, "feature", "contribution", F.sum("contribution").over(w).alias("running"))


def flip_distance(explanations: DataFrame, row: str = "id") -> DataFrame:
    """(row, total, strongest, distance): sum of contributions, the feature with the largest, and whether taking that away would change the sign."""
    g = explanations.groupBy(row).agg(F.sum("contribution").alias("total"), F.max_by(F.struct("feature", "contribution"), F.struct(F.abs("contribution"), "feature")).alias("s"))
    return g.select(row, "total", F.col("s.feature").alias("strongest"), (F.col("total") - F.col("s.contribution")).alias("without_strongest"), (F.signum("total") != F.signum(F.col("total") - F.col("s.contribution"))).alias("flips"))


def importance_shares(explanations: DataFrame) -> DataFrame:
    """(feature, mean_abs, share, rank): mean absolute contribution, its share of the sum over features, and its rank."""
    m = explanations.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    total = whole(m, s=F.sum("mean_abs"))
    # One row a feature.
    return m.select("feature", "mean_abs", F.try_divide(F.col("mean_abs"), total["s"]).alias("share"), F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")).alias("rank"))


def poisson_weight(key: Column, rep: Column, seed: int) -> Column:
    """Poisson(1) draw of a row in a replicate, by hash: the same on every run and cluster."""
    u = (F.pmod(F.xxhash64(key.cast("string"), rep, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, total = F.lit(0), 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        weight = weight + (u > total).cast("int")
    return weight


def poisson_draws(keys: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) draws of hashed keys, a column for each replicate; column 0 is all ones."""
    x = keys.view(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    totals = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    table = np.searchsorted(totals, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float64)
    return np.concatenate([np.ones((len(keys), 1)), table[(x >> np.uint64(48)).astype(np.int64)]], axis=1)


def _pairs_won(reps: int, step: int = 512):
    """Of each side and run of sorted rows, a row a replicate: (side, low, rep, won, p, n), ``won`` being the weight of (positive, lower negative) pairs within it, ties half."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close() -> None:
            state["won"] += state["open_p"] * (state["n"] + state["open_n"] / 2)
            state["p"] += state["open_p"]
            state["n"] += state["open_n"]

        def result() -> pd.DataFrame:
            close()
            return pd.DataFrame({"side": state["side"], "low": state["low"], "rep": np.arange(reps + 1), "won": state["won"], "p": state["p"], "n": state["n"]})

        for pdf in batches:
            for side, part in pdf.groupby("side", sort=True):
                score, pos, keys = part["s"].to_numpy(), part["pos"].to_numpy(dtype=np.float64), part["h"].to_numpy(dtype=np.int64)
                if state and state["side"] != side:
                    yield result()
                    state.clear()
                if not state:
                    state.update(side=side, low=score[0], at=score[0], **{c: np.zeros(reps + 1) for c in ("won", "p", "n", "open_p", "open_n")})
                for a in range(0, len(score), step):
                    s, y = score[a : a + step], pos[a : a + step, None]
                    w = poisson_draws(keys[a : a + step], reps)
                    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                    gp, gn = np.add.reduceat(w * y, starts), np.add.reduceat(w * (1 - y), starts)
                    if s[0] == state["at"]:
                        gp[0] += state["open_p"]
                        gn[0] += state["open_n"]
                    else:
                        close()
                    below = state["n"] + np.cumsum(gn[:-1], axis=0) - gn[:-1]
                    state["won"] += (gp[:-1] * (below + gn[:-1] / 2)).sum(axis=0)
                    state["p"] += gp[:-1].sum(axis=0)
                    state["n"] += gn[:-1].sum(axis=0)
                    # The last score may go on in the next rows.
                    state.update(at=s[-1], open_p=gp[-1], open_n=gn[-1])
        if state:
            yield result()

    return run


def auc_difference(pairs: DataFrame, score_a: str, score_b: str, positive: Column, key: str = "id", reps: int = 1000, seed: int = 7) -> DataFrame:
    """(auc_a, auc_b, difference, se): areas of two scores on the same rows, and the standard error of their difference over replicates.

    Each replicate weighs rows by a Poisson draw. Rows are sorted by score once;
    each range counts its pairs for all replicates, and the negatives of lower
    ranges are added at the end, so that no row is copied for a replicate. A
    null score is below all others, NaN above.
    """
    known = lambda c: F.when(F.isnan(c), F.lit(math.inf)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(-math.inf)))
    sides = F.array(F.struct(F.lit("a").alias("side"), known(score_a).alias("s")), F.struct(F.lit("b").alias("side"), known(score_b).alias("s")))
    rows = pairs.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"), F.coalesce(positive, F.lit(False)).cast("int").alias("pos"), F.explode(sides).alias("x")).select("h", "pos", "x.*")
    ranges = rows.repartitionByRange("side", "s").sortWithinPartitions("side", "s").mapInPandas(_pairs_won(reps), "side string, low double, rep int, won double, p double, n double")
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("side", "rep").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = ranges.withColumn("won", F.col("won") + F.col("p") * lower).groupBy("rep", "side").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = F.try_divide("won", F.col("p") * F.col("n"))
    both = sums.groupBy("rep").agg(F.max(F.when(F.col("side") == "a", auc)).alias("a"), F.max(F.when(F.col("side") == "b", auc)).alias("b"))
    at = lambda c: F.max(F.when(F.col("rep") == 0, F.col(c)))
    return both.agg(at("a").alias("auc_a"), at("b").alias("auc_b"), (at("b") - at("a")).alias("difference"), F.stddev_samp(F.when(F.col("rep") > 0, F.col("b") - F.col("a"))).alias("se"))


def signal_report(rows: DataFrame, threshold: float) -> DataFrame:
    """(n, n_signals, signal_accuracy, baseline, edge): directions at or above a probability, against the most frequent class of all rows."""
    signal = (top_probability() >= threshold) & (F.col("predicted") != 1)
    right = F.col("actual") == F.col("predicted")
    n = F.count(F.lit(1))
    base = F.greatest(*[F.count_if(F.col("actual") == k) for k in CLASSES]) / n
    acc = F.try_divide(F.count_if(signal & right), F.count_if(signal))
    return rows.agg(n.alias("n"), F.count_if(signal).alias("n_signals"), acc.alias("signal_accuracy"), base.alias("baseline"), (acc - base).alias("edge"))
