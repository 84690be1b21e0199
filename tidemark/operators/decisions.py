"""Decision rules over class probabilities, threshold sweeps, and event backtests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from pyspark.sql import types as T

P = ["p_down", "p_flat", "p_up"]


def softened(t: float) -> dict[str, Column]:
    """Probabilities at temperature ``t``."""
    logs = [F.ln(F.greatest(F.col(p), F.lit(1e-12))) / t for p in P]
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    return {p: w / (weights[0] + weights[1] + weights[2]) for p, w in zip(P, weights)}


def flat_rule(tau) -> Column:
    """FLAT at p_flat >= tau, else the likelier direction, DOWN on ties."""
    return F.when(F.col("p_flat") >= tau, 1).when(F.col("p_down") >= F.col("p_up"), 0).otherwise(2)


def cascade(tau_flat, tau_down) -> Column:
    """FLAT first, then DOWN at p_down >= tau_down, else the likelier direction."""
    return F.when(F.col("p_flat") >= tau_flat, 1).when(F.col("p_down") >= tau_down, 0).when(F.col("p_down") >= F.col("p_up"), 0).otherwise(2)


def gated(min_confidence: float, tau: float, margin: float) -> Column:
    """(label, branch): abstain (-1) below a confidence, FLAT rule, FLAT on a small margin between directions, else the direction."""
    top = F.greatest(*[F.col(p) for p in P])
    out = lambda label, branch: F.struct(label.cast("int").alias("label"), F.lit(branch).alias("branch"))
    return (
        F.when(top < min_confidence, out(F.lit(-1), "low_confidence"))
        .when(F.col("p_flat") >= tau, out(F.lit(1), "flat_rule"))
        .when(F.abs(F.col("p_up") - F.col("p_down")) < margin, out(F.lit(1), "margin"))
        .otherwise(out(F.when(F.col("p_down") >= F.col("p_up"), 0).otherwise(2), "direction"))
    )


def _grid(values: list[float], name: str) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)


def flat_sweep(predictions: DataFrame, taus: list[float], slack: float = 0.005) -> DataFrame:
    """(tau, n, accuracy, precision, recall, f1, picked): the FLAT rule at each tau.

    Picked is the largest FLAT F1 among taus whose accuracy is at most
    ``slack`` below that of the plain argmax, or among all if none is. Each row
    is compared with all taus in one pass.
    """
    rows = predictions.select("actual", "predicted", *P, _grid(taus, "tau")).withColumn("call", flat_rule(F.col("tau")))
    tp = F.count_if((F.col("call") == 1) & (F.col("actual") == 1))
    called, truth = F.count_if(F.col("call") == 1), F.count_if(F.col("actual") == 1)
    stats = rows.groupBy("tau").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("call") == F.col("actual")).cast("double")).alias("accuracy"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("__base"),
        F.coalesce(F.try_divide(tp, called), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, truth), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * tp, called + truth), F.lit(0.0)).alias("f1"),
    )
    fits = (F.col("accuracy") >= F.col("__base") - slack).cast("int")
    # One row a tau.
    picked = F.row_number().over(Window.orderBy(F.desc(fits), F.desc("f1"), "tau")) == 1
    return stats.withColumn("picked", picked).drop("__base")


def down_sweep(predictions: DataFrame, taus: list[float], tau_flat: float, least_coverage: float = 0.03) -> DataFrame:
    """(tau, n_calls, coverage, precision, picked): the DOWN cascade; picked is the largest precision at enough coverage."""
    rows = predictions.select("actual", *P, _grid(taus, "tau")).withColumn("call", F.when(F.col("p_flat") >= tau_flat, 1).when(F.col("p_down") >= F.col("tau"), 0).otherwise(2))
    n_calls = F.count_if(F.col("call") == 0)
    stats = rows.groupBy("tau").agg(n_calls.alias("n_calls"), (n_calls / F.count(F.lit(1))).alias("coverage"), F.try_divide(F.count_if((F.col("call") == 0) & (F.col("actual") == 0)), n_calls).alias("precision"))
    fits = (F.col("coverage") >= least_coverage).cast("int")
    picked = (F.row_number().over(Window.orderBy(F.desc(fits), F.desc_nulls_last("precision"), "tau")) == 1) & (fits == 1)
    return stats.withColumn("picked", picked)


def policy_search(predictions: DataFrame, confidences: list[float], taus: list[float], margins: list[float], floor: float = 0.15, least_share: float = 0.10) -> DataFrame:
    """(confidence, tau, margin, coverage, accuracy_called, accuracy_all, least_recall, feasible, infeasible_reason) of every gated policy, in one pass.

    The recall of every class that has ``least_share`` of the rows is to reach ``floor``; infeasible policies stay.
    """
    rows = predictions.select("actual", *P, _grid(confidences, "confidence")).select("*", _grid(taus, "tau")).select("*", _grid(margins, "margin"))
    top = F.greatest(*[F.col(p) for p in P])
    label = (
        F.when(top < F.col("confidence"), -1).when(F.col("p_flat") >= F.col("tau"), 1).when(F.abs(F.col("p_up") - F.col("p_down")) < F.col("margin"), 1).when(F.col("p_down") >= F.col("p_up"), 0).otherwise(2)
    )
    rows = rows.withColumn("call", label)
    right = F.col("call") == F.col("actual")
    recall = lambda k: F.coalesce(F.try_divide(F.count_if(right & (F.col("actual") == k)), F.count_if(F.col("actual") == k)), F.lit(0.0))
    short = lambda k, name: F.when((F.avg((F.col("actual") == k).cast("double")) >= least_share) & (recall(k) < floor), F.lit(f"{name} recall below {floor}"))
    reason = F.concat_ws("; ", short(0, "DOWN"), short(1, "FLAT"), short(2, "UP"))
    return rows.groupBy("confidence", "tau", "margin").agg(
        F.avg(F.col("call").isin(0, 2).cast("double")).alias("coverage"), F.try_divide(F.count_if(right), F.count_if(F.col("call") >= 0)).alias("accuracy_called"), F.avg(right.cast("double")).alias("accuracy_all"),
        F.least(recall(0), recall(1), recall(2)).alias("least_recall"), (reason == "").alias("feasible"), F.nullif(reason, F.lit("")).alias("infeasible_reason"),
    )


def position_size(threshold) -> Column:
    """Signed share of a full position: (p - threshold) / (1 - threshold), 0 for FLAT and below the threshold."""
    size = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(p) - threshold) / (1 - threshold)))
    return F.when(F.col("predicted") == 2, size("p_up")).when(F.col("predicted") == 0, -size("p_down")).otherwise(F.lit(0.0))


def accept_without_overlap(trades: DataFrame, entity: str | list[str] = "symbol", start: str = "event_start", end: str = "event_end", wants: str = "wants", key: str = "id") -> DataFrame:
    """``trades`` with accepted: in time order, those that want a position and start after the last accepted one has ended.

    Sequential by nature, so only the columns that it needs go to Python, and
    wishes are thinned first where that is exact: of trades of an entity with one
    start only the first in order can be accepted. ``key`` is unique within an
    entity; rows without entity are never accepted.
    """
    by = [entity] if isinstance(entity, str) else list(entity)
    wishing = trades.where(F.col(wants) & F.col(start).isNotNull() & F.col(end).isNotNull()).select(*by, key, start, end)
    first = F.row_number().over(Window.partitionBy(*by, start).orderBy(key))
    candidates = wishing.withColumn("__first", first).where("__first = 1").drop("__first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(start, kind="stable")
        flags, until = [], None
        for s, e in zip(pdf[start], pdf[end]):
            take = until is None or s > until
            until = e if take else until
            flags.append(take)
        return pdf.loc[flags, [*by, key]]

    accepted = candidates.groupBy(*by).applyInPandas(run, T.StructType([trades.schema[c] for c in (*by, key)])).withColumn("accepted", F.lit(True))
    return trades.join(accepted, [*by, key], "left").select(*trades.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def backtest(predictions: DataFrame, threshold=0.4, cost=0.001, max_gross=1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``predictions`` with signal, accepted, weight and net: sized, accepted without overlap, and scaled to a gross limit by entry day.

    The settings are numbers or columns; runs told apart by ``by`` don't touch each other.
    """
    limit = F.lit(max_gross) if isinstance(max_gross, float) else max_gross
    sized = predictions.withColumn("signal", position_size(threshold))
    done = accept_without_overlap(sized.withColumn("wants", (F.col("signal") != 0) & F.col("realized").isNotNull()), [*by, "symbol"])
    live = F.when(F.col("accepted"), F.col("signal")).otherwise(F.lit(0.0))
    gross = F.sum(F.abs(live)).over(Window.partitionBy(*by, "event_start"))
    weight = live * F.when(gross > limit, limit / gross).otherwise(F.lit(1.0))
    out = done.withColumn("weight", weight)
    return out.withColumn("net", F.col("weight") * F.col("realized") - F.abs("weight") * cost).drop("wants")


def daily_net(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(day, net) by exit date. Every row's date is there, with 0 where nothing was accepted."""
    return trades.groupBy(*by, F.col("event_end").alias("day")).agg(F.sum("net").alias("net"))


def equity_curve(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(day, net, equity, drawdown). One row a day: a single ordered partition for each run is enough."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # Days of -100 % or worse end the curve at 0.
    equity = F.when(F.min("net").over(w) > -1, F.exp(F.sum(F.ln(F.when(F.col("net") > -1, 1 + F.col("net")))).over(w))).otherwise(F.lit(0.0))
    out = daily.withColumn("equity", equity)
    return out.withColumn("drawdown", F.col("equity") / F.nullif(F.max("equity").over(w), F.lit(0.0)) - 1)


def curve_figures(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(n_days, total_return, max_drawdown, sharpe)."""
    mean, std = F.avg("net"), F.stddev_samp("net")
    return curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), (F.max_by("equity", "day") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.try_divide(mean, F.nullif(std, F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
    )


def weekly_last(curve: DataFrame, least: int = 5) -> DataFrame:
    """(week, equity): the last equity of each week that ends on a Friday; with fewer than ``least`` weeks every day by itself."""
    friday = F.next_day(F.date_sub("day", 1), "FRI")
    few = whole(curve, n=F.count_distinct(friday))["n"] < least
    return curve.groupBy(F.when(few, F.col("day")).otherwise(friday).alias("week")).agg(F.max_by("equity", "day").alias("equity"))


def symbol_figures(trades: DataFrame) -> DataFrame:
    """(symbol, n_rows, n_accepted, net, hit_rate)."""
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("accepted").alias("n_accepted"), F.sum("net").alias("net"), F.try_divide(F.count_if(F.col("accepted") & (F.col("net") > 0)), F.count_if("accepted")).alias("hit_rate")
    )


def top_per_day(rows: DataFrame, k: int, by: str, day: str = "event_start", key: str = "id") -> DataFrame:
    """The k rows of each day with the largest ``by``."""
    rank = F.row_number().over(Window.partitionBy(day).orderBy(F.desc_nulls_last(by), key))
    return rows.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def liquid(panel: DataFrame, turnover: str = "turnover", quantile: float = 0.75) -> DataFrame:
    """(symbol, ts, eligible): turnover's trailing median, a session late, at or above the session's quantile across symbols."""
    from tidemark.operators import windows as W

    med = panel.withColumn("__m", W.rolling_quantile(F.col(turnover), 60, 0.5, 20)).withColumn("__m", F.lag("__m").over(W.series()))
    cut = F.percentile("__m", F.lit(quantile)).over(Window.partitionBy("ts"))
    return med.select("symbol", "ts", F.coalesce(F.col("__m") >= cut, F.lit(False)).alias("eligible"))


def fit_temperature(predictions: DataFrame, low: float = 0.25, high: float = 5.0, steps: int = 3, points: int = 9) -> DataFrame:
    """(temperature, loss, n): least mean log loss within bounds, by grids that close in; each grid is one pass over the rows."""
    best = None
    for _ in range(steps):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        rows = predictions.select("actual", *P, _grid(grid, "t"))
        logs = [F.ln(F.greatest(F.col(p), F.lit(1e-12))) / F.col("t") for p in P]
        top = F.greatest(*logs)
        total = F.ln(sum((F.exp(x - top) for x in logs), F.lit(0.0))) + top
        own = F.when(F.col("actual") == 0, logs[0]).when(F.col("actual") == 1, logs[1]).otherwise(logs[2])
        losses = {r["t"]: (r["loss"], r["n"]) for r in rows.groupBy("t").agg(F.avg(total - own).alias("loss"), F.count(F.lit(1)).alias("n")).collect()}
        if not losses:
            break
        best = min(losses, key=lambda t: losses[t][0])
        width = (high - low) / (points - 1)
        result = (best, *losses[best])
        low, high = max(0.25, best - width), min(5.0, best + width)
    spark = predictions.sparkSession
    return spark.createDataFrame([result] if best is not None else [], "temperature double, loss double, n long")


def policy_scores(rows: DataFrame, call: str) -> DataFrame:
    """(n, abstained, coverage, accuracy_penalised, accuracy_called, accuracy_movers) of calls -1 (abstain), 0, 1, 2."""
    c, right = F.col(call), F.col(call) == F.col("actual")
    moved = F.col("actual") != 1
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c == -1).alias("abstained"), F.avg(c.isin(0, 2).cast("double")).alias("coverage"), F.avg(right.cast("double")).alias("accuracy_penalised"),
        F.try_divide(F.count_if(right), F.count_if(c >= 0)).alias("accuracy_called"), F.try_divide(F.count_if(right & moved), F.count_if(moved)).alias("accuracy_movers"),
    )


def threshold_diagnostics(predictions: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, accuracy, share and recall of each class) of the FLAT rule at each tau, in one pass."""
    rows = predictions.select("actual", *P, _grid(taus, "tau")).withColumn("call", flat_rule(F.col("tau")))
    share = [F.avg((F.col("call") == k).cast("double")).alias(f"share_{k}") for k in range(3)]
    recall = [F.try_divide(F.count_if((F.col("call") == k) & (F.col("actual") == k)), F.count_if(F.col("actual") == k)).alias(f"recall_{k}") for k in range(3)]
    return rows.groupBy("tau").agg(F.avg((F.col("call") == F.col("actual")).cast("double")).alias("accuracy"), *share, *recall)


def avoided_loss(predictions: DataFrame, tau_flat: float, tau_down: float, cost: float) -> DataFrame:
    """(n_flags, mean_avoided, total_avoided, whipsaw_rate): what leaving on a DOWN call would have saved after cost, and how often the price rose instead."""
    flagged = predictions.where(cascade(tau_flat, tau_down) == 0)
    saved = -F.col("realized") - cost
    return flagged.agg(F.count(F.lit(1)).alias("n_flags"), F.avg(saved).alias("mean_avoided"), F.sum(saved).alias("total_avoided"), F.avg((F.col("realized") > 0).cast("double")).alias("whipsaw_rate"))


def trade_page(trades: DataFrame, outcome: str, offset: int, limit: int) -> DataFrame:
    """A page of accepted trades, winners or losers, by net; each row has the count and sum of all that match."""
    won = F.col("net") > 0 if outcome == "winners" else F.col("net") < 0
    rows = trades.where(F.col("accepted") & won)
    total = whole(rows, n=F.count(F.lit(1)), net=F.sum("net"))
    order = F.desc("net") if outcome == "winners" else F.asc("net")
    return rows.orderBy(order, "id").offset(offset).limit(limit).select("id", "symbol", "net", total["n"].alias("n_all"), total["net"].alias("net_all"))


def variants(predictions: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """(variant, n_days, total_return, max_drawdown, sharpe, n_accepted) of backtests with other settings.

    A setting may have threshold, cost, max_gross, per_day (most rows of a day
    by top probability, chosen before acceptance) and only (a row condition).
    All variants are one run: each row is taken once for every variant that it
    belongs to, and everything after that is by variant.
    """
    option = lambda name, o: F.struct(
        F.lit(name).alias("variant"), F.lit(float(o.get("threshold", 0.4))).alias("__threshold"), F.lit(float(o.get("cost", 0.001))).alias("__cost"),
        F.lit(float(o.get("max_gross", 1.0))).alias("__gross"), F.lit(o.get("per_day")).cast("int").alias("__per_day"),
    )
    taken = F.array_compact(F.array(*[F.when(F.expr(o.get("only", "true")), option(name, o)) for name, o in settings.items()]))
    rows = predictions.withColumn("__v", F.explode(taken)).select(*predictions.columns, "__v.*")
    rank = F.row_number().over(Window.partitionBy("variant", "event_start").orderBy(F.desc_nulls_last("__c"), "id"))
    rows = rows.withColumn("__c", F.greatest(*P)).withColumn("__rank", rank).where("__per_day is null or __rank <= __per_day").drop("__c", "__rank")
    by = ("variant",)
    trades = backtest(rows, F.col("__threshold"), F.col("__cost"), F.col("__gross"), by)
    daily = trades.groupBy("variant", F.col("event_end").alias("day")).agg(F.sum("net").alias("net"), F.count_if("accepted").alias("n_accepted"))
    figures = curve_figures(equity_curve(daily, by), by)
    return figures.join(daily.groupBy("variant").agg(F.sum("n_accepted").alias("n_accepted")), "variant")
