"""Queries of decisions, backtests, model quality and slice studies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decisions as D
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import quality as G
from tidemark.operators import studies as H
from tidemark.plans.oracle import rounded, sql
from tidemark.sources import views as V
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRED = [V.predictions_sql()]
_P = ["p_down", "p_flat", "p_up"]
_TOP = "greatest(p_down, p_flat, p_up)"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(spark, sf_dir)


_SOFT = ", ".join(f"exp(ln(greatest({p}, 1e-12)) / 2) AS e_{p}" for p in _P)


@query(sql([*PRED, f"s AS (SELECT id, {_SOFT} FROM predictions)"], "SELECT id, " + ", ".join(f"e_{p} / (e_p_down + e_p_flat + e_p_up) AS {p}" for p in _P) + " FROM s", ["id"], _P))
def temperature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pred(spark, sf_dir).select("id", *[c.alias(p) for p, c in D.softened(2.0).items()]))


@query(sql(PRED, "SELECT id, CASE WHEN p_flat >= 0.4 THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END AS by_flat, CASE WHEN p_flat >= 0.4 THEN 1 WHEN p_down >= 0.35 THEN 0 WHEN p_down >= p_up THEN 0 ELSE 2 END AS by_cascade FROM predictions", ["id", "by_flat", "by_cascade"]))
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pred(spark, sf_dir).select("id", D.flat_rule(0.4).alias("by_flat"), D.cascade(0.4, 0.35).alias("by_cascade"))


_GATED = f"CASE WHEN {_TOP} < 0.4 THEN 'low_confidence' WHEN p_flat >= 0.45 THEN 'flat_rule' WHEN abs(p_up - p_down) < 0.05 THEN 'margin' ELSE 'direction' END"


@query(sql([*PRED, f"g AS (SELECT *, {_GATED} AS branch FROM predictions)"], "SELECT branch, CASE branch WHEN 'low_confidence' THEN -1 WHEN 'direction' THEN CASE WHEN p_down >= p_up THEN 0 ELSE 2 END ELSE 1 END AS label, count(*) AS n FROM g GROUP BY 1, 2", ["branch", "label", "n"]))
def gated_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _pred(spark, sf_dir).select(D.gated(0.4, 0.45, 0.05).alias("g")).select("g.*")
    return g.groupBy("branch", "label").agg(F.count(F.lit(1)).alias("n"))


_TAUS = [round(0.10 + 0.05 * k, 2) for k in range(11)]
_TAU_SQL = "t AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in _TAUS) + "]) AS tau)"


@query(
    sql(
        [*PRED, _TAU_SQL, "c AS (SELECT tau, actual, predicted, CASE WHEN p_flat >= tau THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END AS call FROM predictions, t)",
         """s AS (SELECT tau, count(*) AS n, avg(CAST(call = actual AS INTEGER)) AS accuracy, avg(CAST(predicted = actual AS INTEGER)) AS base, count(*) FILTER (call = 1 AND actual = 1) AS tp, count(*) FILTER (call = 1) AS k, count(*) FILTER (actual = 1) AS t FROM c GROUP BY 1)""",
         "u AS (SELECT *, coalesce(tp / nullif(k, 0), 0) AS precision, coalesce(tp / nullif(t, 0), 0) AS recall, coalesce(2 * tp / nullif(k + t, 0), 0) AS f1 FROM s)"],
        "SELECT *, row_number() OVER (ORDER BY CASE WHEN accuracy >= base - 0.005 THEN 0 ELSE 1 END, f1 DESC, tau) = 1 AS picked FROM u", ["n", "picked"], ["tau", "accuracy", "precision", "recall", "f1"],
    )
)
def flat_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.flat_sweep(_pred(spark, sf_dir), _TAUS))


@query(
    sql(
        [*PRED, _TAU_SQL, "c AS (SELECT tau, actual, CASE WHEN p_flat >= 0.5 THEN 1 WHEN p_down >= tau THEN 0 ELSE 2 END AS call FROM predictions, t)",
         "s AS (SELECT tau, count(*) FILTER (call = 0) AS n_calls, count(*) FILTER (call = 0) / count(*) AS coverage, count(*) FILTER (call = 0 AND actual = 0) / nullif(count(*) FILTER (call = 0), 0) AS precision FROM c GROUP BY 1)"],
        "SELECT *, row_number() OVER (ORDER BY CASE WHEN coverage >= 0.03 THEN 0 ELSE 1 END, precision DESC NULLS LAST, tau) = 1 AND coverage >= 0.03 AS picked FROM s", ["n_calls", "picked"], ["tau", "coverage", "precision"],
    )
)
def down_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.down_sweep(_pred(spark, sf_dir), _TAUS, 0.5))


#: 7 x 7 x 5 = 245 policies. The reference tells their number only; the values are ours.
_POLICIES = [0.0, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60], [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60], [0.0, 0.02, 0.05, 0.10, 0.15]
_GRID3 = ", ".join(f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {x})" for x, values in zip("ctm", _POLICIES))
_RECALLS = [f"coalesce(count(*) FILTER (call = {k} AND actual = {k}) / nullif(count(*) FILTER (actual = {k}), 0), 0) AS r{k}, avg(CAST(actual = {k} AS INTEGER)) AS s{k}" for k in range(3)]
_SHORT = ", ".join(f"CASE WHEN s{k} >= 0.1 AND r{k} < 0.15 THEN '{name} recall below 0.15' END" for k, name in enumerate(("DOWN", "FLAT", "UP")))


@query(
    sql(
        [*PRED, "g AS (SELECT c AS confidence, t AS tau, m AS margin, actual, CASE WHEN " + _TOP + f" < c THEN -1 WHEN p_flat >= t THEN 1 WHEN abs(p_up - p_down) < m THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END AS call FROM predictions, {_GRID3})",
         "s AS (SELECT confidence, tau, margin, avg(CAST(call IN (0, 2) AS INTEGER)) AS coverage, count(*) FILTER (call = actual) / nullif(count(*) FILTER (call >= 0), 0) AS accuracy_called, avg(CAST(call = actual AS INTEGER)) AS accuracy_all, " + ", ".join(_RECALLS) + " FROM g GROUP BY 1, 2, 3)",
         f"u AS (SELECT *, least(r0, r1, r2) AS least_recall, nullif(concat_ws('; ', {_SHORT}), '') AS infeasible_reason FROM s)"],
        "SELECT *, infeasible_reason IS NULL AS feasible FROM u", ["feasible", "infeasible_reason"], ["confidence", "tau", "margin", "coverage", "accuracy_called", "accuracy_all", "least_recall"],
    )
)
def policy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.policy_search(_pred(spark, sf_dir), *_POLICIES))


_SIZED = "z AS (SELECT *, CASE predicted WHEN 2 THEN greatest(0, least(1, (p_up - 0.4) / 0.6)) WHEN 0 THEN -greatest(0, least(1, (p_down - 0.4) / 0.6)) ELSE 0 END AS signal FROM predictions)"
#: Acceptance step by step: of each symbol and start only the first wish in order counts, and the next one taken is the earliest that starts after the end of the last.
_ACCEPT = [
    _SIZED,
    "w AS (SELECT symbol, event_start, event_end, id FROM z WHERE signal <> 0 AND realized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, event_start ORDER BY id) = 1)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_start, id) AS i FROM w)",
    "acc AS (SELECT symbol, i, id, event_end AS until, true AS accepted FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.i, o.id, CASE WHEN o.event_start > acc.until THEN o.event_end ELSE acc.until END, o.event_start > acc.until FROM acc JOIN o ON o.symbol = acc.symbol AND o.i = acc.i + 1)",
    "k AS (SELECT z.*, coalesce(acc.accepted, false) AS accepted FROM z LEFT JOIN acc ON acc.id = z.id)",
    "l AS (SELECT *, CASE WHEN accepted THEN signal ELSE 0 END AS live FROM k)",
    "gr AS (SELECT *, sum(abs(live)) OVER (PARTITION BY event_start) AS gross FROM l)",
    "bt AS (SELECT *, live * CASE WHEN gross > 1 THEN 1 / gross ELSE 1 END AS weight FROM gr)",
    "tr AS (SELECT *, weight * realized - abs(weight) * 0.001 AS net FROM bt)",
]


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.backtest(_pred(spark, sf_dir))


@query(_recursive(sql([*PRED, *_ACCEPT], "SELECT id, accepted, signal, weight, net FROM tr", ["id", "accepted"], ["signal", "weight", "net"])))
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trades(spark, sf_dir).select("id", "accepted", "signal", "weight", "net"))


_CURVE = ["dn AS (SELECT event_end AS day, sum(net) AS net FROM tr GROUP BY 1)", "eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY day)) AS equity FROM dn)", "dd AS (SELECT *, equity / max(equity) OVER (ORDER BY day) - 1 AS drawdown FROM eq)"]


@query(_recursive(sql([*PRED, *_ACCEPT, *_CURVE], "SELECT * FROM dd", ["day"], ["net", "equity", "drawdown"])))
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.equity_curve(D.daily_net(_trades(spark, sf_dir))))


@query(_recursive(sql([*PRED, *_ACCEPT, *_CURVE], "SELECT count(*) AS n_days, last(equity ORDER BY day) - 1 AS total_return, min(drawdown) AS max_drawdown, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe FROM dd", ["n_days"], ["total_return", "max_drawdown", "sharpe"])))
def curve_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.curve_figures(D.equity_curve(D.daily_net(_trades(spark, sf_dir)))))


@query(_recursive(sql([*PRED, *_ACCEPT, *_CURVE], "SELECT CAST(day + CAST((12 - isodow(day)) % 7 AS INTEGER) AS DATE) AS week, last(equity ORDER BY day) AS equity FROM dd GROUP BY 1", ["week"], ["equity"])))
def weekly_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.weekly_last(D.equity_curve(D.daily_net(_trades(spark, sf_dir)))))


@query(_recursive(sql([*PRED, *_ACCEPT], "SELECT symbol, count(*) AS n_rows, count(*) FILTER (accepted) AS n_accepted, sum(net) AS net, count(*) FILTER (accepted AND net > 0) / nullif(count(*) FILTER (accepted), 0) AS hit_rate FROM tr GROUP BY 1", ["symbol", "n_rows", "n_accepted"], ["net", "hit_rate"])))
def symbol_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.symbol_figures(_trades(spark, sf_dir)))


@query(sql([*PRED], f"SELECT id, event_start FROM (SELECT id, event_start, row_number() OVER (PARTITION BY event_start ORDER BY {_TOP} DESC, id) AS r FROM predictions) WHERE r <= 2", ["id", "event_start"]))
def top_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_per_day(_pred(spark, sf_dir).withColumn("conf", G.top_probability()), 2, "conf").select("id", "event_start")


@query(
    sql(
        [V.BARS_SQL, "t AS (SELECT symbol, ts, close * volume AS turnover FROM bars)", "m AS (SELECT symbol, ts, CASE WHEN count(turnover) OVER w >= 20 THEN quantile_cont(turnover, 0.5) OVER w END AS med FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING))",
         "l AS (SELECT symbol, ts, lag(med) OVER (PARTITION BY symbol ORDER BY ts) AS med FROM m)"],
        "SELECT symbol, ts, coalesce(med >= quantile_cont(med, 0.75) OVER (PARTITION BY ts), false) AS eligible FROM l", ["symbol", "ts", "eligible"],
    )
)
def liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.liquid(V.bars(spark, sf_dir).withColumn("turnover", F.col("close") * F.col("volume")))


# Quality.

_CELLS = "cells AS (SELECT a AS actual, p AS predicted FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS p))"
_CONF = [*PRED, _CELLS, "cf AS (SELECT CAST(c.actual AS INTEGER) AS actual, CAST(c.predicted AS INTEGER) AS predicted, count(x.id) AS n FROM cells c LEFT JOIN predictions x ON x.actual = c.actual AND x.predicted = c.predicted GROUP BY 1, 2)"]


@query(sql(_CONF, "SELECT * FROM cf", ["actual", "predicted", "n"]))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.confusion(_pred(spark, sf_dir))


@query(
    sql(
        [*_CONF, "t AS (SELECT actual AS class, CAST(sum(n) AS BIGINT) AS support, sum(n) FILTER (actual = predicted) AS tp FROM cf GROUP BY 1)", "k AS (SELECT predicted AS class, sum(n) AS called FROM cf GROUP BY 1)"],
        "SELECT class, support, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(called + support, 0), 0) AS f1 FROM t JOIN k USING (class)", ["class", "support"], ["precision", "recall", "f1"],
    )
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.class_report(_pred(spark, sf_dir)))


@query(
    sql(
        [*_CONF, "s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, " + ", ".join(f"CAST(sum(n) FILTER (actual = {k} AND predicted = {k}) AS DOUBLE) AS tp{k}, CAST(sum(n) FILTER (actual = {k}) AS DOUBLE) AS t{k}, CAST(sum(n) FILTER (predicted = {k}) AS DOUBLE) AS p{k}" for k in range(3)) + " FROM cf)"],
        "SELECT CAST(total AS BIGINT) AS n, (tp0 + tp1 + tp2) / total AS accuracy, (coalesce(tp0 / nullif(t0, 0), 0) + coalesce(tp1 / nullif(t1, 0), 0) + coalesce(tp2 / nullif(t2, 0), 0)) / (CAST(t0 > 0 AS INTEGER) + CAST(t1 > 0 AS INTEGER) + CAST(t2 > 0 AS INTEGER)) AS balanced_accuracy, "
        "(coalesce(2 * tp0 / nullif(t0 + p0, 0), 0) + coalesce(2 * tp1 / nullif(t1 + p1, 0), 0) + coalesce(2 * tp2 / nullif(t2 + p2, 0), 0)) / 3 AS macro_f1, "
        "((tp0 + tp1 + tp2) * total - (t0 * p0 + t1 * p1 + t2 * p2)) / nullif(sqrt((total * total - (p0 * p0 + p1 * p1 + p2 * p2)) * (total * total - (t0 * t0 + t1 * t1 + t2 * t2))), 0) AS mcc FROM s",
        ["n"], ["accuracy", "balanced_accuracy", "macro_f1", "mcc"],
    )
)
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.scores(_pred(spark, sf_dir)))


@query(sql(PRED, "SELECT count(*) FILTER (actual <> 1) AS n_nonflat, count(*) FILTER (actual <> 1 AND actual = predicted) / nullif(count(*) FILTER (actual <> 1), 0) AS accuracy_nonflat, count(*) FILTER (actual <> 1 AND predicted <> 1 AND actual = predicted) / nullif(count(*) FILTER (actual <> 1 AND predicted <> 1), 0) AS accuracy_called, count(*) FILTER (actual <> 1 AND predicted <> 1) / nullif(count(*) FILTER (actual <> 1), 0) AS coverage FROM predictions", ["n_nonflat"], ["accuracy_nonflat", "accuracy_called", "coverage"]))
def directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.directional(_pred(spark, sf_dir)))


@query(
    sql(
        [*PRED, "x AS (" + " UNION ALL ".join(f"SELECT {k} AS class, {p} AS s, actual = {k} AS pos FROM predictions" for k, p in enumerate(_P)) + ")", "r AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS rk FROM x)",
         "a AS (SELECT class, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(rk) FILTER (pos) AS r FROM r GROUP BY 1)"],
        "SELECT class, n_pos, n_neg, (r - n_pos * (n_pos + 1) / 2) / nullif(CAST(n_pos AS DOUBLE) * n_neg, 0) AS auc FROM a", ["class", "n_pos", "n_neg"], ["auc"],
    )
)
def auc_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.auc_by_class(_pred(spark, sf_dir), dict(enumerate(_P))))


_CAL = f"cal AS (SELECT CAST(greatest(ceil({_TOP} * 10) - 1, 0) AS INTEGER) AS bin, count(*) AS n, avg({_TOP}) AS confidence, avg(CAST(actual = predicted AS INTEGER)) AS accuracy FROM predictions GROUP BY 1)"


@query(sql([*PRED, _CAL], "SELECT *, abs(accuracy - confidence) AS gap FROM cal", ["bin", "n"], ["confidence", "accuracy", "gap"]))
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.calibration(_pred(spark, sf_dir)))


@query(sql([*PRED, _CAL], "SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM cal", ["n"], ["ece"]))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.expected_calibration_error(_pred(spark, sf_dir)))


_EDGES = [0, 0.55, 0.60, 0.65, 0.70, 0.80, 1.01]


@query(
    sql(
        [*PRED, "b AS (" + " UNION ALL ".join(f"SELECT {k} AS bucket, {_EDGES[k]}::DOUBLE AS low, {_EDGES[k + 1]}::DOUBLE AS high" for k in range(6)) + ")"],
        f"SELECT bucket, low, high, count(id) AS n, avg(CASE WHEN id IS NOT NULL THEN CAST(actual = predicted AS INTEGER) END) AS accuracy FROM b LEFT JOIN predictions ON {_TOP} >= low AND {_TOP} < high GROUP BY 1, 2, 3", ["bucket", "n"], ["low", "high", "accuracy"],
    )
)
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.bucket_table(_pred(spark, sf_dir), G.top_probability(), _EDGES, F.col("actual") == F.col("predicted")))


@query(sql([*PRED, "c AS (SELECT actual, count(*) AS n FROM predictions GROUP BY 1)", "m AS (SELECT actual, n / (SELECT sum(n) FROM c) AS b FROM c ORDER BY n DESC, actual LIMIT 1)", "a AS (SELECT avg(CAST(actual = predicted AS INTEGER)) AS acc FROM predictions)"], "SELECT actual AS majority_class, b AS baseline, acc AS accuracy, acc - b AS edge, acc > b AS beats FROM m, a", ["majority_class", "beats"], ["baseline", "accuracy", "edge"]))
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.majority_baseline(_pred(spark, sf_dir)))


_BIN = f"greatest(ceil({_TOP} * 10) - 1, 0)"


@query(
    sql(
        PRED,
        "SELECT ts, count(*) AS n, count(*) FILTER (actual = predicted) AS hits, count(*) FILTER (predicted <> 1) AS calls, sum(-ln(greatest(CASE actual WHEN 0 THEN p_down WHEN 1 THEN p_flat ELSE p_up END, 1e-12))) AS log_loss, "
        + ", ".join(f"count(*) FILTER (actual = {i} AND predicted = {j}) AS c{i}{j}" for i in range(3) for j in range(3)) + ", "
        + ", ".join(f"count(*) FILTER ({_BIN} = {k}) AS n{k}, count(*) FILTER ({_BIN} = {k} AND actual = predicted) AS h{k}, coalesce(sum({_TOP}) FILTER ({_BIN} = {k}), 0) AS s{k}" for k in range(10)) + " FROM predictions GROUP BY 1",
        ["ts", "n", "hits", "calls", *[f"c{i}{j}" for i in range(3) for j in range(3)], *[f"{x}{k}" for k in range(10) for x in "nh"]], ["log_loss", *[f"s{k}" for k in range(10)]],
    )
)
def daily_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.daily_statistics(_pred(spark, sf_dir)))


_POS2 = "d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM predictions))"
_PAIR = [V.predictions_sql("pa", 0), V.predictions_sql("pb", 1), "pr AS (SELECT pa.id, pa.ts, pa.actual, pa.predicted AS predicted_a, pb.predicted AS predicted_b, pa.p_up AS p_up_a, pb.p_up AS p_up_b FROM pa JOIN pb USING (id))"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.predictions(spark, sf_dir), V.predictions(spark, sf_dir, 1)
    return J.paired(a, b, ["id", "ts"], "actual", ["predicted", "p_up"])


@query(sql(_PAIR, "SELECT (SELECT count(*) FROM pa) AS n_a, (SELECT count(*) FROM pb) AS n_b, count(*) AS n_paired, (SELECT count(*) FROM pa) - count(*) AS n_only_a, (SELECT count(*) FROM pb) - count(*) AS n_only_b, 0::BIGINT AS n_label_mismatch FROM pr", ["n_a", "n_b", "n_paired", "n_only_a", "n_only_b", "n_label_mismatch"]))
def pairing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pairing_counts(V.predictions(spark, sf_dir), V.predictions(spark, sf_dir, 1), ["id"], "actual")


_DAYS = "dy AS (SELECT ts, avg(CAST(predicted_b = actual AS INTEGER) - CAST(predicted_a = actual AS INTEGER)) AS delta FROM pr GROUP BY 1)"


@query(sql([*_PAIR, _DAYS], "SELECT count(delta) AS n_dates, avg(delta) AS mean_delta, avg(delta) / nullif(stddev_samp(delta) / sqrt(count(delta)), 0) AS t FROM dy", ["n_dates"], ["mean_delta", "t"]))
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.paired_test(_pairs(spark, sf_dir)))


@query()
def clustered_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustered_bootstrap(_pairs(spark, sf_dir))


_TAIL = "list_sum(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))"
_MC = f"least(1.0, 2 * {_TAIL})"


@query(sql([*_PAIR, "m AS (SELECT count(*) AS n, count(*) FILTER (predicted_a = actual AND predicted_b <> actual) AS a, count(*) FILTER (predicted_b = actual AND predicted_a <> actual) AS b FROM pr)"], f"SELECT n, a AS only_a, b AS only_b, {_MC} AS p_value FROM m", ["n", "only_a", "only_b"], ["p_value"]))
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.mcnemar(_pairs(spark, sf_dir)))


@query(sql(_PAIR, "SELECT predicted_a, predicted_b, count(*) AS n, avg(CAST(predicted_a = actual AS INTEGER)) AS hit_a, avg(CAST(predicted_b = actual AS INTEGER)) AS hit_b FROM pr WHERE predicted_a <> predicted_b GROUP BY 1, 2", ["predicted_a", "predicted_b", "n"], ["hit_a", "hit_b"]))
def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.flips(_pairs(spark, sf_dir)))


_LOSS = "ls AS (SELECT ts, avg(CAST(predicted_a <> actual AS INTEGER)) AS a, avg(CAST(predicted_b <> actual AS INTEGER)) AS b FROM pr GROUP BY 1)"
_DM = [*_PAIR, _LOSS, "dx AS (SELECT ts, a - b AS d, avg(a - b) OVER () AS m, count(*) OVER () AS n FROM ls)", "ex AS (SELECT ts, d - m AS e, m, n FROM dx)", "lg AS (SELECT n, m, e, " + ", ".join(f"e * lag(e, {k}) OVER (ORDER BY ts) AS g{k}" for k in range(1, 6)) + " FROM ex)"]


@query(sql([*_DM, "v AS (SELECT any_value(n) AS n, any_value(m) AS mean_diff, avg(e * e) + " + " + ".join(f"2 * {1 - k / 6!r} * coalesce(avg(g{k}), 0)" for k in range(1, 6)) + " AS variance FROM lg)"], "SELECT n, mean_diff, variance, CASE WHEN n >= 10 AND variance > 0 THEN mean_diff / sqrt(variance / n) END AS dm FROM v", ["n"], ["mean_diff", "variance", "dm"]))
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).groupBy("ts").agg(F.avg((F.col("predicted_a") != F.col("actual_a")).cast("double")).alias("loss_a"), F.avg((F.col("predicted_b") != F.col("actual_b")).cast("double")).alias("loss_b"))
    return rounded(G.diebold_mariano(p).select("n", "mean_diff", "variance", "dm"))


_PSI_COLS = ["p_down", "p_flat", "p_up"]


def _psi_sql(is_ref: str, name: str = "predictions", columns: list[str] = _PSI_COLS) -> list[str]:
    """Stability of the columns of a table (as ps and ed); rows that are neither reference (true) nor current (false) are null."""
    return [
        "lng AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, {is_ref} AS is_ref FROM {name} WHERE {c} IS NOT NULL" for c in columns) + ")",
        "ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (is_ref))) AS e, count(*) FILTER (is_ref) AS n_reference, count(*) FILTER (NOT is_ref) AS n_current FROM lng GROUP BY 1)",
        "bn AS (SELECT l.feature, is_ref, CASE WHEN x = e[len(e)] THEN len(e) - 1 WHEN x >= e[1] AND x < e[len(e)] THEN len(list_filter(e, lambda v: v <= x)) END AS b FROM lng l JOIN ed USING (feature))",
        "ct AS (SELECT feature, b, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM bn WHERE b IS NOT NULL GROUP BY 1, 2)",
        "al AS (SELECT feature, unnest(range(1, len(e))) AS b FROM ed)", "fu AS (SELECT al.feature, al.b, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM al LEFT JOIN ct ON al.feature = ct.feature AND al.b = ct.b)",
        "sh AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS r, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS c FROM fu)", "ps0 AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY 1)",
        "ps AS (SELECT ed.feature, n_reference, n_current, CASE WHEN n_reference >= 30 AND n_current >= 10 THEN psi END AS psi FROM ed LEFT JOIN ps0 ON ed.feature = ps0.feature)",
    ]


#: Sixty newest dates against those five times as far back.
DRIFT = [_POS2, *_psi_sql("(SELECT CASE WHEN pos <= n - 300 THEN true WHEN pos >= n - 60 THEN false END FROM d WHERE d.ts = predictions.ts)")]


@query(sql([*PRED, *_psi_sql("ts < DATE '1996-01-01'")], "SELECT * FROM ps", ["feature", "n_reference", "n_current"], ["psi"]))
def stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    early = F.col("ts") < F.lit("1996-01-01").cast("date")
    return rounded(G.stability_index(p.where(early), p.where(~early), _PSI_COLS))


@query(sql(PRED, "SELECT date_trunc('month', ts)::DATE AS segment, count(*) AS n, count(DISTINCT ts) AS n_dates, avg(CAST(actual = predicted AS INTEGER)) AS accuracy, avg(CAST(predicted <> 1 AS INTEGER)) AS coverage, count(*) >= 100 AND count(DISTINCT ts) >= 20 AS enough FROM predictions GROUP BY 1", ["segment", "n", "n_dates", "enough"], ["accuracy", "coverage"]))
def month_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.segments(_pred(spark, sf_dir), F.trunc("ts", "month")))


_QBIN = f"q AS (SELECT list_distinct(quantile_cont({_TOP}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM predictions)"


@query(sql([*PRED, _QBIN, f"b AS (SELECT p.*, greatest(len(list_filter(e, lambda v: v < {_TOP})), 1) AS segment FROM predictions p, q)"], "SELECT CAST(segment AS INTEGER) AS segment, count(*) AS n, count(DISTINCT ts) AS n_dates, avg(CAST(actual = predicted AS INTEGER)) AS accuracy, avg(CAST(predicted <> 1 AS INTEGER)) AS coverage, count(*) >= 100 AND count(DISTINCT ts) >= 20 AS enough FROM b GROUP BY 1", ["segment", "n", "n_dates", "enough"], ["accuracy", "coverage"]))
def quintile_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.quantile_bucket(_pred(spark, sf_dir).withColumn("conf", G.top_probability()), "conf", 5, "quintile")
    return rounded(G.segments(p, F.col("quintile")))


# Studies.

_ERA = "u AS (SELECT *, date_diff('day', DATE '1970-01-01', ts)::DOUBLE AS t FROM predictions WHERE actual = 2)", "q AS (SELECT list_distinct(quantile_cont(t, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM u)", "er AS (SELECT u.*, CAST(greatest(len(list_filter(e, lambda v: v < t)), 1) AS INTEGER) AS era FROM u, q)"
_RATES = "rt AS (SELECT CAST(substr(symbol, 2) AS INTEGER) % 5 AS slice, era, count(*) AS n, avg(CAST(predicted <> 2 AS INTEGER)) AS miss_rate, count(*) >= 50 AS reliable FROM er GROUP BY GROUPING SETS ((1), (1, 2)))"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.slice_miss_rates(_pred(spark, sf_dir), F.substring("symbol", 2, 9).cast("int") % 5, least=50)


@query(sql([*PRED, *_ERA, _RATES], "SELECT * FROM rt", ["slice", "era", "n", "reliable"], ["miss_rate"]))
def slice_miss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rates(spark, sf_dir))


@query(sql([*PRED, *_ERA, _RATES, "s AS (SELECT slice, count(*) AS n_eras, max(miss_rate) - min(miss_rate) AS spread FROM rt WHERE era IS NOT NULL AND reliable GROUP BY 1)"], "SELECT *, n_eras >= 3 AND spread < 0.25 AS stable FROM s", ["slice", "n_eras", "stable"], ["spread"]))
def stable_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.stable_slices(_rates(spark, sf_dir)))


@query(sql(PRED, "SELECT predicted, count(*) AS n, avg(p_down) AS p_down, avg(p_flat) AS p_flat, avg(p_up) AS p_up FROM predictions WHERE actual = 2 GROUP BY 1", ["predicted", "n"], _P))
def class_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.class_cells(_pred(spark, sf_dir)))


@query(sql(PRED, "SELECT id, symbol, ts, predicted, greatest(p_down, p_flat) AS confidence FROM predictions WHERE actual = 2 AND predicted <> 2 ORDER BY confidence DESC, id LIMIT 25", ["id", "symbol", "ts", "predicted"], ["confidence"]))
def worst_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.worst_misses(_pred(spark, sf_dir), 25))


@query(sql([*PRED, "a AS (SELECT actual AS class, count(*) AS a FROM predictions GROUP BY 1)", "p AS (SELECT predicted AS class, count(*) AS p FROM predictions GROUP BY 1)", "n AS (SELECT count(*) AS n FROM predictions)"], "SELECT class, coalesce(a, 0) / n AS actual_share, coalesce(p, 0) / n AS predicted_share, (coalesce(p, 0) - coalesce(a, 0)) / n * 100 AS bias_pp FROM a FULL JOIN p USING (class), n", ["class"], ["actual_share", "predicted_share", "bias_pp"]))
def prediction_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.prediction_bias(_pred(spark, sf_dir)))


@query(sql([*PRED, "m AS (SELECT actual AS c, avg(p_down) AS d, avg(p_flat) AS f, avg(p_up) AS u FROM predictions GROUP BY 1)"], "SELECT avg((abs(x.d - y.d) + abs(x.f - y.f) + abs(x.u - y.u)) / 2) AS separation FROM m x JOIN m y ON x.c < y.c", [], ["separation"]))
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.separation(_pred(spark, sf_dir)))


@query(sql([*PRED, "x AS (SELECT predicted, list_reverse_sort([p_down, p_flat, p_up]) AS l FROM predictions)"], "SELECT predicted, count(*) AS n, avg(l[1]) AS mean_top, avg(CAST(l[1] < 0.5 AS INTEGER)) AS share_below_half, quantile_cont(l[1] - l[2], 0.5) AS median_margin FROM x GROUP BY 1", ["predicted", "n"], ["mean_top", "share_below_half", "median_margin"]))
def conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.conviction(_pred(spark, sf_dir)))


@query(sql([*PRED, "d AS (SELECT ts, avg(CAST(actual = predicted AS INTEGER)) AS accuracy FROM predictions GROUP BY 1)"], "SELECT *, avg(accuracy) OVER (ORDER BY ts ROWS 29 PRECEDING) AS rolling FROM d", ["ts"], ["accuracy", "rolling"]))
def rolling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.rolling_daily(_pred(spark, sf_dir)))


_MEMBERS = 'b AS (SELECT bars.symbol, ts, close, volume, bucket FROM bars LEFT JOIN membership m ON bars.symbol = m.symbol AND ts >= m."from" AND (m."to" IS NULL OR ts <= m."to"))'


@query(
    sql(
        [V.BARS_SQL, V.MEMBERSHIP_SQL, _MEMBERS, "l AS (SELECT *, CASE WHEN bucket IS NOT NULL THEN volume >= quantile_cont(volume, 0.8) OVER (PARTITION BY bucket) END AS leader FROM b)", "d AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM b))",
         "m AS (SELECT bucket, ts, avg(close) AS m FROM l WHERE leader GROUP BY 1, 2)"],
        "SELECT l.symbol, l.ts, l.bucket, m.m AS leaders_before FROM l JOIN d ON d.ts = l.ts LEFT JOIN m ON m.bucket = l.bucket AND m.ts = d.prev WHERE NOT l.leader", ["symbol", "ts", "bucket"], ["leaders_before"],
    )
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = J.interval_join(V.bars(spark, sf_dir).select("symbol", "ts", "close", "volume"), V.membership(spark, sf_dir))
    return rounded(H.lead_lag(H.leaders(b, "bucket", "volume"), "bucket", "close").select("symbol", "ts", "bucket", "leaders_before"))


@query()
def backtest_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pred(spark, sf_dir)
    daily = t.groupBy(F.col("ts").alias("day")).agg(F.avg(F.when(F.col("predicted") == 2, F.col("realized")).otherwise(0.0)).alias("long"), F.avg(F.when(F.col("predicted") == 0, -F.col("realized")).otherwise(0.0)).alias("short"), F.avg(F.col("realized") * (F.col("p_up") - F.col("p_down"))).alias("both"))
    return H.overfitting(daily, ["long", "short", "both"])


@query(sql([*_PAIR], "SELECT corr(ra, rb) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM (SELECT avg(p_up_a) AS a, avg(p_up_b) AS b FROM pr GROUP BY ts))", [], ["spearman"]))
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).groupBy("ts").agg(F.avg("p_up_a").alias("a"), F.avg("p_up_b").alias("b"))
    return rounded(G.rank_correlation(p, "a", "b").select("spearman"))
