"""Queries of reports: freshness, axes, subsets, verdicts, digests and hits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.scalars import whole
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import quality as G
from tidemark.operators import reports as R
from tidemark.operators import studies as H
from tidemark.plans.model_queries import _BIN, _DM, _LOSS, _P, _POS2, DRIFT, ORACLE_SQL as MODEL_SQL, PRED, _pairs, _pred, _psi_sql
from tidemark.plans.oracle import rounded, sql
from tidemark.plans.panel_queries import _RET, _barrier_sql
from tidemark.plans.study_queries import _EXPL, _SCORED, _SPLIT, _explained
from tidemark.sources import files as S
from tidemark.sources import views as V
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Freshness.

_STEPS = [
    "lt AS (SELECT source, CAST(max(received_at) AS DATE) AS as_of, max(received_at) AS updated_at FROM news_articles GROUP BY 1)",
    "nw AS (SELECT max(received_at) AS now FROM news_articles)",
    "sp AS (SELECT f.source AS step, as_of, CAST(now AS DATE) AS expected, updated_at, CASE WHEN as_of IS NOT NULL THEN 'complete' END AS state, f.tz = 'UTC' AS age_based, now FROM feed_sources f LEFT JOIN lt ON lt.source = f.source, nw)",
    "lg AS (SELECT *, CASE WHEN as_of IS NULL OR age_based THEN 0 ELSE CAST((SELECT count(*) FROM unnest(generate_series(as_of + 1, expected, INTERVAL 1 DAY)) t(d) WHERE isodow(d) <= 5) AS INTEGER) END AS lag_sessions FROM sp)",
    "st AS (SELECT *, CASE WHEN state IS NULL AND as_of IS NULL THEN 'missing' WHEN age_based THEN CASE WHEN floor((epoch_us(now) - epoch_us(updated_at)) / 86400000000) <= 45 THEN 'fresh' ELSE 'stale' END WHEN as_of IS NULL THEN 'partial' WHEN lag_sessions > 0 THEN 'stale' ELSE 'fresh' END AS status FROM lg)",
]


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news_articles")
    latest = news.groupBy("source").agg(F.to_date(F.max("received_at")).alias("as_of"), F.max("received_at").alias("updated_at"))
    now = whole(news, at=F.max("received_at"))["at"]
    feeds = table(spark, sf_dir, "feed_sources").select("source", (F.col("tz") == "UTC").alias("age_based"))
    steps = feeds.join(latest, "source", "left").select(F.col("source").alias("step"), "as_of", F.to_date(now).alias("expected"), "updated_at", F.when(F.col("as_of").isNotNull(), "complete").alias("state"), "age_based")
    return R.step_status(steps, now)


@query(sql(_STEPS, "SELECT step, as_of, lag_sessions, status FROM st", ["step", "as_of", "lag_sessions", "status"]))
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("step", "as_of", "lag_sessions", "status")


@query(sql(_STEPS, "SELECT count(*) AS n_steps, coalesce(string_agg(step, ',' ORDER BY step) FILTER (status = 'stale'), '') AS stale, coalesce(string_agg(step, ',' ORDER BY step) FILTER (status = 'missing'), '') AS missing, coalesce(string_agg(step, ',' ORDER BY step) FILTER (status IN ('stale', 'missing') AND NOT age_based), '') AS actionable FROM st", ["n_steps", "stale", "missing", "actionable"]))
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.health_summary(_statuses(spark, sf_dir), ~F.col("age_based"))


@query("SELECT count(*) AS n_rows, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.time_bounds(spark, f"{sf_dir}/orders.parquet", "o_orderdate")


# Axes.

_CELLS9 = [f"c{i}{j}" for i in range(3) for j in range(3)]
_TOP = "greatest(p_down, p_flat, p_up)"
_SUMS = (
    "sm AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (actual = predicted) AS DOUBLE) AS hits, CAST(count(*) FILTER (predicted <> 1) AS DOUBLE) AS calls, sum(-ln(greatest(CASE actual WHEN 0 THEN p_down WHEN 1 THEN p_flat ELSE p_up END, 1e-12))) AS loss, "
    + ", ".join(f"CAST(count(*) FILTER (actual = {i} AND predicted = {j}) AS DOUBLE) AS c{i}{j}" for i in range(3) for j in range(3)) + ", "
    + ", ".join(f"count(*) FILTER ({_BIN} = {k}) AS n{k}, count(*) FILTER ({_BIN} = {k} AND actual = predicted) AS h{k}, coalesce(sum({_TOP}) FILTER ({_BIN} = {k}), 0) AS s{k}" for k in range(10)) + " FROM predictions)"
)
_MARGINS = "mg AS (SELECT *, " + ", ".join(f"c{k}0 + c{k}1 + c{k}2 AS t{k}, c0{k} + c1{k} + c2{k} AS k{k}" for k in range(3)) + " FROM sm)"
_AXES_SQL = (
    "SELECT hits / n AS accuracy_all, (c00 + c22) / calls AS accuracy_called, calls / n AS coverage, (coalesce(c00 / nullif(t0, 0), 0) + coalesce(c11 / nullif(t1, 0), 0) + coalesce(c22 / nullif(t2, 0), 0)) / (CAST(t0 > 0 AS INTEGER) + CAST(t1 > 0 AS INTEGER) + CAST(t2 > 0 AS INTEGER)) AS balanced_accuracy, "
    "((c00 + c11 + c22) * n - (t0 * k0 + t1 * k1 + t2 * k2)) / nullif(sqrt((n * n - (k0 * k0 + k1 * k1 + k2 * k2)) * (n * n - (t0 * t0 + t1 * t1 + t2 * t2))), 0) AS mcc, loss / n AS log_loss, ("
    + " + ".join(f"n{k} * abs(coalesce(h{k} / nullif(n{k}, 0), 0) - coalesce(s{k} / nullif(n{k}, 0), 0))" for k in range(10)) + ") / n AS ece, "
    + ", ".join(f"coalesce(c{k}{k} / nullif(t{k}, 0), 0) AS recall_{k}" for k in range(3)) + " FROM mg"
)


@query(sql([*PRED, _SUMS, _MARGINS], _AXES_SQL, [], list(R.AXES)))
def axis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.axis_points(G.daily_statistics(_pred(spark, sf_dir))))


@query()
def axis_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.axis_deltas(G.daily_statistics(_pred(spark, sf_dir)), G.daily_statistics(V.predictions(spark, sf_dir, 1))))


@query(sql([*PRED, _SUMS, _MARGINS, f"ax AS ({_AXES_SQL})"], "SELECT 0.5 * balanced_accuracy + 0.25 * (mcc + 1) AS selection FROM ax", [], ["selection"]))
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.selection_score(G.scores(_pred(spark, sf_dir))).select("selection"))


@query(sql([*PRED, _POS2, _SPLIT, f"sc AS ({_SCORED})", "g AS (SELECT (SELECT accuracy FROM sc WHERE split = 'train') AS a, (SELECT accuracy FROM sc WHERE split = 'test') AS b)"], "SELECT a AS train_accuracy, b AS test_accuracy, (a - b) * 100 AS gap_pp, (a - b) * 100 > 20 AS memorised, b > 0.65 AS too_good FROM g", ["memorised", "too_good"], ["train_accuracy", "test_accuracy", "gap_pp"]))
def memory_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.memory_flags(G.scores_by(L.three_way_split(_pred(spark, sf_dir)), "split")))


@query(MODEL_SQL["diebold_mariano"].replace(_LOSS, _LOSS.replace("predicted_a <> actual", "(predicted_a = 2) <> (actual = 2)").replace("predicted_b <> actual", "(predicted_b = 2) <> (actual = 2)")))
def diebold_mariano_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``diebold_mariano``, of one class against the rest."""
    loss = lambda s: F.avg(((F.col(f"predicted_{s}") == 2) != (F.col(f"actual_{s}") == 2)).cast("double")).alias(f"loss_{s}")
    return rounded(G.diebold_mariano(_pairs(spark, sf_dir).groupBy("ts").agg(loss("a"), loss("b"))).select("n", "mean_diff", "variance", "dm"))


# Drift.

_IMPORTANCE = "im AS (SELECT feature, avg(abs(contribution)) AS mean_abs, row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS rank FROM ex GROUP BY 1)"


@query(sql([*PRED, _EXPL, _IMPORTANCE, *DRIFT], "SELECT im.feature, rank, rank <= 15 AS in_top, coalesce(psi >= 0.2, false) AS drift, mean_abs, psi FROM im LEFT JOIN ps ON ps.feature = im.feature", ["feature", "rank", "in_top", "drift"], ["mean_abs", "psi"]))
def importance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.importance_drift(G.importance_shares(_explained(spark, sf_dir)), G.recent_drift(_pred(spark, sf_dir), _P, 60)))


_MEASURES = ["ret_20", "volatility_20", "news_count"]
_PANEL_DRIFT = [
    "d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM feature_panel WHERE ts IS NOT NULL))",
    *_psi_sql("(SELECT CASE WHEN pos <= n - 100 THEN true WHEN pos >= n - 20 THEN false END FROM d WHERE d.ts = feature_panel.ts)", "feature_panel", _MEASURES),
    "ms AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INTEGER)) AS missing_rate FROM feature_panel" for c in _MEASURES) + ")",
]


@query(sql(_PANEL_DRIFT, "SELECT ms.feature, psi, missing_rate, coalesce(psi >= 0.2, false) AND ms.feature <> 'news_count' AS alert FROM ms LEFT JOIN ps ON ps.feature = ms.feature", ["feature", "alert"], ["psi", "missing_rate"]))
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = table(spark, sf_dir, "feature_panel").select("ts", *_MEASURES)
    watched = spark.createDataFrame([("ret_20",), ("volatility_20",)], "feature string")
    return rounded(R.drift_alerts(panel, G.recent_drift(panel, _MEASURES, 20), _MEASURES, watched))


# Subsets and verdicts.

_SIGN = "CASE WHEN realized > 0.02 THEN 'positive' WHEN realized < -0.02 THEN 'negative' ELSE 'neutral' END"
_SUBSETS = [
    "u AS (SELECT *, date_diff('day', DATE '1970-01-01', ts)::DOUBLE AS t FROM predictions)", "q AS (SELECT list_distinct(quantile_cont(t, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM u)",
    f"b AS (SELECT {_SIGN} AS subset, CAST(greatest(len(list_filter(e, lambda v: v < t)), 1) AS INTEGER) AS era, actual = 2 AS pos, predicted <> 2 AS miss, p_up AS score FROM u, q)",
    "rk AS (SELECT subset, pos, rank() OVER (PARTITION BY subset ORDER BY score) + (count(*) OVER (PARTITION BY subset, score) - 1) / 2.0 AS r FROM b)",
    "au AS (SELECT subset, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(CAST(count(*) FILTER (pos) AS DOUBLE) * count(*) FILTER (NOT pos), 0) AS auc FROM rk GROUP BY 1)",
    "er AS (SELECT subset, era, avg(CAST(miss AS INTEGER)) AS r FROM b WHERE pos GROUP BY 1, 2 HAVING count(*) >= 50)", "es AS (SELECT subset, count(*) AS n_eras, max(r) - min(r) AS spread FROM er GROUP BY 1)",
    "g AS (SELECT subset, count(*) AS n, count(*) FILTER (pos) AS n_label, avg(CAST(miss AS INTEGER)) FILTER (pos) AS miss_rate FROM b GROUP BY 1)",
]


@query(sql([*PRED, *_SUBSETS], "SELECT g.subset, n, n_label, miss_rate, CASE WHEN n_label >= 200 AND n - n_label >= 50 THEN auc END AS auc, coalesce(n_eras, 0) AS n_eras, n >= 200 AS reliable, coalesce(n_eras >= 3 AND spread < 0.25, false) AS cross_era FROM g LEFT JOIN au ON au.subset = g.subset LEFT JOIN es ON es.subset = g.subset", ["subset", "n", "n_label", "n_eras", "reliable", "cross_era"], ["miss_rate", "auc"]))
def subset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.subset_report(_pred(spark, sf_dir), F.expr(_SIGN)))


_RULES = {"class_overlap": "separation < 0.05 and below_half > 0.4", "tie_break": "below_tau > 0.5 and (fallback_down >= 0.75 or fallback_down <= 0.25)", "overfit": "gap_pp >= 10", "drift": "drift_share >= 0.3"}
_EVIDENCE = [
    "m AS (SELECT actual AS c, avg(p_down) AS d, avg(p_flat) AS f, avg(p_up) AS u FROM predictions GROUP BY 1)",
    f"sc AS ({_SCORED})", *DRIFT[1:],
    f"ev AS (SELECT (SELECT avg((abs(x.d - y.d) + abs(x.f - y.f) + abs(x.u - y.u)) / 2) FROM m x JOIN m y ON x.c < y.c) AS separation, (SELECT avg(CAST({_TOP} < 0.5 AS INTEGER)) FROM predictions) AS below_half, (SELECT avg(CAST(p_flat < 0.4 AS INTEGER)) FROM predictions) AS below_tau, (SELECT avg(CAST(p_down >= p_up AS INTEGER)) FROM predictions WHERE p_flat < 0.4) AS fallback_down, "
    "((SELECT accuracy FROM sc WHERE split = 'train') - (SELECT accuracy FROM sc WHERE split = 'test')) * 100 AS gap_pp, (SELECT avg(CAST(coalesce(psi, 0) >= 0.2 AS INTEGER)) FROM ps) AS drift_share)",
]


@query(sql([*PRED, _POS2, _SPLIT, *_EVIDENCE], " UNION ALL ".join(f"SELECT '{name}' AS id, CASE WHEN {cond} THEN 'supported' ELSE 'rejected' END AS verdict FROM ev" for name, cond in _RULES.items()), ["id", "verdict"]))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    own = whole(p, half=F.avg((G.top_probability() < 0.5).cast("double")), tau=F.avg((F.col("p_flat") < 0.4).cast("double")), down=F.avg(F.when(F.col("p_flat") < 0.4, (F.col("p_down") >= F.col("p_up")).cast("double"))))
    gap = whole(R.memory_flags(G.scores_by(L.three_way_split(p), "split")), gap=F.first("gap_pp"))
    drift = whole(G.recent_drift(p, _P, 60), share=F.avg((F.coalesce("psi", F.lit(0.0)) >= 0.2).cast("double")))
    evidence = H.separation(p).select("separation", own["half"].alias("below_half"), own["tau"].alias("below_tau"), own["down"].alias("fallback_down"), gap["gap"].alias("gap_pp"), drift["share"].alias("drift_share"))
    return R.verdicts(evidence, _RULES)


@query(sql([*PRED, _POS2, _SPLIT, "o AS (SELECT id, split, list_reverse_sort([p_down, p_flat, p_up]) AS l FROM sp)"], "SELECT id, split, l[1] AS max_p, l[1] - l[2] AS margin FROM o", ["id", "split"], ["max_p", "margin"]))
def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    return rounded(R.scored_panel(p, L.three_way_split(p.select("id", "ts"))))


@query(sql(PRED, "SELECT actual AS truth, count(*) AS n, avg(p_down) AS p_down, avg(p_flat) AS p_flat, avg(p_up) AS p_up FROM predictions GROUP BY 1", ["truth", "n"], _P))
def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probabilities of each true class."""
    return rounded(_pred(spark, sf_dir).groupBy(F.col("actual").alias("truth")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in _P]))


@query(sql([*PRED, "o AS (SELECT predicted, list_reverse_sort([p_down, p_flat, p_up]) AS l FROM predictions)"], "SELECT predicted, CASE WHEN l[1] - l[2] < 0.05 THEN 0 WHEN l[1] - l[2] < 0.1 THEN 1 WHEN l[1] - l[2] < 0.2 THEN 2 WHEN l[1] - l[2] < 1.01 THEN 3 END AS bucket, count(*) AS n FROM o GROUP BY 1, 2", ["predicted", "bucket", "n"]))
def margin_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the likeliest class leads, by predicted class."""
    ordered = F.sort_array(F.array(*_P), asc=False)
    return _pred(spark, sf_dir).groupBy("predicted", G.bucket_of(ordered[0] - ordered[1], [0, 0.05, 0.1, 0.2, 1.01]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Ledger, hits, labels, contexts.


@query(sql([V.LEDGER_SQL], "SELECT seq, ledger.vote, conf, coalesce(length(thinking), 0) AS thinking_chars, coalesce(length(content), 0) AS content_chars, coalesce(length(thinking), 0) + coalesce(length(content), 0) AS trace_len FROM ledger JOIN harness_results ON seq = msg_id", ["seq", "vote", "thinking_chars", "content_chars", "trace_len"], ["conf"]))
def traced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with the lengths of their trace."""
    digest = R.trace_digest(table(spark, sf_dir, "harness_results"), "msg_id").withColumnRenamed("msg_id", "seq")
    return rounded(V.ledger(spark, sf_dir).select("seq", "vote", "conf").join(digest, "seq"))


def _hits_sql() -> str:
    one = lambda kind, p: f"SELECT msg_id, '{kind}' AS kind, unnest(" + (f"regexp_extract_all(t, '(?i){p}')" if p != T._ISO_DATE else f"list_filter(regexp_extract_all(t, '{p}'), lambda d: coalesce(TRY_CAST(d AS DATE) > decision_date, true))") + ") AS hit FROM x"
    return "WITH x AS (SELECT msg_id, decision_date, concat_ws(' ', thinking, content) AS t FROM harness_results) " + " UNION ALL ".join(one(kind, p) for kind, ps in T.LEAK_PATTERNS.items() for p in ps)


@query(_hits_sql())
def leak_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "harness_results").select("msg_id", "decision_date", F.concat_ws(" ", "thinking", "content").alias("t"))
    return R.leak_hits(h, "msg_id", "t", "decision_date").select("msg_id", "kind", "hit")


@query(sql([V.BARS_SQL, _RET, *_barrier_sql()], "SELECT bars.symbol, bars.ts, label_raw + 1 AS label, close FROM bars JOIN tb ON tb.symbol = bars.symbol AND tb.ts = bars.ts", ["symbol", "ts", "label"], ["close"]))
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir)
    return rounded(J.with_labels(b.select("symbol", "ts", "close"), L.triple_barrier(b).select("symbol", "ts", "label"), ["symbol", "ts"], "label"))


@query("WITH c AS (SELECT DISTINCT upper(trim(symbol)) AS symbol FROM news_articles WHERE symbol IS NOT NULL), v AS (SELECT upper(trim(symbol)) AS symbol, bucket, cap_group, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY valid_from NULLS FIRST, bucket, cap_group NULLS FIRST) AS r FROM symbol_versions WHERE bucket IS NOT NULL) SELECT c.symbol, bucket, cap_group FROM c LEFT JOIN v ON v.symbol = c.symbol AND r = 1")
def case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bucket and group of each symbol in the news."""
    cases = table(spark, sf_dir, "news_articles").where("symbol is not null").select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    tagged = table(spark, sf_dir, "symbol_versions").select(F.upper(F.trim("symbol")).alias("symbol"), F.col("valid_from").alias("start"), "bucket", "cap_group")
    return R.first_bucket(cases, tagged, "symbol", ["bucket", "cap_group"])


@query("WITH g AS (SELECT o_orderstatus AS status, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1) SELECT CAST(max(last) AS VARCHAR) AS as_of, count(*) AS n, array_to_string(list('{\"status\":\"' || status || '\",\"n\":' || n || ',\"last\":\"' || CAST(last AS VARCHAR) || '\"}' ORDER BY status), ';') AS rows FROM g")
def status_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as one JSON report."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.to_date(F.max("o_orderdate")).alias("last"))
    return R.envelope(g, F.col("last"), ["status"]).withColumn("rows", F.array_join("rows", ";"))
