"""Queries of the remaining joins, decisions, quality figures and studies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decisions as D
from tidemark.operators import features as X
from tidemark.operators import ingest as I
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import ledger as K
from tidemark.operators import quality as G
from tidemark.operators import studies as H
from tidemark.plans.model_queries import _ACCEPT, _MC, _PAIR, _POS2, _P, DRIFT, PRED, _pairs, _pred, _recursive, _trades
from tidemark.plans.oracle import rounded, sql
from tidemark.plans.panel_queries import _GRID, _decided, _grid, _n, _z, DECIDED, W_
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


_TONE = ["tone_count", "tone_mean", "tone_z20", "tone_available", "tone_coverage_60"]
_EVENT_DATES = ["x AS (SELECT min(session) AS a, max(session) AS z FROM sessions)", "y AS (SELECT *, least(greatest(CAST(published_utc + INTERVAL 330 MINUTE AS DATE), a), z) AS d FROM articles, x)", "ed AS (SELECT *, (SELECT min(session) FROM sessions WHERE session >= d) AS decision_date FROM y)"]


@query(
    sql(
        [V.ARTICLES_SQL, V.SESSIONS_SQL, *_EVENT_DATES, _GRID, "t AS (SELECT symbol, decision_date AS ts, count(score) AS n, avg(score) AS tone_mean FROM ed GROUP BY 1, 2)", "j AS (SELECT g.symbol, g.ts, coalesce(CAST(n AS DOUBLE), 0) AS tone_count, tone_mean FROM g LEFT JOIN t ON g.symbol = t.symbol AND g.ts = t.ts)"],
        f"SELECT *, {_z('tone_mean', 20, 5)} AS tone_z20, CASE WHEN tone_count > 0 THEN 1.0 ELSE 0.0 END AS tone_available, CASE WHEN sum(tone_count) {_n(60)} > 0 THEN 1.0 ELSE 0.0 END AS tone_coverage_60 FROM j", ["symbol", "ts"], _TONE,
    )
)
def event_tone_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = J.with_event_session(V.articles(spark, sf_dir), V.sessions(spark, sf_dir))
    return rounded(X.scored_text_features(_grid(spark, sf_dir), e, "tone").select("symbol", "ts", *_TONE))


_FAM = "pd AS (SELECT symbol, decision_date AS ts, count(*) AS n FROM dd WHERE decision_date IS NOT NULL AND subject = 'purchase' GROUP BY 1, 2)", "vw AS (SELECT symbol, decision_date AS ts, count(*) AS n FROM dd WHERE decision_date IS NOT NULL AND subject = 'view' GROUP BY 1, 2)"


@query(sql([*DECIDED, *_FAM], "SELECT coalesce(pd.symbol, vw.symbol) AS symbol, coalesce(pd.ts, vw.ts) AS ts, pd.n AS bought_n, vw.n AS seen_n FROM pd FULL JOIN vw ON pd.symbol = vw.symbol AND pd.ts = vw.ts", ["symbol", "ts", "bought_n", "seen_n"]))
def aligned_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir)
    count = lambda s: d.where(F.col("subject") == s).groupBy("symbol", F.col("decision_date").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return J.aligned({"bought": count("purchase"), "seen": count("view")}, ["symbol", "ts"])


@query(sql([V.BARS_SQL, V.MACRO_SQL], "SELECT symbol, bars.ts, close, m_high FROM bars LEFT JOIN macro ON bars.ts = macro.ts", ["symbol", "ts"], ["close", "m_high"]))
def joined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = V.macro(spark, sf_dir).select("ts", "m_high", F.lit(0.0).alias("close"))
    return rounded(J.join_without_overlap(V.bars(spark, sf_dir).select("symbol", "ts", "close"), market, ["ts"]).select("symbol", "ts", "close", "m_high"))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.validated_join(o, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


_SIDES = "la AS (SELECT ts, sum(realized) AS v FROM predictions WHERE predicted = 2 GROUP BY 1)", "sb AS (SELECT ts, sum(realized) AS v FROM predictions WHERE predicted = 0 GROUP BY 1)"


@query(sql([*PRED, *_SIDES], "SELECT coalesce(la.ts, sb.ts) AS ts, coalesce(la.v, 0) AS a, coalesce(sb.v, 0) AS b FROM la FULL JOIN sb ON la.ts = sb.ts", ["ts"], ["a", "b"]))
def outer_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    side = lambda k: p.where(F.col("predicted") == k).groupBy("ts").agg(F.sum("realized").alias("v"))
    return rounded(J.outer_aligned(side(2), side(0), "ts", "v"))


@query(sql([], "SELECT count(*) AS n_rows, count(symbol_versions.version_id) AS n_found, avg(CAST(version_id IS NOT NULL AS INTEGER)) AS coverage FROM (SELECT DISTINCT upper(trim(symbol)) AS symbol FROM news_articles WHERE symbol IS NOT NULL) n LEFT JOIN (SELECT symbol, min(version_id) AS version_id FROM symbol_versions GROUP BY 1) symbol_versions USING (symbol)", ["n_rows", "n_found"], ["coverage"]))
def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "news_articles").where("symbol is not null").select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    v = table(spark, sf_dir, "symbol_versions").groupBy("symbol").agg(F.min("version_id").alias("version_id"))
    return rounded(J.lookup_coverage(n, v, ["symbol"], "version_id"))


_VALUES = "va AS (SELECT source AS name, sum(relevance) AS v, row_number() OVER (ORDER BY sum(relevance) DESC, source) AS rank_a FROM news_articles WHERE sentiment > 0 GROUP BY 1)", "vb AS (SELECT source AS name, sum(relevance) AS v, row_number() OVER (ORDER BY sum(relevance) DESC, source) AS rank_b FROM news_articles WHERE sentiment < 0 GROUP BY 1)"


@query(sql([*_VALUES], "SELECT coalesce(va.name, vb.name) AS name, rank_a, rank_b, CASE WHEN rank_a <= 5 AND (rank_b > 5 OR rank_b IS NULL) THEN 'a' WHEN rank_b <= 5 AND (rank_a > 5 OR rank_a IS NULL) THEN 'b' END AS side FROM va FULL JOIN vb ON va.name = vb.name", ["name", "rank_a", "rank_b", "side"]))
def top_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "news_articles")
    by = lambda c: n.where(c).groupBy(F.col("source").alias("name")).agg(F.sum("relevance").alias("v"))
    return J.top_k_difference(by("sentiment > 0"), by("sentiment < 0"), "name", "v", 5).select("name", "rank_a", "rank_b", "side")


@query(sql([*_PAIR], "SELECT count(*) AS n, max(abs(p_up_a - p_up_b)) AS max_abs_diff, avg(abs(p_up_a - p_up_b)) AS mean_abs_diff, count(*) FILTER (abs(p_up_a - p_up_b) > 1e-6) AS n_different, avg(CAST(predicted_a = predicted_b AS INTEGER)) AS agreement FROM pr", ["n", "n_different"], ["max_abs_diff", "mean_abs_diff", "agreement"]))
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.reconciled(V.predictions(spark, sf_dir), V.predictions(spark, sf_dir, 1), ["id"], ["p_up"], "predicted"))


@query(sql([*PRED, _POS2], "SELECT pos >= floor(n * (1 - 0.2)) AS held_out, count(*) AS n_rows, min(ts) AS first FROM predictions JOIN d USING (ts) GROUP BY 1", ["held_out", "n_rows", "first"]))
def chronological_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chronological_holdout(_pred(spark, sf_dir)).groupBy("held_out").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first"))


@query()
def fit_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fit_temperature(_pred(spark, sf_dir))


_CALL = "CASE WHEN greatest(p_down, p_flat, p_up) < 0.4 THEN -1 WHEN p_flat >= 0.45 THEN 1 WHEN abs(p_up - p_down) < 0.05 THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END"


@query(sql([*PRED, f"c AS (SELECT actual, {_CALL} AS call FROM predictions)"], "SELECT count(*) AS n, count(*) FILTER (call = -1) AS abstained, avg(CAST(call IN (0, 2) AS INTEGER)) AS coverage, avg(CAST(call = actual AS INTEGER)) AS accuracy_penalised, count(*) FILTER (call = actual) / count(*) FILTER (call >= 0) AS accuracy_called, count(*) FILTER (call = actual AND actual <> 1) / count(*) FILTER (actual <> 1) AS accuracy_movers FROM c", ["n", "abstained"], ["coverage", "accuracy_penalised", "accuracy_called", "accuracy_movers"]))
def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pred(spark, sf_dir).withColumn("call", D.gated(0.4, 0.45, 0.05)["label"])
    return rounded(D.policy_scores(rows, "call"))


_TAUS = [round(0.30 + 0.02 * k, 2) for k in range(16)]


@query(
    sql(
        [*PRED, "t AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in _TAUS) + "]) AS tau)", "c AS (SELECT tau, actual, CASE WHEN p_flat >= tau THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END AS call FROM predictions, t)"],
        "SELECT tau, avg(CAST(call = actual AS INTEGER)) AS accuracy, " + ", ".join(f"avg(CAST(call = {k} AS INTEGER)) AS share_{k}, count(*) FILTER (call = {k} AND actual = {k}) / nullif(count(*) FILTER (actual = {k}), 0) AS recall_{k}" for k in range(3)) + " FROM c GROUP BY 1",
        [], ["tau", "accuracy", *[f"{m}_{k}" for m in ("share", "recall") for k in range(3)]],
    )
)
def threshold_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.threshold_diagnostics(_pred(spark, sf_dir), _TAUS))


@query(sql([*PRED, "c AS (SELECT realized FROM predictions WHERE NOT p_flat >= 0.5 AND (p_down >= 0.4 OR p_down >= p_up))"], "SELECT count(*) AS n_flags, avg(-realized - 0.001) AS mean_avoided, sum(-realized - 0.001) AS total_avoided, avg(CAST(realized > 0 AS INTEGER)) AS whipsaw_rate FROM c", ["n_flags"], ["mean_avoided", "total_avoided", "whipsaw_rate"]))
def avoided_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.avoided_loss(_pred(spark, sf_dir), 0.5, 0.4, 0.001))


@query(_recursive(sql([*PRED, *_ACCEPT, "w2 AS (SELECT * FROM tr WHERE accepted AND net > 0)"], "SELECT id, symbol, net, n_all, net_all FROM (SELECT id, symbol, net, count(*) OVER () AS n_all, sum(net) OVER () AS net_all FROM w2 ORDER BY net DESC, id LIMIT 25 OFFSET 5)", ["id", "symbol", "n_all"], ["net", "net_all"])))
def trade_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.trade_page(_trades(spark, sf_dir), "winners", 5, 25))


@query(sql([*PRED, "r AS (SELECT id, CASE WHEN count(*) OVER w >= 5 THEN avg(CAST(actual = predicted AS INTEGER)) OVER w END AS rolling FROM predictions WINDOW w AS (ORDER BY ts, id ROWS 49 PRECEDING))"], "SELECT * FROM r", ["id"], ["rolling"]))
def rolling_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.rolling_accuracy(_pred(spark, sf_dir), 50))


@query(sql([*PRED, *DRIFT], "SELECT * FROM ps", ["feature", "n_reference", "n_current"], ["psi"]))
def recent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.recent_drift(_pred(spark, sf_dir), _P, 60))


@query(sql([*PRED, "g AS (SELECT symbol IN ('S1', 'S2', 'S3') AS g, CAST(actual = predicted AS INTEGER) AS h FROM predictions)", "a AS (SELECT count(*) FILTER (g) AS n_in, count(*) FILTER (NOT g) AS n_out, avg(h) FILTER (g) AS p, avg(h) FILTER (NOT g) AS q FROM g)"], "SELECT n_in, n_out, p AS rate_in, q AS rate_out, p - q AS delta, 2 * sqrt(p * (1 - p) / n_in + q * (1 - q) / n_out) AS two_se, n_in >= 30 AND n_out >= 30 AND p - q > 2 * sqrt(p * (1 - p) / n_in + q * (1 - q) / n_out) AS passed FROM a", ["n_in", "n_out", "passed"], ["rate_in", "rate_out", "delta", "two_se"]))
def two_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.two_proportions(_pred(spark, sf_dir), F.col("symbol").isin("S1", "S2", "S3"), F.col("actual") == F.col("predicted")))


_SPLIT = "sp AS (SELECT predictions.*, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * (0.6 + 0.2)) THEN 'validation' ELSE 'test' END AS split FROM predictions JOIN d USING (ts))"
_SCORED = "SELECT split, count(*) AS n, avg(CAST(actual = predicted AS INTEGER)) AS accuracy, " + ", ".join(f"count(*) FILTER (actual = {k} AND predicted = {k}) / nullif(count(*) FILTER (actual = {k}), 0) AS recall_{k}, avg(CAST(predicted = {k} AS INTEGER)) AS share_{k}" for k in range(3)) + " FROM sp GROUP BY 1"
_MEASURES = ["accuracy", *[f"{m}_{k}" for m in ("recall", "share") for k in range(3)]]


@query(sql([*PRED, _POS2, _SPLIT], _SCORED, ["split", "n"], _MEASURES))
def scores_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.scores_by(L.three_way_split(_pred(spark, sf_dir)), "split"))


@query(sql([*PRED, _POS2, _SPLIT, f"sc AS ({_SCORED})"], " UNION ALL ".join(f"SELECT '{m}' AS measure, (SELECT {m} FROM sc WHERE split = 'train') AS a, (SELECT {m} FROM sc WHERE split = 'test') AS b, ((SELECT {m} FROM sc WHERE split = 'train') - (SELECT {m} FROM sc WHERE split = 'test')) * 100 AS gap_pp" for m in _MEASURES), ["measure"], ["a", "b", "gap_pp"]))
def split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.split_gaps(G.scores_by(L.three_way_split(_pred(spark, sf_dir)), "split"), "split", "train", "test"))


_EXPL = "ex AS (" + " UNION ALL ".join(f"SELECT id, predicted AS class, '{p}' AS feature, {p} - 1.0 / 3 AS contribution FROM predictions" for p in _P) + ")"


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    return p.select("id", F.col("predicted").alias("class"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - 1.0 / 3).alias("contribution")) for c in _P])).alias("e")).select("id", "class", "e.*")


@query(sql([*PRED, _EXPL, "m AS (SELECT class, feature, avg(contribution) AS mean, abs(avg(contribution)) AS mean_abs FROM ex GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY mean_abs DESC, feature) AS rank FROM m)"], "SELECT * FROM r WHERE rank <= 2", ["class", "feature", "rank"], ["mean", "mean_abs"]))
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.contributions(_explained(spark, sf_dir), 2))


@query(sql([*PRED, _EXPL], "SELECT id, feature, contribution, sum(contribution) OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature ROWS UNBOUNDED PRECEDING) AS running FROM ex", ["id", "feature"], ["contribution", "running"]))
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.waterfall(_explained(spark, sf_dir)))


@query(sql([*PRED, _EXPL, "g AS (SELECT id, sum(contribution) AS total, last(feature ORDER BY abs(contribution), feature) AS strongest, last(contribution ORDER BY abs(contribution), feature) AS c FROM ex GROUP BY 1)"], "SELECT id, strongest, total, total - c AS without_strongest, sign(total) <> sign(total - c) AS flips FROM g", ["id", "strongest", "flips"], ["total", "without_strongest"]))
def flip_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.flip_distance(_explained(spark, sf_dir)))


@query(sql([*DECIDED, _GRID, "s AS (SELECT symbol, decision_date AS ts, avg(score) AS mean, max(score) AS mx, min(score) AS mn, count(score) AS n FROM dd WHERE decision_date IS NOT NULL GROUP BY 1, 2)"], "SELECT g.symbol, g.ts, mean, mx AS max, mn AS min, coalesce(n, 0) AS n, CASE WHEN mean > 0 THEN 'positive' WHEN mean < 0 THEN 'negative' WHEN mean = 0 THEN 'neutral' ELSE 'none' END AS sign FROM g LEFT JOIN s ON g.symbol = s.symbol AND g.ts = s.ts", ["symbol", "ts", "n", "sign"], ["mean", "max", "min"]))
def sentiment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.sentiment_context(_grid(spark, sf_dir), _decided(spark, sf_dir)))


@query(sql([*PRED, "b AS (SELECT predicted, CASE WHEN greatest(p_down, p_flat, p_up) < 0.5 THEN 0 WHEN greatest(p_down, p_flat, p_up) < 0.7 THEN 1 WHEN greatest(p_down, p_flat, p_up) < 1.01 THEN 2 END AS bucket FROM predictions)"], "SELECT predicted, bucket, count(*) AS n FROM b GROUP BY 1, 2", ["predicted", "bucket", "n"]))
def conviction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.conviction_bins(_pred(spark, sf_dir), [0.0, 0.5, 0.7, 1.01])


@query(sql([*PRED, "n AS (SELECT count(*) AS n FROM predictions)", "a AS (SELECT actual AS class, count(*) / any_value(n) AS actual_share FROM predictions, n GROUP BY 1)", "p AS (SELECT predicted AS class, count(*) / any_value(n) AS predicted_share FROM predictions, n GROUP BY 1)"], "SELECT class, actual_share, predicted_share, CASE WHEN predicted_share < actual_share / 2 OR predicted_share < 0.05 THEN 'starved' WHEN predicted_share > 2 * actual_share THEN 'over-produced' ELSE 'normal' END AS state FROM a JOIN p USING (class)", ["class", "state"], ["actual_share", "predicted_share"]))
def prediction_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.prediction_mode(_pred(spark, sf_dir)))


@query(sql(PRED, "SELECT count(*) AS n_down, avg(CAST(p_down < 0.5 AS INTEGER)) AS share_below FROM predictions WHERE predicted = 0", ["n_down"], ["share_below"]))
def fallback_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.fallback_share(_pred(spark, sf_dir), 0.5))


@query(
    sql(
        [V.BARS_SQL, f"b AS (SELECT symbol, ts, row_number() OVER ({W_}) AS i, close / nullif(lag(close, 5) OVER ({W_}), 0) - 1 AS t5, (volume - avg(volume) OVER p) / nullif(stddev_samp(volume) OVER p, 0) AS vz FROM bars WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"],
        "SELECT symbol, ts, CASE WHEN i > 5 THEN t5 END AS trend5, CASE WHEN i > 20 THEN vz END AS volume_z FROM b", ["symbol", "ts"], ["trend5", "volume_z"],
    )
)
def case_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir)
    return rounded(H.case_pool(b.select("symbol", "ts"), b))


@query(sql([*DECIDED, "u AS (SELECT symbol, decision_date, subject AS text FROM dd WHERE decision_date IS NOT NULL)"], "SELECT DISTINCT symbol, decision_date, text, symbol || '|' || CAST(decision_date AS VARCHAR) || '|' || substr(md5(text), 1, 8) AS case_id FROM u", ["symbol", "decision_date", "text", "case_id"]))
def united_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir).withColumn("text", F.col("subject"))
    return H.united_cases([d.where("subject = 'purchase'"), d]).select("symbol", "decision_date", "text", "case_id")


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= CAST(86400 AS BIGINT) * 1000000")
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return H.recent_samples(e, "ts", 86_400).select("event_id")


@query()
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fingerprint(table(spark, sf_dir, "feature_panel"), ["symbol", "ts", "ret_20"])


@query(sql([V.LEDGER_SQL, "r AS (SELECT seq, row_number() OVER (ORDER BY sha256(CAST(seq AS VARCHAR) || '|7'), seq) AS r FROM ledger)"], "SELECT seq FROM r WHERE r <= 100", ["seq"]))
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.random_sample(V.ledger(spark, sf_dir), "seq", 100).select("seq")


@query(sql([V.LEDGER_SQL, "k AS (SELECT label, count(*) AS n, count(*) FILTER (kept) AS kept FROM ledger GROUP BY 1)"], "SELECT label, n, kept, kept / n AS rate, sqrt(kept / n * (1 - kept / n) / n) AS se FROM k", ["label", "n", "kept"], ["rate", "se"]))
def keep_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.keep_rates(V.ledger(spark, sf_dir)))


@query(sql([*PRED, _EXPL, "m AS (SELECT feature, avg(abs(contribution)) AS mean_abs FROM ex GROUP BY 1)"], "SELECT feature, mean_abs, mean_abs / (SELECT sum(mean_abs) FROM m) AS share, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM m", ["feature", "rank"], ["mean_abs", "share"]))
def importance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.importance_shares(_explained(spark, sf_dir)))


@query(sql(PRED, "SELECT count(*) AS n, count(*) FILTER (greatest(p_down, p_flat, p_up) >= 0.5 AND predicted <> 1) AS n_signals, count(*) FILTER (greatest(p_down, p_flat, p_up) >= 0.5 AND predicted <> 1 AND actual = predicted) / nullif(count(*) FILTER (greatest(p_down, p_flat, p_up) >= 0.5 AND predicted <> 1), 0) AS signal_accuracy, greatest(count(*) FILTER (actual = 0), count(*) FILTER (actual = 1), count(*) FILTER (actual = 2)) / count(*) AS baseline, count(*) FILTER (greatest(p_down, p_flat, p_up) >= 0.5 AND predicted <> 1 AND actual = predicted) / nullif(count(*) FILTER (greatest(p_down, p_flat, p_up) >= 0.5 AND predicted <> 1), 0) - greatest(count(*) FILTER (actual = 0), count(*) FILTER (actual = 1), count(*) FILTER (actual = 2)) / count(*) AS edge FROM predictions", ["n", "n_signals"], ["signal_accuracy", "baseline", "edge"]))
def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.signal_report(_pred(spark, sf_dir), 0.5))


@query(sql([V.ARTICLES_SQL, V.SESSIONS_SQL, _GRID, "e AS (SELECT DISTINCT symbol, CAST(published_utc AS DATE) AS d FROM articles WHERE subject = 'purchase')", "l AS (SELECT g.symbol, g.ts, date_diff('day', max(e.d), g.ts) AS days FROM g LEFT JOIN e ON e.symbol = g.symbol AND e.d < g.ts GROUP BY 1, 2)"], "SELECT CASE WHEN days <= 5 THEN '0-5' WHEN days <= 10 THEN '6-10' WHEN days <= 20 THEN '11-20' WHEN days IS NOT NULL THEN '21+' ELSE 'none' END AS proximity, count(*) AS n FROM l GROUP BY 1", ["proximity", "n"]))
def event_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.articles(spark, sf_dir).where("subject = 'purchase'").select("symbol", F.to_date("published_utc").alias("ts"))
    days = J.last_before(_grid(spark, sf_dir), events, "last", strict=True).select(F.datediff("ts", "last").alias("days"))
    return days.groupBy(H.proximity(F.col("days")).alias("proximity")).agg(F.count(F.lit(1)).alias("n"))


@query()
def auc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.auc_difference(_pairs(spark, sf_dir), "p_up_a", "p_up_b", F.col("actual_a") == 2))


#: The base run, two stricter thresholds, two limits of rows a day, and liquid symbols only.
_VARIANTS = {"base": {}, "thr45": {"threshold": 0.45}, "thr50": {"threshold": 0.5}, "cap10": {"per_day": 10}, "cap5": {"per_day": 5}, "liquid": {"only": "eligible"}}
_VARIANT_SQL = [
    "tn AS (SELECT 'S' || CAST(o_custkey % 25 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS turnover FROM orders GROUP BY 1, 2)",
    f"md AS (SELECT symbol, ts, CASE WHEN count(turnover) {_n(60)} >= 20 THEN quantile_cont(turnover, 0.5) {_n(60)} END AS med FROM tn)",
    f"lq AS (SELECT symbol, ts, lag(med) OVER ({W_}) AS med FROM md)", "el AS (SELECT symbol, ts, coalesce(med >= quantile_cont(med, 0.75) OVER (PARTITION BY ts), false) AS eligible FROM lq)",
    "vs AS (SELECT * FROM (VALUES ('base', 0.4::DOUBLE, NULL::INTEGER), ('thr45', 0.45, NULL), ('thr50', 0.5, NULL), ('cap10', 0.4, 10), ('cap5', 0.4, 5), ('liquid', 0.4, NULL)) v(variant, thr, cap))",
    "e AS (SELECT p.*, variant, thr FROM predictions p LEFT JOIN el ON el.symbol = p.symbol AND el.ts = p.ts, vs WHERE variant <> 'liquid' OR eligible QUALIFY cap IS NULL OR row_number() OVER (PARTITION BY variant, event_start ORDER BY greatest(p_down, p_flat, p_up) DESC, id) <= cap)",
    "z AS (SELECT *, CASE predicted WHEN 2 THEN greatest(0, least(1, (p_up - thr) / (1 - thr))) WHEN 0 THEN -greatest(0, least(1, (p_down - thr) / (1 - thr))) ELSE 0 END AS signal FROM e)",
    "w AS (SELECT variant, symbol, event_start, event_end, id FROM z WHERE signal <> 0 AND realized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant, symbol, event_start ORDER BY id) = 1)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY variant, symbol ORDER BY event_start, id) AS i FROM w)",
    "acc AS (SELECT variant, symbol, i, id, event_end AS until, true AS accepted FROM o WHERE i = 1 UNION ALL SELECT o.variant, o.symbol, o.i, o.id, CASE WHEN o.event_start > acc.until THEN o.event_end ELSE acc.until END, o.event_start > acc.until FROM acc JOIN o ON o.variant = acc.variant AND o.symbol = acc.symbol AND o.i = acc.i + 1)",
    "k AS (SELECT z.*, coalesce(acc.accepted, false) AS accepted, CASE WHEN acc.accepted THEN signal ELSE 0 END AS live FROM z LEFT JOIN acc ON acc.id = z.id AND acc.variant = z.variant)",
    "gr AS (SELECT *, sum(abs(live)) OVER (PARTITION BY variant, event_start) AS gross FROM k)",
    "bt AS (SELECT *, live * CASE WHEN gross > 1 THEN 1 / gross ELSE 1 END AS weight FROM gr)",
    "dn AS (SELECT variant, event_end AS day, sum(weight * realized - abs(weight) * 0.001) AS net, count(*) FILTER (accepted) AS n_accepted FROM bt GROUP BY 1, 2)",
    "eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY variant ORDER BY day)) AS equity FROM dn)", "dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY variant ORDER BY day) - 1 AS drawdown FROM eq)",
]


@query(_recursive(sql([*PRED, *_VARIANT_SQL], "SELECT variant, count(*) AS n_days, last(equity ORDER BY day) - 1 AS total_return, min(drawdown) AS max_drawdown, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe, CAST(sum(n_accepted) AS BIGINT) AS n_accepted FROM dd GROUP BY 1", ["variant", "n_days", "n_accepted"], ["total_return", "max_drawdown", "sharpe"])))
def backtest_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    turnover = o.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 25).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("turnover"))
    rows = _pred(spark, sf_dir).join(D.liquid(turnover), ["symbol", "ts"], "left")
    return rounded(D.variants(rows, _VARIANTS))
