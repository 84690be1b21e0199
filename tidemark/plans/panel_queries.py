"""Queries of the panel operators: features, joins in time, ingest, labels and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.operators import features as X
from tidemark.operators import ingest as I
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import windows as W
from tidemark.plans.oracle import rounded, sql
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


BARS = [V.BARS_SQL]
W_ = "PARTITION BY symbol ORDER BY ts"


def _n(n: int) -> str:
    return f"OVER ({W_} ROWS {n - 1} PRECEDING)"


def _full(x: str, n: int, value: str, at_least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {_n(n)} >= {at_least or n} THEN {value} END"


def _mean(x: str, n: int, k: int | None = None) -> str:
    return _full(x, n, f"avg({x}) {_n(n)}", k)


def _std(x: str, n: int, k: int | None = None) -> str:
    return _full(x, n, f"stddev_samp({x}) {_n(n)}", k)


def _z(x: str, n: int, k: int | None = None) -> str:
    return f"({x} - {_mean(x, n, k)}) / nullif({_std(x, n, k)}, 0)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W_})"


def _chg(x: str, k: int = 1) -> str:
    return f"({x} / nullif({_lag(x, k)}, 0) - 1)"


_PRICE = ["ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "ret_60", "sma_ratio_5", "sma_ratio_10", "sma_ratio_20", "sma_ratio_50", "sma_ratio_100", "sma_ratio_200", "volatility_5", "volatility_10", "volatility_20", "volatility_60", "range_ratio", "body_ratio", "gap_ratio", "bollinger_position", "bollinger_width"]
_RET = f"r AS (SELECT *, {_chg('close')} AS ret_1 FROM bars)"


@query(
    sql(
        [*BARS, _RET],
        "SELECT symbol, ts, ret_1, "
        + ", ".join(f"{_chg('close', w)} AS ret_{w}" for w in (3, 5, 10, 20, 60))
        + ", " + ", ".join(f"close / ({_mean('close', w)}) - 1 AS sma_ratio_{w}" for w in (5, 10, 20, 50, 100, 200))
        + ", " + ", ".join(f"({_std('ret_1', w)}) * sqrt(252) AS volatility_{w}" for w in (5, 10, 20, 60))
        + f""", (high - low) / nullif(close, 0) AS range_ratio, (close - open) / nullif(open, 0) AS body_ratio, open / nullif({_lag('close')}, 0) - 1 AS gap_ratio,
        (close - ({_mean('close', 20)})) / nullif(2 * ({_std('close', 20)}), 0) AS bollinger_position, 4 * ({_std('close', 20)}) / nullif({_mean('close', 20)}, 0) AS bollinger_width FROM r""",
        ["symbol", "ts"], _PRICE,
    )
)
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.price_features(V.bars(spark, sf_dir)).select("symbol", "ts", *_PRICE))


_VOL = [*[f"rel_volume_{w}" for w in (5, 20, 60)], *[f"volume_z_{w}" for w in (5, 20, 60)], "obv", "turnover", "obv_z20", "turnover_z20", "locked"]


@query(
    sql(
        [*BARS, f"s AS (SELECT *, coalesce(sign(close - {_lag('close')}), 0) * volume AS step FROM bars)", f"o AS (SELECT *, sum(step) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS obv, close * volume / 1e7 AS turnover FROM s)"],
        "SELECT symbol, ts, obv, turnover, "
        + ", ".join(f"volume / nullif({_mean('volume', w)}, 0) AS rel_volume_{w}" for w in (5, 20, 60)) + ", "
        + ", ".join(f"{_z('volume', w)} AS volume_z_{w}" for w in (5, 20, 60))
        + f", {_z('obv', 20)} AS obv_z20, {_z('turnover', 20)} AS turnover_z20, CASE WHEN close = high AND close = low THEN 1.0 ELSE 0.0 END AS locked FROM o",
        ["symbol", "ts"], _VOL,
    )
)
def volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.volume_features(V.bars(spark, sf_dir)).select("symbol", "ts", *_VOL))


_REC = ["ema_10", "ema_20", "ema_50", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "atr_pct", "ema_ratio_10", "ema_ratio_20", "ema_ratio_50"]


def _ewm_sql() -> list[str]:
    """Recursive means step by step over numbered rows of all symbols at once."""
    first = "CASE WHEN {c} IS NULL THEN NULL ELSE {c} END"
    cols = {"ema_10": ("close", 2 / 11), "ema_12": ("close", 2 / 13), "ema_20": ("close", 2 / 21), "ema_26": ("close", 2 / 27), "ema_50": ("close", 2 / 51), "ag": ("gain", 1 / 14), "al": ("loss", 1 / 14), "atr_14": ("tr", 1 / 14)}
    seed = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, (c, _) in cols.items())
    step = ", ".join(f"CASE WHEN e.{n} IS NULL THEN s.{c} WHEN s.{c} IS NULL THEN e.{n} ELSE {a!r} * s.{c} + {1 - a!r} * e.{n} END" for n, (c, a) in cols.items())
    return [
        f"d AS (SELECT *, close - {_lag('close')} AS d, {_lag('close')} AS pc, row_number() OVER ({W_}) AS i FROM bars)",
        "s AS (SELECT symbol, ts, i, close, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM d)",
        f"e AS (SELECT symbol, ts, i, close, {seed} FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.ts, s.i, s.close, {step} FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)",
        f"m AS (SELECT symbol, i, ema_12 - ema_26 AS macd, ema_12 - ema_26 AS sig FROM e WHERE i = 1 UNION ALL SELECT e.symbol, e.i, e.ema_12 - e.ema_26, {0.2!r} * (e.ema_12 - e.ema_26) + {0.8!r} * m.sig FROM m JOIN e ON e.symbol = m.symbol AND e.i = m.i + 1)",
    ]


@query(
    sql(
        [*BARS, *_ewm_sql()],
        "SELECT e.symbol, ts, ema_10, ema_20, ema_50, macd, sig AS macd_signal, macd - sig AS macd_hist, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi_14, atr_14, atr_14 / nullif(close, 0) AS atr_pct, "
        + ", ".join(f"close / ema_{s} - 1 AS ema_ratio_{s}" for s in (10, 20, 50)) + " FROM e JOIN m ON e.symbol = m.symbol AND e.i = m.i",
        ["symbol", "ts"], _REC,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def recursive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.recursive_features(V.bars(spark, sf_dir)).select("symbol", "ts", *_REC))


_FRAC = W.fractional_weights(0.4)


@query(
    sql(
        [V.BARS_SQL, "lc AS (SELECT symbol, ts, ln(nullif(close, 0)) AS x FROM bars)", f"fr AS (SELECT symbol, ts, CASE WHEN count(x) {_n(len(_FRAC))} = {len(_FRAC)} THEN " + " + ".join(f"{w!r} * {_lag('x', k) if k else 'x'}" for k, w in enumerate(_FRAC)) + " END AS v FROM lc)"],
        f"SELECT symbol, ts, {_lag('v')} AS frac FROM fr", ["symbol", "ts"], ["frac"],
    )
)
def fractional_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir)
    logs = b.select("symbol", "ts", F.ln(F.nullif("close", F.lit(0.0))).alias("x"))
    diff = logs.select("symbol", "ts", W.fractional_difference(F.col("x"), _FRAC).alias("v"))
    return rounded(diff.select("symbol", "ts", F.lag("v").over(W.series()).alias("frac")))


_MAC = [*[f"{c}{s}_lag1" for c in V.MACRO for s in ("", "_ret5", "_ret20", "_z60", "_vol20")], "asset_minus_index_ret20_lag1"]


@query(
    sql(
        [*BARS, V.MACRO_SQL, f"f AS (SELECT symbol, ts, close, {', '.join(f'last({c} IGNORE NULLS) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS {c}' for c in V.MACRO)} FROM bars LEFT JOIN macro USING (ts))",
         "f2 AS (SELECT *, " + ", ".join(f"{_chg(c)} AS {c}_step" for c in V.MACRO) + " FROM f)",
         "g AS (SELECT symbol, ts, " + ", ".join(f"{c}, {_chg(c, 5)} AS {c}_ret5, {_chg(c, 20)} AS {c}_ret20, {_z(c, 60, 20)} AS {c}_z60, {_std(c + '_step', 20)} AS {c}_vol20" for c in V.MACRO) + f", {_chg('close', 20)} - {_chg('m_high', 20)} AS asset_minus_index_ret20 FROM f2)"],
        "SELECT symbol, ts, " + ", ".join(f"{_lag(m[:-5])} AS {m}" for m in _MAC) + " FROM g",
        ["symbol", "ts"], _MAC,
    )
)
def macro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = V.bars(spark, sf_dir).select("symbol", "ts", "close")
    return rounded(X.macro_features(panel, V.macro(spark, sf_dir), V.MACRO, "m_high").select("symbol", "ts", *_MAC))


_REG = ["close_high_regime", "close_bull_regime", "close_change_5"]


@query(
    sql(
        [*BARS, f"g AS (SELECT symbol, ts, CASE WHEN close > ({_full('close', 252, f'quantile_cont(close, 0.75) {_n(252)}', 60)}) THEN 1.0 ELSE 0.0 END AS h, CASE WHEN close > ({_mean('close', 200, 60)}) THEN 1.0 ELSE 0.0 END AS b, {_chg('close', 5)} AS c FROM bars)"],
        f"SELECT symbol, ts, {_lag('h')} AS close_high_regime, coalesce({_lag('b')}, 0) AS close_bull_regime, {_lag('c')} AS close_change_5 FROM g",
        ["symbol", "ts"], _REG,
    )
)
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.regime_features(V.bars(spark, sf_dir), "close").select("symbol", "ts", *_REG))


@query(
    sql(
        [V.ARTICLES_SQL, "p AS (SELECT DISTINCT symbol, CAST(published_utc AS DATE) AS ts FROM articles)", "e AS (SELECT *, max(CASE WHEN isodow(ts) = 4 THEN ts END) OVER (PARTITION BY symbol, date_trunc('month', ts)) AS x FROM p)",
         f"n AS (SELECT *, min(CASE WHEN x >= ts THEN x END) OVER ({W_} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM e)"],
        "SELECT symbol, ts, CASE WHEN date_diff('day', ts, nx) BETWEEN 0 AND 4 THEN 1.0 ELSE 0.0 END AS expiry_week FROM n", ["symbol", "ts"], ["expiry_week"],
    )
)
def expiry_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = V.articles(spark, sf_dir).select("symbol", F.to_date("published_utc").alias("ts")).distinct()
    return X.expiry_week(days).select("symbol", "ts", "expiry_week")


_CAL_INT = ["calendar_month", "calendar_quarter", "calendar_weekofyear", "calendar_dayofweek", "fiscal_quarter", "fiscal_year", "days_to_month_end", "is_quarter_end", "is_month_end", "is_month_start", "earnings_season_proxy"]


@query(
    sql(
        ["d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders)"],
        """SELECT ts, CAST(month(ts) AS INTEGER) AS calendar_month, CAST(quarter(ts) AS INTEGER) AS calendar_quarter, CAST(week(ts) AS INTEGER) AS calendar_weekofyear, CAST(isodow(ts) - 1 AS INTEGER) AS calendar_dayofweek,
        sin(2 * pi() * month(ts) / 12) AS calendar_month_sin, cos(2 * pi() * month(ts) / 12) AS calendar_month_cos, sin(2 * pi() * quarter(ts) / 4) AS calendar_quarter_sin, cos(2 * pi() * quarter(ts) / 4) AS calendar_quarter_cos,
        CAST((month(ts) + 8) % 12 // 3 + 1 AS INTEGER) AS fiscal_quarter, CAST(year(ts) + CASE WHEN month(ts) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(date_diff('day', ts, last_day(ts)) AS INTEGER) AS days_to_month_end,
        CAST(ts = last_day(ts) AND month(ts) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end, CAST(ts = last_day(ts) AS INTEGER) AS is_month_end, CAST(day(ts) = 1 AS INTEGER) AS is_month_start, CAST(month(ts) IN (1, 4, 7, 10) AS INTEGER) AS earnings_season_proxy FROM d""",
        ["ts", *_CAL_INT], ["calendar_month_sin", "calendar_month_cos", "calendar_quarter_sin", "calendar_quarter_cos"],
    )
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.calendar_features(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ts")).distinct()))


_RANKED = ["close", "volume", "ret_1"]


def _rank_sql(c: str, part: str = "ts") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {c} ASC NULLS LAST) + (count({c}) OVER (PARTITION BY {part}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {part}) END"


@query(sql([*BARS, _RET], f"SELECT symbol, ts, {', '.join(f'{_rank_sql(c)} AS {c}_xs_rank' for c in _RANKED)} FROM r", ["symbol", "ts"], [f"{c}_xs_rank" for c in _RANKED]))
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir).withColumn("ret_1", W.change(F.col("close")))
    return rounded(X.rank_features(b, _RANKED).select("symbol", "ts", *[f"{c}_xs_rank" for c in _RANKED]))


_BUCKET = ["close_vs_bucket", "close_bucket_rank", "close_bucket_std"]
_MEMBER = 'b AS (SELECT bars.symbol, ts, close, bucket FROM bars LEFT JOIN membership m ON bars.symbol = m.symbol AND ts >= m."from" AND (m."to" IS NULL OR ts <= m."to"))'


@query(
    sql(
        [*BARS, V.MEMBERSHIP_SQL, _MEMBER],
        f"SELECT symbol, ts, bucket, CASE WHEN bucket IS NOT NULL THEN close - avg(close) OVER (PARTITION BY ts, bucket) END AS close_vs_bucket, CASE WHEN bucket IS NOT NULL THEN {_rank_sql('close', 'ts, bucket')} END AS close_bucket_rank, CASE WHEN bucket IS NOT NULL THEN stddev_samp(close) OVER (PARTITION BY ts, bucket) END AS close_bucket_std FROM b",
        ["symbol", "ts", "bucket"], _BUCKET,
    )
)
def bucket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = J.interval_join(V.bars(spark, sf_dir).select("symbol", "ts", "close"), V.membership(spark, sf_dir))
    return rounded(X.bucket_features(b, "bucket", ["close"]).select("symbol", "ts", "bucket", *_BUCKET))


_DECISION = """loc AS (SELECT *, published_utc + INTERVAL 330 MINUTE AS l FROM articles),
dec AS (SELECT *, CAST(l AS DATE) + CASE WHEN CAST(l AS TIME) > TIME '15:30:00' THEN 1 ELSE 0 END AS d FROM loc),
dd AS (SELECT article_id, symbol, subject, score, published_utc, (SELECT min(session) FROM sessions WHERE session >= d) AS decision_date FROM dec)"""
DECIDED = [V.ARTICLES_SQL, V.SESSIONS_SQL, _DECISION]


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_decision_date(V.articles(spark, sf_dir), V.sessions(spark, sf_dir))


@query(sql(DECIDED, "SELECT article_id, decision_date FROM dd WHERE decision_date IS NOT NULL", ["article_id", "decision_date"]))
def decision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("article_id", "decision_date")


_GRID = "g AS (SELECT s.symbol, session AS ts FROM sessions CROSS JOIN (SELECT DISTINCT symbol FROM articles) s)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each symbol: a feature panel's rows are wanted for each."""
    symbols = whole(V.articles(spark, sf_dir), names=F.collect_set("symbol"))
    return V.sessions(spark, sf_dir).select(F.explode(symbols["names"]).alias("symbol"), F.col("session").alias("ts"))


_EVENT_SQL = {f: " OR ".join(f"contains(lower(coalesce(subject, '')), '{w}')" for w in ws) for f, ws in X.EVENT_KEYWORDS.items()}
_ANN = ["ann_count", *[f"event_{f}" for f in X.EVENT_KEYWORDS], "ann_count_5d", "ann_count_20d", "days_since_last_ann", "ann_available"]


@query(
    sql(
        [*DECIDED, _GRID, "a AS (SELECT symbol, decision_date AS ts, CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"max(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS event_{f}" for f, c in _EVENT_SQL.items()) + " FROM dd WHERE decision_date IS NOT NULL GROUP BY 1, 2)",
         "j AS (SELECT g.symbol, g.ts, coalesce(n, 0) AS ann_count, " + ", ".join(f"coalesce(event_{f}, 0) AS event_{f}" for f in _EVENT_SQL) + " FROM g LEFT JOIN a ON g.symbol = a.symbol AND g.ts = a.ts)"],
        f"SELECT *, sum(ann_count) {_n(5)} AS ann_count_5d, sum(ann_count) {_n(20)} AS ann_count_20d, date_diff('day', max(CASE WHEN ann_count > 0 THEN ts END) OVER ({W_} ROWS UNBOUNDED PRECEDING), ts) AS days_since_last_ann, CASE WHEN sum(ann_count) {_n(252)} > 0 THEN 1.0 ELSE 0.0 END AS ann_available FROM j",
        ["symbol", "ts"], _ANN,
    )
)
def announcement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.announcement_features(_grid(spark, sf_dir), _decided(spark, sf_dir)).select("symbol", "ts", *_ANN))


_TXT = ["news_count", "news_mean", "news_z20", "news_shock", "news_count_5d", "news_count_20d", "news_available", "news_coverage_60"]


@query(
    sql(
        [*DECIDED, _GRID, "a AS (SELECT symbol, decision_date AS ts, count(score) AS n, avg(score) AS news_mean FROM dd WHERE decision_date IS NOT NULL GROUP BY 1, 2)",
         "j AS (SELECT g.symbol, g.ts, coalesce(CAST(n AS DOUBLE), 0) AS news_count, news_mean FROM g LEFT JOIN a ON g.symbol = a.symbol AND g.ts = a.ts)"],
        f"SELECT *, {_z('news_mean', 20, 5)} AS news_z20, news_mean - ({_mean('news_mean', 20, 5)}) AS news_shock, sum(news_count) {_n(5)} AS news_count_5d, sum(news_count) {_n(20)} AS news_count_20d, CASE WHEN news_count > 0 THEN 1.0 ELSE 0.0 END AS news_available, CASE WHEN sum(news_count) {_n(60)} > 0 THEN 1.0 ELSE 0.0 END AS news_coverage_60 FROM j",
        ["symbol", "ts"], _TXT,
    )
)
def scored_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.scored_text_features(_grid(spark, sf_dir), _decided(spark, sf_dir), "news").select("symbol", "ts", *_TXT))


_MKT = ["market_count", "market_mean", "market_z20"]


@query(
    sql(
        [*DECIDED, "a AS (SELECT '*' AS symbol, session AS ts, coalesce(CAST(n AS DOUBLE), 0) AS market_count, market_mean FROM sessions LEFT JOIN (SELECT decision_date, count(score) AS n, avg(score) AS market_mean FROM dd GROUP BY 1) ON decision_date = session)"],
        f"SELECT ts, market_count, market_mean, {_z('market_mean', 20, 5)} AS market_z20 FROM a", ["ts"], _MKT,
    )
)
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.market_features(_decided(spark, sf_dir), V.sessions(spark, sf_dir)).select("ts", *_MKT))


_NDAY = ["news_count", "news_sources", "news_mean", "news_std", "news_positive", "news_negative", "news_relevance", "news_headline_length"]
_NLAG = [f"news_{k}_{w}d" for k in ("count", "mean", "positive_ratio") for w in (1, 3, 5, 10, 20)]


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "news_articles").where("symbol is not null and received_at is not null")
    return n.select(F.upper(F.trim("symbol")).alias("symbol"), F.to_date("received_at").alias("ts"), "article_id", "source", "title", "sentiment", "relevance")


@query(
    sql(
        ["n AS (SELECT upper(trim(symbol)) AS symbol, CAST(received_at AS DATE) AS ts, article_id, source, title, sentiment, relevance FROM news_articles WHERE symbol IS NOT NULL AND received_at IS NOT NULL)", "g AS (SELECT DISTINCT symbol, ts FROM n)",
         """j AS (SELECT symbol, ts, CAST(count(DISTINCT article_id) AS DOUBLE) AS news_count, CAST(count(DISTINCT source) AS DOUBLE) AS news_sources, coalesce(avg(sentiment), 0) AS news_mean, coalesce(stddev_samp(sentiment), 0) AS news_std,
         CAST(count(*) FILTER (sentiment > 0) AS DOUBLE) AS news_positive, CAST(count(*) FILTER (sentiment < 0) AS DOUBLE) AS news_negative, coalesce(avg(relevance), 0) AS news_relevance, coalesce(avg(length(title)), 0) AS news_headline_length FROM n GROUP BY 1, 2)""",
         "t AS (SELECT *, " + ", ".join(f"sum(news_count) {_n(w)} AS n{w}, avg(news_mean) {_n(w)} AS m{w}, sum(news_positive) {_n(w)} AS p{w}" for w in (1, 3, 5, 10, 20)) + " FROM j)"],
        f"SELECT symbol, ts, {', '.join(_NDAY)}, " + ", ".join(f"coalesce({_lag(f'n{w}')}, 0) AS news_count_{w}d, coalesce({_lag(f'm{w}')}, 0) AS news_mean_{w}d, coalesce(lag(coalesce(p{w} / nullif(n{w}, 0), 0)) OVER ({W_}), 0) AS news_positive_ratio_{w}d" for w in (1, 3, 5, 10, 20)) + " FROM t",
        ["symbol", "ts"], [*_NDAY, *_NLAG],
    )
)
def news_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _news(spark, sf_dir)
    return rounded(X.news_day_features(n.select("symbol", "ts").distinct(), n).select("symbol", "ts", *_NDAY, *_NLAG))


@query(
    sql(
        [*BARS, "m AS (SELECT symbol, ts, volume AS v FROM bars)", f"l AS (SELECT b.symbol, b.ts, lag(v) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS v_lag1 FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.ts = m.ts)"],
        f"SELECT symbol, ts, v_lag1, {_z('v_lag1', 20)} AS v_z20, CASE WHEN v_lag1 IS NOT NULL THEN 1.0 ELSE 0.0 END AS v_available FROM l", ["symbol", "ts"], ["v_lag1", "v_z20", "v_available"],
    )
)
def lagged_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir)
    return rounded(X.lagged_publication(b.select("symbol", "ts"), b.select("symbol", "ts", F.col("volume").alias("v")), ["v"]))


@query(sql(["c AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)"], "SELECT status, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c", ["status", "n"], ["weight"]))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.class_weights(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status"))


@query(sql(["p AS (SELECT symbol, ts, ret_20, volatility_20, news_count FROM feature_panel)"], "SELECT * FROM p WHERE ret_20 IS NOT NULL AND volatility_20 IS NOT NULL", ["symbol", "ts"], ["ret_20", "volatility_20", "news_count"]))
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "feature_panel").select("symbol", "ts", "ret_20", "volatility_20", "news_count")
    return rounded(X.complete_rows(p, ["ret_20", "volatility_20", "news_count"], ["news_count"]))


# Joins in time.


@query(sql([*BARS, V.MEMBERSHIP_SQL, _MEMBER], "SELECT symbol, ts, bucket FROM b", ["symbol", "ts", "bucket"]))
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.interval_join(V.bars(spark, sf_dir).select("symbol", "ts"), V.membership(spark, sf_dir)).select("symbol", "ts", "bucket")


_PURCHASE = "e AS (SELECT DISTINCT symbol, CAST(published_utc AS DATE) AS d FROM articles WHERE subject = 'purchase')"


@query(sql([V.ARTICLES_SQL, V.SESSIONS_SQL, _GRID, _PURCHASE], "SELECT g.symbol, g.ts, max(e.d) AS last_day, max(CASE WHEN e.d < g.ts THEN e.d END) AS strictly FROM g LEFT JOIN e ON e.symbol = g.symbol AND e.d <= g.ts GROUP BY 1, 2", ["symbol", "ts", "last_day", "strictly"]))
def last_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.articles(spark, sf_dir).where("subject = 'purchase'").select("symbol", F.to_date("published_utc").alias("ts"))
    return J.last_before(J.last_before(_grid(spark, sf_dir), events, "last_day"), events, "strictly", strict=True).select("symbol", "ts", "last_day", "strictly")


@query(
    sql(
        [V.ARTICLES_SQL, V.SESSIONS_SQL, "x AS (SELECT min(session) AS a, max(session) AS z FROM sessions)", "y AS (SELECT article_id, least(greatest(CAST(published_utc + INTERVAL 330 MINUTE AS DATE), a), z) AS d FROM articles, x)"],
        "SELECT article_id, (SELECT min(session) FROM sessions WHERE session >= d) AS decision_date FROM y", ["article_id", "decision_date"],
    )
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_event_session(V.articles(spark, sf_dir), V.sessions(spark, sf_dir)).select("article_id", "decision_date")


_ALIASES = "al AS (SELECT DISTINCT lower(word) AS key, upper(word) AS a FROM (SELECT unnest(string_split(p_type, ' ') || string_split(p_name, ' ')) AS word FROM part) WHERE trim(word) <> '' UNION SELECT DISTINCT 'maker', upper(p_brand) FROM part)"


@query(sql([_ALIASES], "SELECT DISTINCT p_partkey, key FROM part JOIN al ON contains(upper(concat_ws(' ', p_brand, p_type, p_name)), a)", ["p_partkey", "key"]))
def substring_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.concat(F.split("p_type", " "), F.split("p_name", " "))).alias("word")).select(F.lower("word").alias("key"), F.col("word").alias("alias"))
    aliases = words.unionByName(part.select(F.lit("maker").alias("key"), F.col("p_brand").alias("alias")))
    return J.substring_matches(part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("hay")), aliases, "hay", "alias").select("p_partkey", "key")


@query(
    sql(
        [*BARS, V.MEMBERSHIP_SQL, _MEMBER, "ev AS (SELECT 'V' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, count(*) AS own FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)",
         'tg AS (SELECT ts, bucket, sum(own) AS s FROM ev JOIN membership m ON ev.symbol = m.symbol AND ts >= m."from" AND (m."to" IS NULL OR ts <= m."to") GROUP BY 1, 2)', "mk AS (SELECT ts, sum(own) AS market FROM ev GROUP BY 1)"],
        "SELECT b.symbol, b.ts, b.bucket, coalesce(own, 0) AS own, CAST(greatest(coalesce(s, 0) - coalesce(own, 0), 0) AS BIGINT) AS bucket_other, CAST(coalesce(market, 0) AS BIGINT) AS market FROM b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.ts = b.ts LEFT JOIN tg ON tg.ts = b.ts AND tg.bucket = b.bucket LEFT JOIN mk ON mk.ts = b.ts",
        ["symbol", "ts", "bucket", "own", "bucket_other", "market"],
    )
)
def bucket_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir).select("symbol", "ts")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    events = lines.select(F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts"))
    members = V.membership(spark, sf_dir)
    return J.bucket_activity(J.interval_join(b, members), events, members).select("symbol", "ts", "bucket", "own", "bucket_other", "market")


# Ingest.


@query("SELECT symbol, ts, max_by(ret_20, row(updated_at, coalesce(ret_20, -1e308))) AS ret_20 FROM feature_panel GROUP BY 1, 2")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.keep_last(table(spark, sf_dir, "feature_panel").select("symbol", "ts", "updated_at", "ret_20"), ["symbol", "ts"], ["updated_at"]).select("symbol", "ts", "ret_20")


@query("SELECT article_id, min(ingest_id) AS ingest_id FROM news_articles WHERE article_id IS NOT NULL GROUP BY 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.keep_first(table(spark, sf_dir, "news_articles").where("article_id is not null").select("article_id", "ingest_id"), ["article_id"], ["ingest_id"])


@query(sql([*BARS, "o AS (SELECT * FROM bars WHERE ts < DATE '1996-01-01')", "f AS (SELECT symbol, ts, close * 2 AS close FROM bars WHERE ts >= DATE '1995-06-01')"], "SELECT symbol, ts, close FROM f UNION ALL SELECT symbol, ts, close FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol = o.symbol AND f.ts = o.ts)", ["symbol", "ts"], ["close"]))
def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bars(spark, sf_dir).select("symbol", "ts", "close")
    return rounded(I.merge_history(b.where("ts < date'1996-01-01'"), b.where("ts >= date'1995-06-01'").withColumn("close", F.col("close") * 2), ["symbol", "ts"]))


@query(sql([*BARS], "SELECT symbol, max(ts) AS last_ts, max(ts) + 1 AS fetch_from FROM bars GROUP BY 1", ["symbol", "last_ts", "fetch_from"]))
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.high_water(V.bars(spark, sf_dir))


_HOLES = "c AS (SELECT DISTINCT ts AS session FROM feature_panel)", "x AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM feature_panel GROUP BY 1)", "h AS (SELECT symbol, session FROM x JOIN c ON session BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM feature_panel p WHERE p.symbol = x.symbol AND p.ts = session))"


@query(sql([*_HOLES], "SELECT symbol, session FROM h", ["symbol", "session"]))
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "feature_panel").select("symbol", "ts")
    return I.missing_sessions(p, p.select(F.col("ts").alias("session")))


@query(sql([*_HOLES, "k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS r FROM h)"], "SELECT symbol, count(*) AS n_holes, min(session) AS first_hole, max(session) AS last_hole, string_agg(CAST(session AS VARCHAR), ',' ORDER BY session) FILTER (r <= 20) AS holes FROM k GROUP BY 1", ["symbol", "n_holes", "first_hole", "last_hole", "holes"]))
def hole_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hole_summary(missing_sessions(spark, sf_dir))


@query("SELECT DISTINCT case_id FROM star_candidates s WHERE NOT EXISTS (SELECT 1 FROM harness_results h WHERE h.case_id = s.case_id) AND case_id IS NOT NULL")
def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unprocessed(table(spark, sf_dir, "star_candidates").where("case_id is not null").select("case_id").distinct(), table(spark, sf_dir, "harness_results"), "case_id")


@query("WITH e AS (SELECT source, symbol, count(*) AS n, min(received_at) AS a, max(received_at) AS z FROM news_articles GROUP BY 1, 2) SELECT source, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows, CAST(min(a) AS DATE) AS first, CAST(max(z) AS DATE) AS last, CAST(min(z) AS DATE) AS stalest FROM e GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "news_articles").select("source", "symbol", F.to_date("received_at").alias("day"))
    return I.coverage(n, "source", "symbol", "day")


# Labels and splits.

_TB = ["entry_price", "exit_price", "realized_return"]


def _barrier_sql(h: int = 5, m: float = 1.0, band: float = 1.0, name: str = "tb") -> list[str]:
    ahead = ", ".join(f"lead({c}, {k}) OVER ({W_}) AS {c}{k}" for k in range(1, h + 1) for c in ("ts", "high", "low", "close"))
    hit = lambda up_dn, up, dn, last: " ".join(f"WHEN high{k} >= u AND low{k} <= d THEN {up_dn.format(k=k)} WHEN high{k} >= u THEN {up.format(k=k)} WHEN low{k} <= d THEN {dn.format(k=k)}" for k in range(1, h + 1)) + f" ELSE {last}"
    ret = f"(close{h} / entry - 1)"
    return [
        f"{name}1 AS (SELECT *, {_std('ret_1', 20)} AS sigma, lead(open, 1) OVER ({W_}) AS entry, {ahead} FROM r)",
        f"{name}2 AS (SELECT *, entry * (1 + {m} * sigma) AS u, entry * (1 - {m} * sigma) AS d FROM {name}1 WHERE sigma > 0 AND entry > 0 AND ts{h} IS NOT NULL)",
        f"{name}3 AS (SELECT symbol, ts, entry AS entry_price, CASE {hit('0', '1', '-1', f'CASE WHEN abs{ret} <= sigma * {band} THEN 0 WHEN {ret} > 0 THEN 1 ELSE -1 END')} END AS label_raw, ts1 AS event_start, CASE {hit('ts{k}', 'ts{k}', 'ts{k}', f'ts{h}')} END AS event_end, CASE {hit('close{k}', 'u', 'd', f'close{h}')} END AS exit_price FROM {name}2)",
        f"{name} AS (SELECT *, exit_price / entry_price - 1 AS realized_return FROM {name}3)",
    ]


@query(sql([*BARS, _RET, *_barrier_sql()], "SELECT *, label_raw + 1 AS label FROM tb", ["symbol", "ts", "label_raw", "label", "event_start", "event_end"], _TB))
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.triple_barrier(V.bars(spark, sf_dir)))


_HORIZONS, _MULTIPLIERS = [1, 5, 10, 20], [0.5, 1.0, 1.5]
_CELLS = [(h, m) for h in _HORIZONS for m in _MULTIPLIERS]
_CLASSES = {-1: "down", 0: "flat", 1: "up"}
_CELL_FIGURES = [f"{x}_{c}" for x in ("share", "median", "std") for c in _CLASSES.values()]


@query(
    sql(
        [*BARS, _RET, *[x for h, m in _CELLS for x in _barrier_sql(h, m, 1.0, f"c{h}_{int(m * 10)}_")]],
        " UNION ALL ".join(f"SELECT {h} AS horizon, {m}::DOUBLE AS multiplier, count(*) AS n, " + ", ".join(f"avg(CAST(label_raw = {v} AS INTEGER)) AS share_{c}, quantile_cont(realized_return, 0.5) FILTER (label_raw = {v}) AS median_{c}, stddev_pop(realized_return) FILTER (label_raw = {v}) AS std_{c}" for v, c in _CLASSES.items()) + f" FROM c{h}_{int(m * 10)}_" for h, m in _CELLS),
        ["horizon", "n"], ["multiplier", *_CELL_FIGURES],
    )
)
def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.label_grid(V.bars(spark, sf_dir), _HORIZONS, _MULTIPLIERS))


_BANDS = [0.25, 0.5, 1.0, 2.0]


@query(
    sql(
        [*BARS, _RET, *[x for b in _BANDS for x in _barrier_sql(5, 1.0, b, f"b{int(b * 100)}_")], "s AS (" + " UNION ALL ".join(f"SELECT {b}::DOUBLE AS band, count(*) AS n, avg(CAST(label_raw = 0 AS INTEGER)) AS share_flat FROM b{int(b * 100)}_" for b in _BANDS) + ")"],
        "SELECT *, row_number() OVER (ORDER BY CASE WHEN share_flat BETWEEN 0.25 AND 0.40 THEN 0 ELSE 1 END, CASE WHEN share_flat BETWEEN 0.25 AND 0.40 THEN band ELSE abs(share_flat - 0.325) END, band) = 1 AS picked FROM s", ["n", "picked"], ["band", "share_flat"],
    )
)
def flat_band_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.flat_band_scan(V.bars(spark, sf_dir), _BANDS))


_POS = "d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM predictions))"


@query(sql([V.predictions_sql(), _POS], "SELECT CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * (0.6 + 0.2)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM predictions JOIN d USING (ts) GROUP BY 1", ["split", "n_rows", "first", "last"]))
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.three_way_split(V.predictions(spark, sf_dir))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    sql(
        [V.predictions_sql(), _POS, "f AS (SELECT i AS fold, (SELECT ts FROM d WHERE pos = (i + 1) * n // 5) AS a, (SELECT ts FROM d WHERE pos = (i + 2) * n // 5) AS b FROM (SELECT unnest(range(4)) AS i), (SELECT DISTINCT n FROM d))",
         "x AS (SELECT fold, CASE WHEN ts < a - 5 AND (event_end IS NULL OR event_end < a) THEN 'train' WHEN ts >= a AND (b IS NULL OR ts < b) THEN 'validation' END AS role, ts FROM predictions, f)"],
        "SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM x WHERE role IS NOT NULL GROUP BY 1, 2", ["fold", "role", "n_rows", "first", "last"],
    )
)
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = L.purged_folds(V.predictions(spark, sf_dir))
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(sql([*BARS, _RET, *_barrier_sql()], "SELECT count(*) AS n_rows, count(*) FILTER (event_start <= ts) AS n_premature FROM tb", ["n_rows", "n_premature"]))
def premature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.premature_labels(L.triple_barrier(V.bars(spark, sf_dir)))
