"""Queries of the ledger operators and text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import decisions as D
from tidemark.operators import ledger as J
from tidemark.plans.model_queries import _MC
from tidemark.plans.oracle import rounded, sql
from tidemark.sources import views as V
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LEDGER = [V.LEDGER_SQL, "jd AS (SELECT * FROM ledger WHERE vote IN ('DOWN', 'FLAT', 'UP') AND NOT coalesce(harness_fail, false))"]
_JUDGED = "(coalesce(vote IN ('DOWN', 'FLAT', 'UP'), false) AND NOT coalesce(harness_fail, false))"
_SV = "CASE WHEN score > 0.2 THEN 'UP' WHEN score < -0.2 THEN 'DOWN' ELSE 'FLAT' END"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(
    sql(
        [*LEDGER, f"s AS (SELECT 0 AS step, 'attempted' AS stage, count(*) AS n FROM ledger UNION ALL SELECT 1, 'rated', count(DISTINCT case_id) FROM ledger UNION ALL SELECT 2, 'judged', count(*) FROM jd UNION ALL SELECT 3, 'kept', count(*) FILTER (kept) FROM ledger)"],
        "SELECT *, n / nullif(lag(n) OVER (ORDER BY step), 0) AS retention FROM s", ["step", "stage", "n"], ["retention"],
    )
)
def ledger_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.funnel(V.ledger(spark, sf_dir)))


@query(sql([*LEDGER, "l AS (SELECT unnest(['DOWN', 'FLAT', 'UP']) AS label)"], "SELECT l.label, " + ", ".join(f"count(*) FILTER (jd.vote = '{v}') AS {v}" for v in J.VOTES) + " FROM l LEFT JOIN jd USING (label) GROUP BY 1", ["label", *J.VOTES]))
def vote_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.vote_matrix(V.ledger(spark, sf_dir))


_HIST = "h AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(CAST(vote = label AS INTEGER)) AS hit_rate, avg(conf) AS mean_conf FROM jd WHERE conf IS NOT NULL GROUP BY 1)"


@query(sql([*LEDGER, _HIST], "SELECT * FROM h", ["bin", "n"], ["hit_rate", "mean_conf"]))
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.confidence_histogram(V.ledger(spark, sf_dir)))


@query(sql([*LEDGER, _HIST], "SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(hit_rate - mean_conf)) / sum(n) AS ece FROM h", ["n"], ["ece"]))
def vote_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.vote_calibration_error(V.ledger(spark, sf_dir)))


@query(sql(LEDGER, f"SELECT vote = label AS vote_right, {_SV} = label AS score_right, count(*) AS n FROM jd GROUP BY 1, 2", ["vote_right", "score_right", "n"]))
def vote_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.disagreement(V.ledger(spark, sf_dir))


@query(sql(LEDGER, f"SELECT CASE WHEN coalesce(harness_fail, false) THEN 'failed' WHEN {_JUDGED} THEN 'judged' ELSE 'unjudged' END AS outcome, count(*) AS n, quantile_cont(secs, 0.5) AS p50, quantile_cont(secs, 0.9) AS p90, avg(secs) AS mean FROM ledger WHERE secs >= 0 GROUP BY 1", ["outcome", "n"], ["p50", "p90", "mean"]))
def rating_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.latency(V.ledger(spark, sf_dir)))


def _cohort(by: str) -> str:
    return sql(LEDGER, f"SELECT {by}, count(*) AS n, count(*) FILTER {_where(_JUDGED)} AS judged, avg(CAST(vote = label AS INTEGER)) FILTER {_where(_JUDGED)} AS hit_rate, count(*) FILTER (kept) AS kept FROM ledger GROUP BY 1", [by, "n", "judged", "kept"], ["hit_rate"])


def _where(c: str) -> str:
    return f"(WHERE {c})"


@query(_cohort("no_news"))
def news_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.cohorts(V.ledger(spark, sf_dir), "no_news"))


@query(_cohort("symbol"))
def symbol_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.cohorts(V.ledger(spark, sf_dir), "symbol"))


@query(_cohort("pool"))
def pool_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.cohorts(V.ledger(spark, sf_dir), "pool"))


@query(sql(LEDGER, "SELECT seq, count(*) OVER w AS done, CAST(sum(CAST(vote = label AS INTEGER)) OVER w AS BIGINT) AS hits, avg(CAST(vote = label AS INTEGER)) OVER (ORDER BY seq ROWS 49 PRECEDING) AS trailing_rate FROM jd WINDOW w AS (ORDER BY seq)", ["seq", "done", "hits"], ["trailing_rate"]))
def ledger_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.progress(V.ledger(spark, sf_dir)))


@query(sql([], "SELECT coalesce(fail_reason, '(missing)') AS value, count(*) AS n, count(*) / (SELECT count(*) FROM harness_results) AS share FROM harness_results GROUP BY 1 ORDER BY n DESC, value LIMIT 12", ["value", "n"], ["share"]))
def reason_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.value_shares(table(spark, sf_dir, "harness_results"), "fail_reason"))


@query(sql(LEDGER, "SELECT count(*) AS n, count(DISTINCT symbol) AS n_symbols, avg(conf) AS mean_conf, quantile_cont(conf, 0.1) AS p10_conf, quantile_cont(conf, 0.9) AS p90_conf, min(decision_date) AS first_date, max(decision_date) AS last_date, avg(CAST(coalesce(harness_fail, false) AS INTEGER)) AS fail_rate FROM ledger", ["n", "n_symbols", "first_date", "last_date"], ["mean_conf", "p10_conf", "p90_conf", "fail_rate"]))
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.summary(V.ledger(spark, sf_dir)))


@query(sql([*LEDGER, f"a AS (SELECT count(*) AS n, avg(CAST(vote = label AS INTEGER)) AS v, avg(CAST({_SV} = label AS INTEGER)) AS s FROM jd)"], "SELECT n, v AS vote_rate, s AS score_rate, v - s AS delta, 2 * sqrt((v * (1 - v) + s * (1 - s)) / n) AS two_se, coalesce(n >= 30 AND v - s > 2 * sqrt((v * (1 - v) + s * (1 - s)) / n), false) AS passed FROM a", ["n", "passed"], ["vote_rate", "score_rate", "delta", "two_se"]))
def ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.gate(V.ledger(spark, sf_dir)))


@query(sql(LEDGER, "SELECT seq, case_id, decision_date, vote, label, count(*) OVER () AS total FROM ledger WHERE vote = 'UP' AND vote = label ORDER BY decision_date DESC NULLS LAST, seq DESC LIMIT 20 OFFSET 10", ["seq", "case_id", "decision_date", "vote", "label", "total"]))
def case_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.case_page(V.ledger(spark, sf_dir), "UP", True, 10, 20)


_DRAW = "sha256(CAST(seq AS VARCHAR) || '|7')"


@query(sql([*LEDGER, f"r AS (SELECT seq, label, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, seq) AS r FROM ledger)"], "SELECT seq, label FROM r WHERE r <= CASE label WHEN 'DOWN' THEN 500 WHEN 'FLAT' THEN 250 ELSE 750 END", ["seq", "label"]))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stratified(V.ledger(spark, sf_dir), "label", {"DOWN": 500, "FLAT": 250, "UP": 750}, "seq").select("seq", "label")


@query(sql([*LEDGER, f"r AS (SELECT seq, row_number() OVER (ORDER BY {_DRAW}, seq) AS r, count(*) OVER () AS n FROM ledger)"], "SELECT seq, CASE WHEN r <= greatest(1, floor(n * 0.05)) THEN 'validation' ELSE 'train' END AS part FROM r", ["seq", "part"]))
def permutation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.permutation_split(V.ledger(spark, sf_dir), "seq")


@query(sql(LEDGER, "SELECT seq, concat_ws(';', CASE WHEN vote IS NULL THEN 'no-vote' END, CASE WHEN coalesce(harness_fail, false) THEN 'failed' END, CASE WHEN no_news THEN 'no-news' END, CASE WHEN vote <> label THEN 'mismatch' END, CASE WHEN conf < 0.3 THEN 'unsure' END) AS reasons FROM ledger", ["seq", "reasons"]))
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.reasons(V.ledger(spark, sf_dir))


@query(sql(["e AS (SELECT event_id, CAST(user_id % 20 AS INTEGER) AS part, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i, lead(event_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) IS NULL AS z FROM events)"], "SELECT event_id, part FROM e WHERE (i - 1) % 10 = 0 OR z", ["event_id", "part"]))
def thinned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).cast("int").alias("part"))
    return J.thinned(e, "event_id", 10, "part")


_RULES = {"argmax": "predicted", "flat": "CASE WHEN p_flat >= 0.4 THEN 1 WHEN p_down >= p_up THEN 0 ELSE 2 END", "cascade": "CASE WHEN p_flat >= 0.4 THEN 1 WHEN p_down >= 0.35 THEN 0 WHEN p_down >= p_up THEN 0 ELSE 2 END"}
_LEVEL = "x AS (" + " UNION ALL ".join(f"SELECT id AS c, '{name}' AS level, CAST({rule} = actual AS INTEGER) AS v FROM predictions" for name, rule in _RULES.items()) + ")"


@query(sql([V.predictions_sql(), _LEVEL, "g AS (SELECT a.level AS level_a, b.level AS level_b, count(*) AS n, count(*) FILTER (a.v = 1 AND b.v = 0) AS a, count(*) FILTER (b.v = 1 AND a.v = 0) AS b FROM x a JOIN x b ON a.c = b.c AND a.level < b.level GROUP BY 1, 2 HAVING count(*) >= 10)"], f"SELECT level_a, level_b, n, a AS only_a, b AS only_b, {_MC} AS p_value, CASE WHEN {_MC} < 0.05 THEN CASE WHEN a > b THEN level_a ELSE level_b END END AS winner FROM g", ["level_a", "level_b", "n", "only_a", "only_b", "winner"], ["p_value"]))
def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = {"argmax": F.col("predicted"), "flat": D.flat_rule(0.4), "cascade": D.cascade(0.4, 0.35)}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), (call == F.col("actual")).cast("int").alias("value")) for name, call in calls.items()])).alias("r")
    return rounded(J.level_pairs(V.predictions(spark, sf_dir).select("id", each).select("id", "r.*"), "id", "level", "value"))


# Text functions.


@query("SELECT ingest_id, substr(sha256(concat_ws('|', trim(coalesce(source, '')), trim(coalesce(title, '')), trim(coalesce(published_utc, '')))), 1, 32) AS id FROM news_articles")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles").select("ingest_id", T.article_id(F.col("source"), F.col("title"), F.col("published_utc")).alias("id"))


@query("SELECT ingest_id, coalesce(sentiment, CASE lower(sentiment_label) WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 END, 0.0) AS value FROM news_articles")
def sentiment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles").select("ingest_id", T.sentiment_value(F.col("sentiment").cast("string"), F.col("sentiment_label")).alias("value"))


@query("SELECT msg_id, nullif(split_part(case_id, '|', 1), '') AS symbol, TRY_CAST(split_part(case_id, '|', 2) AS DATE) AS day, nullif(split_part(case_id, '|', 3), '') AS hash FROM harness_results")
def case_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "harness_results").select("msg_id", T.case_parts(F.col("case_id")).alias("p")).select("msg_id", "p.*")


@query(
    r"""WITH r AS (SELECT msg_id, coalesce(thinking, '') AS thinking, regexp_extract(coalesce(content, ''), '(\{[^{}]*"vote"[^{}]*\})', 1, 's') AS raw FROM harness_results),
    o AS (SELECT *, json_valid(raw) AND raw <> '' AS ok, CASE WHEN json_valid(raw) AND raw <> '' THEN raw END AS j FROM r),
    v AS (SELECT *, upper(coalesce(json_extract_string(j, '$.vote'), '')) AS vote, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence, TRY_CAST(json_extract_string(j, '$.sentiment') AS DOUBLE) AS sentiment, replace(coalesce(json_extract_string(j, '$.trace_steps'), '[1,2,3,4]'), ' ', '') AS steps FROM o),
    w AS (SELECT *, CASE WHEN length(trim(thinking)) < 50 THEN 'empty-thinking' WHEN raw = '' THEN 'no-json-vote' WHEN NOT ok THEN 'json-parse' WHEN vote NOT IN ('UP', 'DOWN', 'FLAT') THEN 'bad-vote:' || vote
      WHEN confidence IS NULL OR sentiment IS NULL THEN 'bad-numbers' WHEN NOT (sentiment BETWEEN -1 AND 1 AND confidence BETWEEN 0 AND 1) THEN 'out-of-range' WHEN steps <> '[1,2,3,4]' THEN 'bad-trace-steps'
      WHEN vote = 'UP' AND sentiment < 0 OR vote = 'DOWN' AND sentiment > 0 OR vote = 'FLAT' AND abs(sentiment) >= 0.5 THEN 'sign-mismatch' ELSE '' END AS reason FROM v)
    SELECT msg_id, CASE WHEN reason = '' THEN vote END AS vote, CASE WHEN reason = '' THEN confidence END AS confidence, CASE WHEN reason = '' THEN sentiment END AS sentiment, reason FROM w"""
)
def rated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "harness_results").select("msg_id", T.rated_answer(F.col("content"), F.col("thinking")).alias("r")).select("msg_id", "r.*")


def _leak_sql() -> str:
    one = lambda p: f"len(regexp_extract_all(t, '(?i){p}'))" if p != T._ISO_DATE else f"len(list_filter(regexp_extract_all(t, '{p}'), lambda d: coalesce(TRY_CAST(d AS DATE) > decision_date, true)))"
    counts = ", ".join(f"CAST({' + '.join(map(one, patterns))} AS INTEGER) AS {name}" for name, patterns in T.LEAK_PATTERNS.items())
    return f"WITH x AS (SELECT msg_id, decision_date, concat_ws(' ', thinking, content) AS t FROM harness_results) SELECT msg_id, {counts} FROM x"


@query(_leak_sql())
def leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "harness_results")
    return h.select("msg_id", *[c.alias(n) for n, c in T.leak_counts(F.concat_ws(" ", "thinking", "content"), F.col("decision_date")).items()])


@query("WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS b FROM orders) SELECT o_orderkey, CAST((SELECT count(*) FROM unnest(generate_series(a + 1, b, INTERVAL 1 DAY)) t(d) WHERE isodow(d) <= 5) AS INTEGER) AS n FROM o")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.business_days(a, F.date_add(a, (F.col("o_orderkey") % 30).cast("int"))).alias("n"))
