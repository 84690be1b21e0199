"""Domain views over the provided tables: bars, macro series, articles, memberships, predictions and a rating ledger.

Each view exists as a DataFrame and as SQL with the same tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): weekly bars of each supplier's unit prices; their number grows with the data."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct(*_ORDER)
    symbol = F.concat(F.lit("V"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(symbol.alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume")
    )


BARS_SQL = f"""bars AS (
  SELECT 'V' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
    first(l_extendedprice / l_quantity ORDER BY {", ".join(_ORDER)}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY {", ".join(_ORDER)}) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MACRO = ["m_urgent", "m_high", "m_medium", "m_unspecified", "m_low"]


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, m_urgent, m_high, m_medium, m_unspecified, m_low): weekly mean order price by priority, side by side; gaps are null."""
    o = table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("ts"), "o_orderpriority", "o_totalprice")
    wide = o.groupBy("ts").pivot("o_orderpriority", PRIORITIES).agg(F.avg("o_totalprice"))
    return wide.withColumnsRenamed(dict(zip(PRIORITIES, MACRO)))


MACRO_SQL = (
    "macro AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, "
    + ", ".join(f"avg(o_totalprice) FILTER (o_orderpriority = '{p}') AS {m}" for p, m in zip(PRIORITIES, MACRO))
    + " FROM orders GROUP BY 1)"
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, symbol, published_utc, subject, score): events of 25 symbols."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"), F.concat(F.lit("S"), (F.col("user_id") % 25).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("published_utc"), F.col("event_type").alias("subject"), F.col("value").alias("score")
    )


ARTICLES_SQL = "articles AS (SELECT event_id AS article_id, 'S' || CAST(user_id % 25 AS VARCHAR) AS symbol, ts AS published_utc, event_type AS subject, value AS score FROM events)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session): weekdays on which anything was published."""
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session")).distinct()
    return d.where(F.weekday("session") < 5)


SESSIONS_SQL = "sessions AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE isodow(CAST(ts AS DATE)) <= 5)"


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, bucket, from, to): intervals of suppliers, with gaps and open ends."""
    n = F.col("s_suppkey").cast("int")
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("V"), n.cast("string")).alias("symbol"), n.alias("n"))
    bucket = lambda k: F.concat(F.lit("B"), (k % 5).cast("string")).alias("bucket")
    early = b.where("n % 7 != 3").select("symbol", bucket(F.col("n")), F.lit("1992-01-01").cast("date").alias("from"), F.date_add(F.lit("1994-06-01").cast("date"), F.col("n") % 25 * 7).alias("to"))
    late = b.where("n % 4 != 1").select("symbol", bucket(F.col("n") + 1), F.date_add(F.lit("1995-06-01").cast("date"), F.col("n") % 200).alias("from"), F.lit(None).cast("date").alias("to"))
    return early.unionByName(late)


MEMBERSHIP_SQL = """vendors AS (SELECT 'V' || CAST(s_suppkey AS VARCHAR) AS symbol, CAST(s_suppkey AS INTEGER) AS n FROM supplier),
membership AS (
  SELECT symbol, 'B' || CAST(n % 5 AS VARCHAR) AS bucket, DATE '1992-01-01' AS "from", DATE '1994-06-01' + n % 25 * 7 AS "to" FROM vendors WHERE n % 7 <> 3
  UNION ALL SELECT symbol, 'B' || CAST((n + 1) % 5 AS VARCHAR), DATE '1995-06-01' + n % 200, NULL FROM vendors WHERE n % 4 <> 1)"""


def predictions(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    """(id, ts, symbol, actual, p_down, p_flat, p_up, predicted, event_start, event_end, realized): a scored row for each order; ``seed`` 0 or 1 is the model."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d, f, u = ((k * (37 + 4 * seed) + c * 11) % 100 + 1), ((k * (53 + 6 * seed) + c * 7) % 100 + 1), ((k * (71 + 2 * seed) + c * 13) % 100 + 1)
    total = d + f + u
    p = o.select(
        k.alias("id"), F.to_date("o_orderdate").alias("ts"), F.concat(F.lit("S"), (c % 25).cast("string")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("actual"),
        (d / total).alias("p_down"), (f / total).alias("p_flat"), (u / total).alias("p_up"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("event_start"), F.date_add(F.to_date("o_orderdate"), (1 + k % 5).cast("int")).alias("event_end"),
        ((k * 7919 + c * 31) % 2001 - 1000).cast("double").alias("__r"),
    )
    return p.withColumns({"predicted": argmax3("p_down", "p_flat", "p_up"), "realized": F.col("__r") / 20000}).drop("__r")


def argmax3(a: str, b: str, c: str):
    """Index of the largest of three columns, the lowest on ties."""
    return F.when((F.col(a) >= F.col(b)) & (F.col(a) >= F.col(c)), 0).when(F.col(b) >= F.col(c), 1).otherwise(2)


def predictions_sql(name: str = "predictions", seed: int = 0) -> str:
    d, f, u = f"((o_orderkey * {37 + 4 * seed} + o_custkey * 11) % 100 + 1)", f"((o_orderkey * {53 + 6 * seed} + o_custkey * 7) % 100 + 1)", f"((o_orderkey * {71 + 2 * seed} + o_custkey * 13) % 100 + 1)"
    return f"""{name} AS (
  SELECT *, CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 0 WHEN p_flat >= p_up THEN 1 ELSE 2 END AS predicted FROM (
    SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS ts, 'S' || CAST(o_custkey % 25 AS VARCHAR) AS symbol,
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS actual,
      CAST({d} AS DOUBLE) / ({d} + {f} + {u}) AS p_down, CAST({f} AS DOUBLE) / ({d} + {f} + {u}) AS p_flat, CAST({u} AS DOUBLE) / ({d} + {f} + {u}) AS p_up,
      CAST(o_orderdate AS DATE) + 1 AS event_start, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 5 AS INTEGER) AS event_end,
      CAST((o_orderkey * 7919 + o_custkey * 31) % 2001 - 1000 AS DOUBLE) / 20000 AS realized
    FROM orders))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, case_id, symbol, decision_date, pool, vote, conf, label, harness_fail, kept, no_news, secs, score): one row a rating message."""
    h = table(spark, sf_dir, "harness_results")
    label = F.element_at(F.array(*map(F.lit, ["DOWN", "FLAT", "UP"])), (F.col("msg_id") * 7 % 3 + 1).cast("int"))
    vote = F.upper(F.trim("vote"))
    return h.select(
        F.col("msg_id").alias("seq"), F.upper(F.trim("case_id")).alias("case_id"), "symbol", "decision_date", "pool", vote.alias("vote"), F.col("confidence").alias("conf"), label.alias("label"), "harness_fail",
        (F.coalesce(vote == label, F.lit(False)) & ~F.coalesce("harness_fail", F.lit(False))).alias("kept"), F.coalesce("no_news", F.lit(False)).alias("no_news"),
        F.regexp_replace("seconds", "s$", "").try_cast("double").alias("secs"), F.col("sentiment").alias("score"),
    )


LEDGER_SQL = """ledger AS (
  SELECT *, coalesce(vote = label, false) AND NOT coalesce(harness_fail, false) AS kept FROM (
    SELECT msg_id AS seq, upper(trim(case_id)) AS case_id, symbol, decision_date, pool, upper(trim(vote)) AS vote, confidence AS conf,
      ['DOWN', 'FLAT', 'UP'][CAST(msg_id * 7 % 3 + 1 AS INTEGER)] AS label, harness_fail, coalesce(no_news, false) AS no_news,
      CASE WHEN regexp_matches(regexp_replace(seconds, 's$', ''), '^[0-9.]+(e[0-9]+)?$') THEN TRY_CAST(regexp_replace(seconds, 's$', '') AS DOUBLE) END AS secs, sentiment AS score
    FROM harness_results))"""
