"""Queries of the general training-data problems over the provided tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.core_sql import ORACLE_SQL  # noqa: F401
from tidemark.operators.asof import versions_at
from tidemark.operators.deliveries import exactly_once, repeated_deliveries
from tidemark.operators.instants import news_instants, normalized_times
from tidemark.operators.trailing import idle_days, trailing_totals
from tidemark.plans.oracle import rounded
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable time text as microseconds."""
    return normalized_times(table(spark, sf_dir, "news_articles"), table(spark, sf_dir, "feed_sources"), table(spark, sf_dir, "harness_results"), table(spark, sf_dir, "run_settings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that repeat an earlier delivery."""
    return repeated_deliveries(table(spark, sf_dir, "harness_results"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with one delivery of each case."""
    return exactly_once(table(spark, sf_dir, "harness_results")).select("msg_id", "batch_id", "case_id", "harness_fail", "fail_reason")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a symbol whose trailing news total is 0."""
    return idle_days(table(spark, sf_dir, "feature_panel"))


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trailing totals and averages over 7 and 30 days, cut to a few digits."""
    measures = ["news_count", "ret_20", "volatility_20"]
    wide = trailing_totals(table(spark, sf_dir, "feature_panel"), measures, [7, 30])
    return rounded(wide.withColumn("cal_day", F.date_format("cal_day", "yyyy-MM-dd")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of the symbol that was valid and known at the time of each event."""
    news = table(spark, sf_dir, "news_articles").select("ingest_id", "symbol", "published_utc", "source", "received_at")
    timed = news_instants(news, table(spark, sf_dir, "feed_sources"))
    scores = table(spark, sf_dir, "sentiment_records")
    events = timed.select(F.lit("news_articles").alias("event_table"), F.col("ingest_id").alias("event_id"), "symbol", "norm_micros").unionByName(
        scores.select(F.lit("sentiment_records").alias("event_table"), F.col("record_id").alias("event_id"), "symbol", F.unix_micros("ts").alias("norm_micros"))
    )
    return versions_at(events, table(spark, sf_dir, "symbol_versions"), "symbol", "norm_micros", ["event_table", "event_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_kept, p5_found, p5_trailing, p6_found)
}
