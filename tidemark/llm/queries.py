"""Queries of the text problems over the provided tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.defects import pair_defects
from tidemark.llm.encoding import restored_texts
from tidemark.llm.leakage import leaked_items
from tidemark.llm.overlap import cross_split_pairs, overlap_report
from tidemark.llm.packing import container_fill, pack_documents
from tidemark.llm.truncation import truncation_rates, truncation_scores
from tidemark.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and a validation or test row with the same case or article."""
    return cross_split_pairs(table(spark, sf_dir, "star_candidates")).select("cand_id_a", "cand_id_b")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pairs counted by split and source of the evaluation row."""
    return overlap_report(table(spark, sf_dir, "star_candidates"))


def p3_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pairs that have the same case, whatever their articles."""
    return cross_split_pairs(table(spark, sf_dir, "star_candidates")).where("by_case").select("cand_id_a", "cand_id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose content is no proper answer to its prompt."""
    return pair_defects(table(spark, sf_dir, "harness_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose thinking is cut off."""
    scores = truncation_scores(table(spark, sf_dir, "harness_results"), "msg_id", "thinking")
    return scores.where("cut").select(F.col("row_id").alias("msg_id"))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut thinking by source."""
    messages = table(spark, sf_dir, "harness_results")
    return truncation_rates(messages, truncation_scores(messages, "msg_id", "thinking"), "msg_id", "source")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of a document above the capacity, for every budget."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each budget are."""
    return container_fill(p8_packing(spark, sf_dir), table(spark, sf_dir, "context_budgets"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing must keep: all documents of each budget, no container over its capacity, no document split below it, no piece missing or twice."""
    packing, budgets = p8_packing(spark, sf_dir), table(spark, sf_dir, "context_budgets").select("budget_id", "capacity_tokens")
    over = packing.where("container is not null").groupBy("budget_id", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(budgets), "budget_id").where("used > capacity_tokens").groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_over"))
    docs = packing.groupBy("budget_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("m"), F.max("n_pieces").alias("p"), F.sum("tokens").alias("t"))
    wrong = (F.col("n") != F.col("p")) | (F.col("m") != F.col("p")) | (F.col("p") != F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("capacity_tokens"))))
    figures = docs.join(F.broadcast(budgets), "budget_id").groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(wrong).alias("n_wrong"))
    return figures.join(over, "budget_id", "left").select("budget_id", "n_docs", F.coalesce("n_over", F.lit(0)).alias("n_over"), "n_wrong")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain passages of evaluation items."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text, and the length of the whole restored text, or -1 where characters are gone."""
    fixed = restored_texts(table(spark, sf_dir, "documents"))
    length = F.when(F.col("lost"), F.lit(-1)).otherwise(F.length("restored"))
    return fixed.select("doc_id", length.cast("long").alias("restored_chars"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with their restored text."""
    return restored_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p3_found, p3_report, p3_cases, p4_found, p7_found, p7_rates, p8_packing, p8_fill, p8_check, p9_found, p10_found, p10_restored)
}

_KEYED = "k AS (SELECT cand_id, upper(trim(case_id)) AS c, CASE WHEN lower(trim(split)) = 'train' THEN 't' WHEN lower(trim(split)) IN ('validation', 'test') THEN 'e' END AS side FROM star_candidates WHERE trim(case_id) <> '')"
ORACLE_SQL: dict[str, str] = {
    "p3_cases": f"WITH {_KEYED} SELECT least(t.cand_id, e.cand_id) AS cand_id_a, greatest(t.cand_id, e.cand_id) AS cand_id_b FROM k t JOIN k e ON t.c = e.c AND t.side = 't' AND e.side = 'e'",
    "p8_check": "SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS n_over, 0 AS n_wrong FROM context_budgets WHERE capacity_tokens > 0",
}
