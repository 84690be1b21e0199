"""Incremental ingest: merged history, deduplication, high-water marks, holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_history(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the fresh row of a key replaces the existing one. Each side has a key once."""
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the largest ``order``; a maximum, so combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[c if c in keys else F.col(f"__best.`{c}`").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the smallest ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[c if c in keys else F.col(f"__best.`{c}`").alias(c) for c in df.columns])


def high_water(df: DataFrame, entity: str = "symbol", ts: str = "ts") -> DataFrame:
    """(entity, last_ts, fetch_from): the day after the last one of each entity."""
    return df.groupBy(entity).agg(F.max(ts).alias("last_ts")).withColumn("fetch_from", F.date_add("last_ts", 1))


def missing_sessions(df: DataFrame, sessions: DataFrame, entity: str = "symbol", ts: str = "ts", session: str = "session") -> DataFrame:
    """(entity, session): sessions between an entity's first and last row on which it has none.

    The number of a session in the calendar makes holes visible as jumps, so
    only sessions that are missing are ever made.
    """
    # The calendar is one row a session: a single ordered partition is enough.
    numbered = sessions.select(F.col(session).alias("__s")).distinct().withColumn("__n", F.row_number().over(Window.orderBy("__s")))
    own = df.select(entity, F.col(ts).alias("__s")).distinct().join(numbered, "__s")
    jumps = own.withColumn("__prev", F.lag("__n").over(Window.partitionBy(entity).orderBy("__n"))).where("__n - __prev > 1")
    holes = jumps.select(entity, F.explode(F.sequence(F.col("__prev") + 1, F.col("__n") - 1)).alias("__n"))
    return holes.join(numbered, "__n").select(entity, F.col("__s").alias(session))


def hole_summary(holes: DataFrame, entity: str = "symbol", session: str = "session", first: int = 20) -> DataFrame:
    """(entity, n_holes, first_hole, last_hole, holes): count, ends and the first ``first`` holes as text."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(session))
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__r") <= first, F.col(session).cast("string")))), ",")
    return holes.withColumn("__r", rank).groupBy(entity).agg(F.count(F.lit(1)).alias("n_holes"), F.min(session).alias("first_hole"), F.max(session).alias("last_hole"), listed.alias("holes"))


def unprocessed(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases whose key is not done yet."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def reconcile_log(log: DataFrame, backfill: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """``log`` and those rows of ``backfill`` whose keys it lacks, with missing fields filled."""
    missing = backfill.join(log.select(*keys).distinct(), keys, "left_anti")
    merged = log.unionByName(missing, allowMissingColumns=True)
    return merged.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in merged.columns else F.lit(v) for c, v in defaults.items()})


def coverage(df: DataFrame, group: str, entity: str, ts: str) -> DataFrame:
    """(group, n_entities, n_rows, first, last, stalest): rows and dates of each group, and how far its most backward entity got."""
    each = df.groupBy(group, entity).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("z"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_rows"), F.min("a").alias("first"), F.max("z").alias("last"), F.min("z").alias("stalest"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, fingerprint): a hash that does not depend on the order of rows."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("fingerprint"))
