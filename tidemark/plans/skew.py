"""Joins that survive hot keys, and broadcasts with a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast. Narrow rows of a dimension: some tens of MB at most.
BROADCAST_ROWS = 200_000
#: Copies of a hot key's dimension rows, so that the key spreads over as many tasks.
SALTS = 16
#: A key is hot that holds this share of all rows, and at least so many rows.
HOT_SHARE = 0.001
HOT_ROWS = 10_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join ``facts`` with ``dim`` whatever the skew of ``facts``.

    ``dim`` is broadcast while a count proves it small; with ``max_rows`` 0 it
    is never counted. Beyond that the join is ``salted_join``. ``how`` is inner,
    left, left_semi or left_anti. Null keys match nothing.
    """
    if max_rows and fits(dim, max_rows):
        return facts.join(F.broadcast(dim), keys, how)
    return salted_join(facts, dim, keys, how, spread, salts)


def hot_keys(facts: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``share`` of all rows of ``facts``, and more than ``floor`` rows: at most ``1 / share`` of them.

    Counted by key with a map-side combine, so a hot key is one row a task.
    """
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor)
    # What is under the floor is no part of the total here; that lowers no hot key's share below the true one.
    total = counts.select(F.sum("__n").alias("s"))
    return counts.where(F.col("__n") > total.scalar() * share).select(*keys)


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", spread: Column | None = None, salts: int = SALTS, hot_floor: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Shuffled equi-join in which only keys that hold a large share of ``facts`` are salted.

    Rows of ``dim`` with a hot key are copied ``salts`` times and ``facts`` rows
    of it pick a copy by the hash of ``spread`` (by default the whole row); all
    other rows have salt 0 and no copies. Hot keys are few by definition, so the
    list of them is broadcast. A caller that knows them already gives ``hot``.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]) if spread is None else F.xxhash64(spread)
    hot = (hot_keys(facts, keys, floor=hot_floor) if hot is None else hot.select(*keys)).withColumn("__hot", F.lit(True))
    marked = lambda df: df.join(F.broadcast(hot), keys, "left")
    salted = marked(facts).withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    copies = marked(dim).withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def split_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    counts: DataFrame,
    count_col: str,
    how: str = "left",
    hot_share: float = 0.001,
    hot_floor: int = 10_000,
) -> DataFrame:
    """Join ``facts`` with a ``dim`` that has one row for each key and as many keys as it likes.

    ``counts`` has the number of ``facts`` rows by key. Keys with more than
    ``hot_share`` of all rows are hot: there are at most ``1 / hot_share`` of
    them, which bounds the broadcast; all other keys are joined by a shuffle in
    which none is large.
    """
    total = counts.agg(F.sum(count_col)).first()[0] or 0
    floor = max(hot_floor, int(total * hot_share))
    hot = counts.where(F.col(count_col) > floor).select(*keys)
    if total <= hot_floor or hot.limit(1).count() == 0:
        return facts.join(dim, keys, how)
    hot_dim = F.broadcast(dim.join(F.broadcast(hot), keys, "left_semi"))
    hot_facts = facts.join(F.broadcast(hot), keys, "left_semi").join(hot_dim, keys, how)
    cold_facts = facts.join(F.broadcast(hot), keys, "left_anti").join(dim, keys, how)
    return hot_facts.unionByName(cold_facts)
