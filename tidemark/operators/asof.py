"""Attributes of an entity as they were known at the time of an event.

A version holds over [valid_from, valid_to) and counts only from ``known_at``
on. The instants at which the answer for an entity can change are the starts
(later of valid_from and known_at) and the ends of its versions. Between two of
them the answer is constant, so each event needs only the number of changes up
to its time: a cumulative count over narrow rows of timestamps. The wide
attributes follow by an equi-join on entity and number.

The count is taken in two levels, days and instants within a day, so that an
entity with a third of all events is spread over as many tasks as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.skew import bounded_join

_DAY_US = 86_400_000_000
#: Levels of blocks of numbers; an entity can have 2 ** 30 changes.
_LEVELS = 31


def _day(c: str) -> Column:
    return F.floor(F.col(c) / F.lit(_DAY_US)).cast("long")


def entity_key(symbol: str):
    """Entity name without case and outer blanks; null and blank names are no entity."""
    name = F.upper(F.regexp_replace(F.col(symbol), r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def change_points(versions: DataFrame, entity: str = "symbol") -> DataFrame:
    """(entity_key, at): the distinct instants, in microseconds, at which an entity's answer can change."""
    v = versions.select(
        entity_key(entity).alias("entity_key"),
        F.unix_micros(F.greatest("valid_from", "known_at")).alias("start"),
        F.unix_micros("valid_to").alias("end"),
        F.col("valid_from").isNotNull().alias("a"),
        F.col("known_at").isNotNull().alias("b"),
    ).where("entity_key is not null and a and b")
    return v.select("entity_key", F.explode(F.array_compact(F.array("start", "end"))).alias("at")).distinct()


def numbered_changes(points: DataFrame) -> DataFrame:
    """(entity_key, at, number, total): changes of each entity numbered from 1 in order of time, by days and within a day, and how many it has."""
    dated = points.withColumn("day", _day("at"))
    per_day = dated.groupBy("entity_key", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("entity_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    carried = per_day.select("entity_key", "day", F.coalesce(before, F.lit(0)).alias("carried"), F.sum("n").over(Window.partitionBy("entity_key")).alias("total"))
    own = F.row_number().over(Window.partitionBy("entity_key", "day").orderBy("at"))
    return dated.withColumn("own", own).join(carried, ["entity_key", "day"]).select("entity_key", "at", (F.col("own") + F.col("carried")).cast("int").alias("number"), F.col("total").cast("int").alias("total"))


def _dyadic(first: Column, end: Column) -> Column:
    """Array of (level, node): the fewest aligned blocks of 2 ** level numbers that make up [first, end)."""
    none = F.array().cast("array<struct<level:int,node:int>>")
    # Level by level from the bottom, an odd left end and an odd right end each give one block.
    step = lambda s, level: F.struct(
        F.shiftright(s["a"] + 1, 1).alias("a"),
        F.shiftright(s["b"], 1).alias("b"),
        F.concat(
            s["nodes"],
            F.when((s["a"] < s["b"]) & (s["a"] % 2 == 1), F.array(F.struct(level.alias("level"), s["a"].alias("node")))).otherwise(none),
            F.when((s["a"] < s["b"]) & (s["b"] % 2 == 1), F.array(F.struct(level.alias("level"), (s["b"] - 1).alias("node")))).otherwise(none),
        ).alias("nodes"),
    )
    start = F.struct(first.cast("int").alias("a"), end.cast("int").alias("b"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), start, step)["nodes"]


def version_timeline(versions: DataFrame, entity: str = "symbol", id_col: str = "version_id") -> DataFrame:
    """(entity_key, number, version id): the version that holds after the ``number``-th change of its entity.

    Of several versions the latest valid_from wins, then the latest known_at,
    then the largest id. Numbers without a valid version are left out. A version
    holds over a run of numbers, which a few aligned blocks make up; each block
    keeps its best version, and each number asks the blocks that it lies in. So
    an entity with a long history costs its length times the logarithm of it,
    and no pair of changes and versions is formed.
    """
    points = numbered_changes(change_points(versions, entity))
    v = versions.select(
        entity_key(entity).alias("entity_key"),
        F.unix_micros("valid_from").alias("f"),
        F.unix_micros("valid_to").alias("t"),
        F.unix_micros("known_at").alias("k"),
        F.col(id_col).alias("v"),
    ).where("entity_key is not null and f is not null and k is not null")
    at = lambda c, n, *more: points.select("entity_key", F.col("at").alias(c), F.col("number").alias(n), *more)
    held = v.withColumn("start", F.greatest("f", "k")).join(at("start", "first", "total"), ["entity_key", "start"]).join(at("t", "end"), ["entity_key", "t"], "left")
    # A version without end holds over every later number.
    runs = held.select("entity_key", "f", "k", "v", "first", F.coalesce("end", F.col("total") + 1).alias("end"))
    blocks = runs.select("entity_key", F.explode(_dyadic(F.col("first"), F.col("end"))).alias("b"), F.struct("f", "k", "v").alias("x")).groupBy("entity_key", "b").agg(F.max("x").alias("x"))
    asked = points.select("entity_key", "number", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.col("total") + 1.0)).cast("int")), lambda l: F.struct(l.alias("level"), F.floor(F.col("number") / F.pow(F.lit(2.0), l)).cast("int").alias("node")))).alias("b"))
    best = asked.join(blocks, ["entity_key", "b"]).groupBy("entity_key", "number").agg(F.max("x").alias("best"))
    return best.select("entity_key", "number", F.col("best.v").alias(id_col))


def versions_at(events: DataFrame, versions: DataFrame, entity: str, micros: str, event_id: list[str], versions_entity: str = "symbol", id_col: str = "version_id") -> DataFrame:
    """``event_id`` columns of ``events`` and the version that was valid and known at ``micros``.

    Events without time, entity or version are left out. Only narrow columns
    are shuffled; join the result with events and versions for the rest.
    """
    narrow = events.select(*event_id, entity_key(entity).alias("entity_key"), F.col(micros).alias("at")).where("entity_key is not null and at is not null")
    points = change_points(versions, versions_entity)

    # First level: changes before each day on which an entity has any event.
    event_days = narrow.select("entity_key", _day("at").alias("day")).distinct().withColumn("n", F.lit(0).cast("long"))
    change_days = points.select("entity_key", _day("at").alias("day")).groupBy("entity_key", "day").agg(F.count(F.lit(1)).alias("n"))
    days = event_days.unionByName(change_days).groupBy("entity_key", "day").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("entity_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select("entity_key", "day", F.coalesce(before, F.lit(0)).alias("carried"))

    # Second level: a carry row opens each day; events count it and the day's changes up to their time.
    no_ids = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in event_id]
    opening = carried.select(*no_ids, "entity_key", "day", F.lit(None).cast("long").alias("at"), F.col("carried").alias("step"), F.lit(False).alias("is_event"))
    changes = points.select(*no_ids, "entity_key", _day("at").alias("day"), "at", F.lit(1).cast("long").alias("step"), F.lit(False).alias("is_event"))
    asked = narrow.select(*event_id, "entity_key", _day("at").alias("day"), "at", F.lit(0).cast("long").alias("step"), F.lit(True).alias("is_event"))
    order = Window.partitionBy("entity_key", "day").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    numbered = opening.unionByName(changes).unionByName(asked).withColumn("number", F.sum("step").over(order)).where("is_event")

    timeline = version_timeline(versions, versions_entity, id_col)
    numbered = numbered.select(*event_id, "entity_key", F.col("number").cast("int").alias("number"))
    return bounded_join(numbered, timeline, ["entity_key", "number"], "inner", spread=F.xxhash64(*[F.col(c) for c in event_id])).select(*event_id, id_col)


def with_attributes(events: DataFrame, versions: DataFrame, entity: str, micros: str, event_id: list[str], attributes: list[str], id_col: str = "version_id") -> DataFrame:
    """``events`` with ``attributes`` of the version valid and known at their time, prefixed ``asof_``; null without one."""
    ids = versions_at(events, versions, entity, micros, event_id, id_col=id_col)
    wide = bounded_join(ids, versions.select(id_col, *[F.col(a).alias(f"asof_{a}") for a in attributes]), [id_col], "inner")
    return events.join(wide.withColumnRenamed(id_col, f"asof_{id_col}"), event_id, "left")
