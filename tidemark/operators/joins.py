"""Joins in time: next sessions, backward lookups, validity intervals, substrings, pairs and self-exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.plans.skew import bounded_join

# Local zone of the exchange and the time after which a text counts for the next day.
LOCAL_ZONE = "Asia/Kolkata"
CUT_OFF = "15:30:00"
#: First characters by which many aliases are looked up.
GRAM = 3


def next_session_map(sessions: DataFrame, before_days: int = 0) -> DataFrame:
    """(day, session): the first session on or after each day from the first session (less ``before_days``) to the last.

    One row a day of the calendar, so the lookup is an equi-join.
    """
    s = sessions.select("session").distinct()
    # The calendar is one row a day: a single ordered partition is enough.
    w = Window.orderBy("session")
    spans = s.select("session", F.coalesce(F.date_add(F.lag("session").over(w), 1), F.date_sub("session", before_days)).alias("start"))
    return spans.select(F.explode(F.sequence("start", "session")).alias("day"), "session")


def decision_day(published_utc: Column, zone: str = LOCAL_ZONE, cut_off: str = CUT_OFF) -> Column:
    """Local date of an instant, or the day after if it is strictly later than the cut-off."""
    local = F.from_utc_timestamp(published_utc, zone)
    late = F.date_format(local, "HH:mm:ss.SSSSSS") > F.lit(f"{cut_off}.000000")
    return F.date_add(F.to_date(local), late.cast("int"))


def with_decision_date(events: DataFrame, sessions: DataFrame, published: str = "published_utc") -> DataFrame:
    """``events`` with decision_date, the session whose decision they can enter first; events after the calendar are dropped.

    Events before the calendar belong to its first session.
    """
    day = decision_day(F.col(published))
    keyed = events.withColumn("__day", F.greatest(day, whole(sessions, first=F.min("session"))["first"]))
    lookup = next_session_map(sessions).select(F.col("day").alias("__day"), F.col("session").alias("decision_date"))
    return bounded_join(keyed, lookup, ["__day"], "inner").drop("__day")


def with_event_session(events: DataFrame, sessions: DataFrame, published: str = "published_utc") -> DataFrame:
    """``events`` with decision_date, the next session without a cut-off; events after the calendar go to its last session."""
    ends = whole(sessions, first=F.min("session"), last=F.max("session"))
    day = F.to_date(F.from_utc_timestamp(F.col(published), LOCAL_ZONE))
    keyed = events.withColumn("__day", F.least(F.greatest(day, ends["first"]), ends["last"]))
    lookup = next_session_map(sessions).select(F.col("day").alias("__day"), F.col("session").alias("decision_date"))
    return bounded_join(keyed, lookup, ["__day"], "inner").drop("__day")


def last_before(grid: DataFrame, events: DataFrame, out: str, strict: bool = False, entity: str = "symbol", ts: str = "ts") -> DataFrame:
    """``grid`` with the latest day of ``events`` (entity, ts) on or before each of its days, or strictly before.

    A union in time order and a running maximum; no pair of rows is ever formed.
    """
    marks = events.select(entity, ts).distinct().withColumn("__event", F.col(ts))
    both = grid.withColumn("__own", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(entity).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max("__event").over(w)
    if strict:
        # Days of events up to today, less today's own.
        today = F.max("__event").over(Window.partitionBy(entity, ts))
        before = F.lag("__event", 1).over(Window.partitionBy(entity).orderBy("__event"))
        marks2 = marks.withColumn("__prev", before).select(entity, F.col(ts), "__event", "__prev")
        both = grid.withColumn("__own", F.lit(True)).unionByName(marks2, allowMissingColumns=True)
        newest = F.max_by(F.struct("__event", "__prev"), "__event").over(w)
        both = both.withColumn("__n", newest).withColumn("__today", today)
        picked = F.when(F.col("__today").isNotNull(), F.col("__n.__prev")).otherwise(F.col("__n.__event"))
        return both.withColumn(out, picked).where("__own").drop("__own", "__event", "__prev", "__n", "__today")
    return both.withColumn(out, latest).where("__own").drop("__own", "__event")


def interval_join(facts: DataFrame, intervals: DataFrame, entity: str = "symbol", ts: str = "ts", start: str = "from", end: str = "to", values: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """``facts`` with ``values`` of each interval that holds at ``ts``, ends included; open ends are null.

    Rows without an interval keep nulls, rows in several come once for each.
    Intervals are looked up by entity and year, so that long histories don't
    multiply; the rest is a filter inside the join.
    """
    horizon = whole(facts, a=F.min(ts), z=F.max(ts))
    bounded = intervals.withColumns({"a": horizon["a"], "z": horizon["z"]}).where(F.coalesce(F.col(end), F.col("z")) >= F.col("a"))
    years = F.sequence(F.year(F.greatest(F.col(start), F.col("a"))), F.year(F.least(F.coalesce(F.col(end), F.col("z")), F.col("z"))))
    spread = bounded.where(F.greatest(F.col(start), F.col("a")) <= F.least(F.coalesce(F.col(end), F.col("z")), F.col("z"))).select(
        F.col(entity).alias("__e"), F.explode(years).alias("__y"), F.col(start).alias("__from"), F.col(end).alias("__to"), *values
    )
    on = (F.col(entity) == F.col("__e")) & (F.year(ts) == F.col("__y")) & (F.col(ts) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(ts) <= F.col("__to")))
    return facts.join(spread, on, "left").drop("__e", "__y", "__from", "__to")


def substring_matches(texts: DataFrame, aliases: DataFrame, text: str, alias: str, max_aliases: int = 1_000) -> DataFrame:
    """``texts`` once for each key of ``aliases`` (key, alias) one of whose aliases is in the upper-case text.

    Blank aliases are in no text. Up to ``max_aliases`` aliases, by count, go to
    every task as one array. More are joined by their first ``GRAM`` characters:
    each distinct text offers the distinct pieces of that length (all of its
    characters and pairs too, for shorter aliases), and those that meet an alias
    are tested. Equal texts are looked up once.
    """
    keyed = aliases.where(F.length(F.trim(alias)) > 0).select(F.col("key").alias("__key"), F.upper(alias).alias("__a")).distinct()
    rows = keyed.limit(max_aliases + 1).collect()
    if len(rows) <= max_aliases:
        table = F.array(*[F.struct(F.lit(r["__key"]).alias("key"), F.lit(r["__a"]).alias("a")) for r in sorted(rows, key=lambda r: (r["__key"], r["__a"]))])
        hay = F.upper(F.col(text))
        return texts.withColumn("key", F.explode(F.array_distinct(F.transform(F.filter(table, lambda x: hay.contains(x["a"])), lambda x: x["key"]))))
    hays = texts.select(F.upper(F.col(text)).alias("__hay")).where("length(__hay) > 0").distinct()

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("__hay") - n + 1, F.lit(1))), lambda i: F.substring("__hay", i, F.lit(n)))

    pieces = F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))
    found = bounded_join(hays.withColumn("__piece", F.explode(pieces)), keyed.withColumn("__piece", F.substring("__a", 1, GRAM)), ["__piece"], "inner")
    found = found.where(F.col("__hay").contains(F.col("__a"))).groupBy("__hay").agg(F.collect_set("__key").alias("__keys"))
    return texts.withColumn("__hay", F.upper(F.col(text))).join(found, "__hay").select(*texts.columns, F.explode("__keys").alias("key"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], label: str, values: list[str]) -> DataFrame:
    """Inner join of two prediction sets with suffixes _a and _b, and whether their labels agree."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in [label, *values]])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in [label, *values]])
    return left.join(right, keys).withColumn("labels_agree", F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b")))


def pairing_counts(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(n_a, n_b, n_paired, n_only_a, n_only_b, n_label_mismatch) in one row."""
    both = a.select(*keys, F.col(label).alias("__a"), F.lit(1).alias("__in_a")).join(b.select(*keys, F.col(label).alias("__b"), F.lit(1).alias("__in_b")), keys, "full_outer")
    in_a, in_b = F.col("__in_a").isNotNull(), F.col("__in_b").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("n_paired"),
        F.count_if(in_a & ~in_b).alias("n_only_a"), F.count_if(in_b & ~in_a).alias("n_only_b"), F.count_if(in_a & in_b & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_label_mismatch"),
    )


def bucket_activity(rows: DataFrame, events: DataFrame, membership: DataFrame) -> DataFrame:
    """``rows`` (symbol, ts, bucket) with own, bucket_other and market event counts of the day.

    Events count in every bucket that their symbol is in at that time. The own
    count is taken off the bucket's, whether or not the own events were in it.
    """
    daily = events.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("own"))
    tagged = interval_join(daily, membership).where("bucket is not null")
    by_bucket = tagged.groupBy("ts", "bucket").agg(F.sum("own").alias("__bucket"))
    market = daily.groupBy("ts").agg(F.sum("own").alias("market"))
    out = rows.join(daily, ["symbol", "ts"], "left").join(by_bucket, ["ts", "bucket"], "left").join(market, "ts", "left")
    return out.withColumns({"own": F.coalesce("own", F.lit(0)), "bucket_other": F.greatest(F.coalesce("__bucket", F.lit(0)) - F.coalesce("own", F.lit(0)), F.lit(0)), "market": F.coalesce("market", F.lit(0))}).drop("__bucket")


def top_k_difference(a: DataFrame, b: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """(name, rank_a, rank_b, side): ranks by value in both lists, and in whose top k alone a name is."""
    # Lists of names are as long as the schema is wide.
    rank = F.row_number().over(Window.orderBy(F.desc(value), name))
    ra, rb = a.select(name, rank.alias("rank_a")), b.select(name, rank.alias("rank_b"))
    side = F.when((F.col("rank_a") <= k) & ((F.col("rank_b") > k) | F.col("rank_b").isNull()), "a").when((F.col("rank_b") <= k) & ((F.col("rank_a") > k) | F.col("rank_a").isNull()), "b")
    return ra.join(rb, name, "full_outer").withColumn("side", side)


def join_without_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join in which columns that both sides have come from ``left``."""
    overlap = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*overlap), keys, "left")


def aligned(families: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Feature families side by side on ``keys``, their columns prefixed by the family's name; a row that one lacks is null there."""
    out = None
    for name, df in families.items():
        named = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = named if out is None else out.join(named, keys, "full_outer")
    return out


def with_labels(features: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``features`` with the label of their row; rows without one are dropped."""
    return features.join(labels.select(*keys, label), keys, "left").where(F.col(label).isNotNull())


def validated_join(facts: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a key occurs twice in ``lookup``."""
    if lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"keys {keys} are not unique in the lookup")
    return facts.join(lookup, keys, "left")


def outer_aligned(a: DataFrame, b: DataFrame, day: str, value: str) -> DataFrame:
    """(day, a, b): two daily series on the union of their days, 0 where one has none."""
    return a.select(day, F.col(value).alias("a")).join(b.select(day, F.col(value).alias("b")), day, "full_outer").fillna(0.0, ["a", "b"])


def lookup_coverage(facts: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n_rows, n_found, coverage): how many rows find a value."""
    return facts.select(*keys).join(lookup.select(*keys, value), keys, "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_found"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], decision: str) -> DataFrame:
    """One row on how two scorings of the same keys differ: counts, largest and mean difference, share of equal decisions; each key once a side."""
    from tidemark.operators.ingest import keep_first

    pick = lambda df, s: keep_first(df.select(*keys, *columns, decision), keys, [decision, *columns]).select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in [*columns, decision]])
    both = pick(a, "a").join(pick(b, "b"), keys)
    worst = F.greatest(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in columns]) if len(columns) > 1 else F.abs(F.col(f"{columns[0]}_a") - F.col(f"{columns[0]}_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.max(worst).alias("max_abs_diff"), F.avg(worst).alias("mean_abs_diff"), F.count_if(worst > 1e-6).alias("n_different"), F.avg((F.col(f"{decision}_a") == F.col(f"{decision}_b")).cast("double")).alias("agreement")
    )
