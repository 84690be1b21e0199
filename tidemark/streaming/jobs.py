"""Streams: the operators whose batch forms take events one after another.

Each function takes a streaming DataFrame and returns one, or a writer's
batch function; the same rows give the same result as the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.joins import decision_day, next_session_map
from tidemark.plans.skew import fits


def decided(events: DataFrame, sessions: DataFrame, published: str = "published_utc") -> DataFrame:
    """Events with their decision date. Events after the calendar are dropped, so they never change history."""
    lookup = next_session_map(sessions).select(F.col("day").alias("__day"), F.col("session").alias("decision_date"))
    first = sessions.agg(F.min("session")).first()[0]
    keyed = events.withColumn("__day", F.greatest(decision_day(F.col(published)), F.lit(first)))
    return keyed.join(F.broadcast(lookup) if fits(lookup) else lookup, "__day").drop("__day")


def unique_articles(articles: DataFrame, ts: str, key: str = "article_id", late: str = "1 day") -> DataFrame:
    """Each article once, for copies at most ``late`` apart: fetch windows overlap by a day."""
    return articles.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def window_figures(samples: DataFrame, ts: str, value: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, mean, peak) by tumbling window."""
    g = samples.withWatermark(ts, late).groupBy(F.window(ts, width), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")).select(F.col("window.start").alias("start"), by, "n", "mean", "peak")


def sliding_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, by, n) by sliding window."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), by)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions_of(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, by, n) of runs of events at most ``gap`` apart."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def upsert_batches(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends one file set for each batch, collapsed by key.

    A batch that is delivered again replaces its own file set, so a restart from
    the checkpoint changes nothing; read with ``read_upserts``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from tidemark.operators.ingest import keep_last

        keep_last(batch, [key], [order]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_upserts(spark, path: str, key: str, order: str) -> DataFrame:
    """The last row of each key over all batches."""
    from tidemark.operators.ingest import keep_last

    return keep_last(spark.read.parquet(path).drop("epoch"), [key], [order])


def accepted_stream(trades: DataFrame) -> DataFrame:
    """(symbol, id, accepted) of wishes (symbol, id, start, end timestamps): those that start after the last accepted one ended.

    The end of the last accepted trade is the state of a symbol. Wishes of a
    symbol are taken in order of start within a batch. A verdict is final once
    it is given, so the result is that of the batch form where batches come in
    order of start; a wish from before what was accepted already is refused.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["start", "id"])
        flags = []
        for s, e in zip(rows["start"], rows["end"]):
            take = until is None or s.value > until
            if take:
                until = e.value
            flags.append(take)
        if until is not None:
            state.update((until,))
        yield pd.DataFrame({"symbol": key[0], "id": rows["id"].to_numpy(), "accepted": flags})

    return trades.groupBy("symbol").applyInPandasWithState(run, "symbol string, id long, accepted boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def session_sums(sessions: DataFrame, widths: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """(symbol, session, n_5, n_20, n_60): counts over a symbol's last sessions, by rows and not by time, of (symbol, session, n) one row a session.

    The state of a symbol is its last counts, as many as the widest window; a
    session that is not after the last one taken was delivered before and is
    left out.
    """
    most = max(widths)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        rows = pd.concat(list(batches)).sort_values("session").drop_duplicates("session")
        out = []
        for session, n in zip(rows["session"], rows["n"]):
            day = pd.Timestamp(session).value
            if last is not None and day <= last:
                continue
            last, kept = day, [*kept, int(n)][-most:]
            out.append((key[0], session, *[sum(kept[-w:]) for w in widths]))
        state.update((last, kept))
        yield pd.DataFrame(out, columns=["symbol", "session", *[f"n_{w}" for w in widths]])

    schema = "symbol string, session date, " + ", ".join(f"n_{w} long" for w in widths)
    return sessions.groupBy("symbol").applyInPandasWithState(run, schema, "last long, kept array<long>", "append", GroupStateTimeout.NoTimeout)


def ewm_stream(values: DataFrame, alpha: float) -> DataFrame:
    """(symbol, ts, mean): the recursive mean of (symbol, ts, value) in order of time, as ``windows.ewm_means`` has it; its state is two numbers and the last time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mean, old = state.get if state.exists else (None, None, 1.0)
        rows = pd.concat(list(batches)).sort_values("ts").drop_duplicates("ts")
        out = []
        for ts, v in zip(rows["ts"], rows["value"]):
            at = pd.Timestamp(ts).value
            if last is not None and at <= last:
                continue
            last = at
            # The weight of the mean decays with every row, also one without a value.
            if mean is None:
                mean, old = (None if pd.isna(v) else float(v)), 1.0
            else:
                old *= 1 - alpha
                if not pd.isna(v):
                    mean, old = (old * mean + alpha * v) / (old + alpha), 1.0
            out.append((key[0], ts, mean))
        state.update((last, mean, old))
        yield pd.DataFrame(out, columns=["symbol", "ts", "mean"])

    return values.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, mean double", "last long, mean double, old double", "append", GroupStateTimeout.NoTimeout)
