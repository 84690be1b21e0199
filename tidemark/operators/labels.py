"""Event labels and leakage-safe splits in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W


def triple_barrier(bars: DataFrame, horizon: int = 5, upper: float = 1.0, lower: float = 1.0, flat_band: float = 1.0, sigma_window: int = 20) -> DataFrame:
    """(symbol, ts, label_raw, label, event_start, event_end, entry_price, exit_price, realized_return) of the rows with a label.

    ``label_raw`` is -1, 0 or 1; ``label`` the class number 0, 1 or 2.

    Entry is the next open; the barriers lie ``upper`` and ``lower`` trailing
    deviations of returns from it. The first of the next ``horizon`` bars that
    touches one decides; a bar that touches both gives label 0 and exits at its
    close. Without a touch the exit is the last close, and the label its sign
    unless the return is within ``flat_band`` deviations. Rows with fewer than
    ``horizon`` bars ahead, or without a positive deviation and entry, have no
    label. The scan is a chain over ``lead``, all in one sort by symbol.
    """
    w = W.series()
    base = bars.withColumn("__ret", W.change(F.col("close")))
    base = base.withColumn("sigma", W.rolling_std(F.col("__ret"), sigma_window))
    ahead = {"entry": F.lead("open", 1).over(w)}
    for k in range(1, horizon + 1):
        ahead |= {f"__t{k}": F.lead("ts", k).over(w), f"__h{k}": F.lead("high", k).over(w), f"__l{k}": F.lead("low", k).over(w), f"__c{k}": F.lead("close", k).over(w)}
    base = base.withColumns(ahead).where((F.col("sigma") > 0) & (F.col("entry") > 0) & F.col(f"__t{horizon}").isNotNull())
    base = base.withColumns({"__up": F.col("entry") * (1 + upper * F.col("sigma")), "__dn": F.col("entry") * (1 - lower * F.col("sigma"))})
    hit = None
    for k in range(1, horizon + 1):
        up, dn = F.col(f"__h{k}") >= F.col("__up"), F.col(f"__l{k}") <= F.col("__dn")
        make = lambda label, price: F.struct(F.lit(label).alias("label"), F.col(f"__t{k}").alias("ts"), price.alias("price"))  # noqa: B023, E731
        step = [(up & dn, make(0, F.col(f"__c{k}"))), (up, make(1, F.col("__up"))), (dn, make(-1, F.col("__dn")))]
        for cond, value in step:
            hit = F.when(cond, value) if hit is None else hit.when(cond, value)
    last = F.col(f"__c{horizon}")
    ret = last / F.col("entry") - 1
    flat = F.when(F.abs(ret) <= F.col("sigma") * flat_band, 0).when(ret > 0, 1).otherwise(-1)
    hit = hit.otherwise(F.struct(flat.alias("label"), F.col(f"__t{horizon}").alias("ts"), last.alias("price")))
    out = base.withColumn("__hit", hit)
    return out.select(
        "symbol", "ts", F.col("__hit.label").alias("label_raw"), (F.col("__hit.label") + 1).alias("label"), F.col("__t1").alias("event_start"), F.col("__hit.ts").alias("event_end"), F.col("entry").alias("entry_price"),
        F.col("__hit.price").alias("exit_price"), (F.col("__hit.price") / F.col("entry") - 1).alias("realized_return"),
    )


def _entries(bars: DataFrame, multipliers: list[float], most: int, sigma_window: int) -> DataFrame:
    """(symbol, ts, entry, sigma, ahead, multiplier, touch): the next ``most`` bars of each row with an entry, and the first of them to touch a barrier, counted from 1; null if none does. One sort by symbol for all of it."""
    w = W.series()
    base = bars.withColumn("__ret", W.change(F.col("close")))
    ahead = F.collect_list(F.struct("ts", "high", "low", "close")).over(w.rowsBetween(1, most))
    base = base.select("symbol", "ts", W.rolling_std(F.col("__ret"), sigma_window).alias("sigma"), F.lead("open", 1).over(w).alias("entry"), ahead.alias("ahead")).where("sigma > 0 and entry > 0")
    each = base.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    up, down = F.col("entry") * (1 + F.col("multiplier") * F.col("sigma")), F.col("entry") * (1 - F.col("multiplier") * F.col("sigma"))
    touch = F.array_position(F.transform("ahead", lambda b: (b["high"] >= up) | (b["low"] <= down)), True)
    return each.withColumns({"up": up, "down": down, "touch": F.when(touch > 0, touch.cast("int"))})


def _outcome(horizon: Column, flat_band: Column) -> Column:
    """(label, price) of a row of ``_entries`` over its first ``horizon`` bars; as ``triple_barrier`` says."""
    bar = F.try_element_at("ahead", F.col("touch"))
    hit_up, hit_down = bar["high"] >= F.col("up"), bar["low"] <= F.col("down")
    touched = F.struct(F.when(hit_up & hit_down, 0).when(hit_up, 1).otherwise(-1).alias("label"), F.when(hit_up & hit_down, bar["close"]).when(hit_up, F.col("up")).otherwise(F.col("down")).alias("price"))
    last = F.try_element_at("ahead", horizon)["close"]
    ret = last / F.col("entry") - 1
    timed_out = F.struct(F.when(F.abs(ret) <= F.col("sigma") * flat_band, 0).when(ret > 0, 1).otherwise(-1).alias("label"), last.alias("price"))
    return F.when(F.col("touch") <= horizon, touched).otherwise(timed_out)


def label_grid(bars: DataFrame, horizons: list[int], multipliers: list[float], sigma_window: int = 20) -> DataFrame:
    """(horizon, multiplier, n, and share, median and deviation of returns of each class) of each cell, over all rows.

    The bars are read and sorted once for all cells: the first touch of a
    multiplier is found over the longest horizon, and shorter ones ask whether
    it lies within them.
    """
    entries = _entries(bars, multipliers, max(horizons), sigma_window)
    cells = entries.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))).where(F.size("ahead") >= F.col("horizon"))
    cells = cells.select("horizon", "multiplier", "entry", _outcome(F.col("horizon"), F.lit(1.0)).alias("o")).select("horizon", "multiplier", F.col("o.label").alias("label"), (F.col("o.price") / F.col("entry") - 1).alias("r"))
    of = lambda v, x: F.when(F.col("label") == v, x)
    names = {-1: "down", 0: "flat", 1: "up"}
    return cells.groupBy("horizon", "multiplier").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col("label") == v).cast("double")).alias(f"share_{c}") for v, c in names.items()],
        *[F.percentile(of(v, F.col("r")), F.lit(0.5)).alias(f"median_{c}") for v, c in names.items()], *[F.stddev_pop(of(v, F.col("r"))).alias(f"std_{c}") for v, c in names.items()],
    )


def flat_band_scan(bars: DataFrame, bands: list[float], low: float = 0.25, high: float = 0.40, horizon: int = 5, sigma_window: int = 20) -> DataFrame:
    """(band, n, share_flat, picked): the first band with a FLAT share within bounds is picked, else that nearest to their middle."""
    entries = _entries(bars, [1.0], horizon, sigma_window).where(F.size("ahead") >= horizon)
    rows = entries.withColumn("band", F.explode(F.array(*[F.lit(float(b)) for b in bands]))).select("band", (_outcome(F.lit(horizon), F.col("band"))["label"] == 0).cast("double").alias("flat"))
    shares = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("flat").alias("share_flat"))
    inside = F.col("share_flat").between(low, high)
    # One row a band.
    order = Window.orderBy(F.when(inside, 0).otherwise(1), F.when(inside, F.col("band")).otherwise(F.abs(F.col("share_flat") - (low + high) / 2)), "band")
    return shares.withColumn("picked", F.row_number().over(order) == 1)


def date_positions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, pos, n_dates): distinct dates with their position from 0. One row a date, so one ordered partition is enough."""
    d = df.select(ts).where(F.col(ts).isNotNull()).distinct()
    return d.select(ts, (F.row_number().over(Window.orderBy(ts)) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"))


def three_way_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, ts: str = "ts") -> DataFrame:
    """``df`` with split: train, validation or test by cuts of the distinct dates."""
    pos = date_positions(df, ts)
    split = F.when(F.col("pos") < F.floor(F.col("n_dates") * train), "train").when(F.col("pos") < F.floor(F.col("n_dates") * (train + validation)), "validation").otherwise("test")
    return df.join(pos.select(ts, split.alias("split")), ts)


def purged_folds(df: DataFrame, k: int = 4, purge_days: int = 5, ts: str = "ts", event_end: str = "event_end") -> DataFrame:
    """(fold, role, and the columns of ``df``): expanding training rows and the validation rows after them.

    The dates are cut into k + 1 parts. Training rows of a fold lie more than
    ``purge_days`` calendar days before its validation start, and their events
    end before it; a null end counts as ended. Folds without rows of either
    role are left out.
    """
    n, bounds = _fold_bounds(df, k, ts)
    if n == 0:
        return df.withColumns({"fold": F.lit(None).cast("int"), "role": F.lit(None).cast("string")}).limit(0)
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for i, (a, b) in enumerate(bounds)])
    each = df.withColumn("__f", F.explode(folds))
    start = F.col("__f.a")
    train = (F.col(ts) < F.date_sub(start, purge_days)) & (F.col(event_end).isNull() | (F.col(event_end) < start))
    valid = (F.col(ts) >= start) & (F.col("__f.b").isNull() | (F.col(ts) < F.col("__f.b")))
    return each.withColumns({"fold": F.col("__f.fold"), "role": F.when(train, "train").when(valid, "validation")}).where("role is not null").drop("__f")


def _fold_bounds(df: DataFrame, k: int, ts: str) -> tuple[int, list[tuple]]:
    """Number of dates and the (start, end) of each validation part; 2 k dates at most come to the driver."""
    pos = date_positions(df, ts)
    n = pos.count()
    if n == 0:
        return 0, []
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    at = {r["pos"]: r[ts] for r in pos.where(F.col("pos").isin([c for c in set(cuts) if c < n])).collect()}
    return n, [(at[cuts[i]], at.get(cuts[i + 1])) for i in range(1, k + 1) if cuts[i] < n and cuts[i] < cuts[i + 1]]


def premature_labels(labelled: DataFrame) -> DataFrame:
    """(n_rows, n_premature): labels whose event starts on or before their row's date."""
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("event_start") <= F.col("ts")).alias("n_premature"))


def chronological_holdout(df: DataFrame, share: float = 0.2, ts: str = "ts") -> DataFrame:
    """``df`` with held_out: rows from the cut of the distinct dates on."""
    pos = date_positions(df, ts)
    return df.join(pos.select(ts, (F.col("pos") >= F.floor(F.col("n_dates") * (1 - share))).alias("held_out")), ts)
