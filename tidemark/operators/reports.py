"""Reports over other figures: freshness, axes from daily sums with resampled differences, subset reports, verdicts, digests and hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.functions.text import LEAK_PATTERNS, business_days
from tidemark.operators.quality import CLASSES, auc_by, poisson_draws
from tidemark.operators.studies import with_era

#: Days after which a step that goes by age is stale.
STALE_DAYS = 45


def step_status(steps: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """``steps`` (step, as_of, expected, updated_at, state, age_based) with lag_sessions and status.

    A step without a state and a date is ``missing``. One that goes by age is
    ``fresh`` for ``stale_days`` after its last update. One without a date is
    ``fresh`` if its state is complete, else ``partial``. Any other is ``stale``
    once a weekday lies after its date up to the expected one.
    """
    lag = F.when(F.col("expected").isNotNull() & F.col("as_of").isNotNull() & ~F.col("age_based"), F.greatest(business_days(F.col("as_of"), F.col("expected")), F.lit(0))).otherwise(0)
    age = F.floor((F.unix_micros(now) - F.unix_micros("updated_at")) / 86_400_000_000)
    status = (
        F.when(F.col("state").isNull() & F.col("as_of").isNull(), "missing")
        .when(F.col("age_based"), F.when(age <= stale_days, "fresh").otherwise("stale"))
        .when(F.col("as_of").isNull(), F.when(F.col("state") == "complete", "fresh").otherwise("partial"))
        .otherwise(F.when(lag > 0, "stale").otherwise("fresh"))
    )
    return steps.withColumns({"lag_sessions": lag.cast("int"), "status": status})


def health_summary(statuses: DataFrame, backfillable: Column) -> DataFrame:
    """(n_steps, stale, missing, actionable): names of the steps in each state, in order; actionable are stale or missing ones that can be filled."""
    named = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("step")))), ",")
    behind = F.col("status").isin("stale", "missing")
    return statuses.agg(F.count(F.lit(1)).alias("n_steps"), named(F.col("status") == "stale").alias("stale"), named(F.col("status") == "missing").alias("missing"), named(behind & backfillable).alias("actionable"))


#: Figures that the daily sums give, and whether more is better.
AXES = {"accuracy_all": True, "accuracy_called": True, "coverage": True, "balanced_accuracy": True, "mcc": True, "log_loss": False, "ece": False, "recall_0": True, "recall_1": True, "recall_2": True}
_STATS = ["n", "hits", "calls", "log_loss", *[f"c{i}{j}" for i in CLASSES for j in CLASSES], *[f"{x}{k}" for x in "nhs" for k in range(10)]]


def axes(s: dict[str, Column]) -> dict[str, Column]:
    """``AXES`` from sums of daily statistics; 0 where undefined."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = lambda cells: sum(cells[1:], cells[0])
    truth = [total([s[f"c{i}{j}"] for j in CLASSES]) for i in CLASSES]
    called = [total([s[f"c{i}{j}"] for i in CLASSES]) for j in CLASSES]
    recalls = [zero(s[f"c{k}{k}"], truth[k]) for k in CLASSES]
    n = s["n"].cast("double")
    right = total([s[f"c{k}{k}"] for k in CLASSES]).cast("double")
    cross = total([truth[k].cast("double") * called[k] for k in CLASSES])
    square = lambda x: total([v.cast("double") * v for v in x])
    gaps = [s[f"n{k}"] * F.abs(zero(s[f"h{k}"], s[f"n{k}"]) - zero(s[f"s{k}"], s[f"n{k}"])) for k in range(10)]
    return {
        "accuracy_all": zero(s["hits"], n), "accuracy_called": zero(s["c00"] + s["c22"], s["calls"]), "coverage": zero(s["calls"], n),
        "balanced_accuracy": zero(total(recalls), total([(t > 0).cast("int") for t in truth])), "mcc": zero(right * n - cross, F.sqrt((n * n - square(called)) * (n * n - square(truth)))),
        "log_loss": zero(s["log_loss"], n), "ece": zero(total(gaps), n), **{f"recall_{k}": recalls[k] for k in CLASSES},
    }


def axis_points(daily: DataFrame) -> DataFrame:
    """One row with ``AXES`` over all dates, from their sums alone."""
    sums = daily.agg(*[F.sum(c).alias(c) for c in _STATS])
    return sums.select(*[c.alias(name) for name, c in axes({c: F.col(c) for c in _STATS}).items()])


def _weighted_sums(reps: int, width: int):
    """Sums of a task's rows (h, x array) under the draws of each replicate: (rep, x); replicate 0 weighs all the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps + 1, width))
        for pdf in batches:
            if len(pdf):
                total += poisson_draws(pdf["h"].to_numpy(dtype=np.int64), reps).T @ np.stack(pdf["x"].to_list())
        yield pd.DataFrame({"rep": np.arange(reps + 1), "x": list(total)})

    return run


def axis_deltas(daily_a: DataFrame, daily_b: DataFrame, day: str = "ts", reps: int = 1000, seed: int = 42) -> DataFrame:
    """(axis, a, b, delta, low, high, significant, better): each axis of two models on their common dates, with a 95 % interval of the difference.

    Dates are drawn with replacement, by Poisson weights, the same for all axes
    and both models. A task adds its dates up for all replicates at once, so
    what is shuffled is a row a replicate and task. ``better`` is a or b where
    the interval leaves out 0.
    """
    of = lambda df, s: df.select(day, *[F.col(c).cast("double").alias(f"{s}_{c}") for c in _STATS])
    both = of(daily_a, "a").join(of(daily_b, "b"), day)
    names = [f"{s}_{c}" for s in "ab" for c in _STATS]
    rows = both.select(F.xxhash64(F.col(day).cast("string"), F.lit(seed)).alias("h"), F.array(*names).alias("x"))
    parts = rows.mapInPandas(_weighted_sums(reps, len(names)), "rep int, x array<double>")
    sums = parts.groupBy("rep").agg(*[F.sum(F.get("x", F.lit(k))).alias(c) for k, c in enumerate(names)])
    a, b = (axes({c: F.col(f"{s}_{c}") for c in _STATS}) for s in "ab")
    long = sums.select("rep", F.explode(F.array(*[F.struct(F.lit(x).alias("axis"), a[x].alias("a"), b[x].alias("b"), F.lit(up).alias("up")) for x, up in AXES.items()])).alias("v")).select("rep", "v.*")
    drawn, point = F.when(F.col("rep") > 0, F.col("b") - F.col("a")), lambda c: F.max(F.when(F.col("rep") == 0, F.col(c)))
    g = long.groupBy("axis", "up").agg(point("a").alias("a"), point("b").alias("b"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))
    significant = (F.col("low") > 0) | (F.col("high") < 0)
    better = F.when(significant, F.when((F.col("b") > F.col("a")) == F.col("up"), "b").otherwise("a"))
    return g.select("axis", "a", "b", (F.col("b") - F.col("a")).alias("delta"), "low", "high", significant.alias("significant"), better.alias("better"))


def axis_verdict(deltas: DataFrame) -> DataFrame:
    """(verdict): one line that says which side wins on which axes, and which are no different."""
    named = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("axis")))), ", ")
    g = deltas.agg(named(F.col("better") == "a").alias("a"), named(F.col("better") == "b").alias("b"), named(F.col("better").isNull()).alias("none"))
    return g.select(F.format_string("a: %s; b: %s; no difference: %s", *[F.when(F.col(c) == "", "-").otherwise(F.col(c)) for c in ("a", "b", "none")]).alias("verdict"))


def selection_score(scores: DataFrame) -> DataFrame:
    """``scores`` with selection: half the balanced accuracy and half the correlation brought to 0..1."""
    return scores.withColumn("selection", 0.5 * F.col("balanced_accuracy") + 0.25 * (F.col("mcc") + 1))


def memory_flags(by_split: DataFrame, most_gap_pp: float = 20.0, most_test: float = 0.65) -> DataFrame:
    """(train_accuracy, test_accuracy, gap_pp, memorised, too_good): whether a model remembers rather than learns."""
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("accuracy")))
    g = by_split.agg(of("train").alias("train_accuracy"), of("test").alias("test_accuracy"))
    gap = (F.col("train_accuracy") - F.col("test_accuracy")) * 100
    return g.select("train_accuracy", "test_accuracy", gap.alias("gap_pp"), (gap > most_gap_pp).alias("memorised"), (F.col("test_accuracy") > most_test).alias("too_good"))


def importance_drift(importance: DataFrame, stability: DataFrame, threshold: float = 0.2, top: int = 15) -> DataFrame:
    """(feature, mean_abs, rank, psi, drift, in_top): a list of importance with the stability of each feature where it is known."""
    joined = importance.select("feature", "mean_abs", "rank").join(stability.select("feature", "psi"), "feature", "left")
    return joined.withColumns({"drift": F.coalesce(F.col("psi") >= threshold, F.lit(False)), "in_top": F.col("rank") <= top})


def drift_alerts(rows: DataFrame, stability: DataFrame, columns: list[str], watched: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """(feature, psi, missing_rate, alert) of ``columns``: alerts are stability indexes at or above the threshold, of watched features where a list is given."""
    # One row with a rate for each column, unpivoted.
    rates = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_rate")) for c in columns])).alias("v")).select("v.*")
    out = rates.join(stability.select("feature", "psi"), "feature", "left")
    seen = F.lit(True)
    if watched is not None:
        out = out.join(watched.select("feature").distinct().withColumn("__w", F.lit(True)), "feature", "left")
        seen = F.coalesce("__w", F.lit(False))
    return out.select("feature", "psi", "missing_rate", (F.coalesce(F.col("psi") >= threshold, F.lit(False)) & seen).alias("alert"))


def subset_report(rows: DataFrame, subset: Column, label: int = 2, score: str = "p_up", least: int = 200, least_side: int = 50) -> DataFrame:
    """(subset, n, n_label, miss_rate, auc, n_eras, reliable, cross_era) of each value of ``subset``.

    The area needs ``least`` rows of the class and ``least_side`` on either side.
    Eras count with a quarter of ``least`` rows of the class; a subset holds
    across eras if three or more differ by less than 0.25 in their miss rates.
    """
    base = with_era(rows).select(subset.alias("subset"), "era", (F.col("actual") == label).alias("pos"), (F.col("predicted") != label).alias("miss"), F.col(score).alias("score")).where("subset is not null")
    g = base.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count_if("pos").alias("n_label"), F.avg(F.when(F.col("pos"), F.col("miss").cast("double"))).alias("miss_rate"))
    areas = auc_by(base.select("subset", "score", "pos"), "subset")
    eras = base.where("pos").groupBy("subset", "era").agg(F.count(F.lit(1)).alias("m"), F.avg(F.col("miss").cast("double")).alias("r")).where(F.col("m") >= least // 4)
    spread = eras.groupBy("subset").agg(F.count(F.lit(1)).alias("n_eras"), (F.max("r") - F.min("r")).alias("spread"))
    out = g.join(areas.select("subset", "auc"), "subset", "left").join(spread, "subset", "left")
    enough = (F.col("n_label") >= least) & (F.col("n_label") >= least_side) & (F.col("n") - F.col("n_label") >= least_side)
    return out.select(
        "subset", "n", "n_label", "miss_rate", F.when(enough, F.col("auc")).alias("auc"), F.coalesce("n_eras", F.lit(0)).alias("n_eras"), (F.col("n") >= least).alias("reliable"),
        F.coalesce((F.col("n_eras") >= 3) & (F.col("spread") < 0.25), F.lit(False)).alias("cross_era"),
    )


def verdicts(evidence: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(id, verdict) of causes over one row of figures: ``supported`` where the condition holds, else ``rejected``; a missing figure rejects."""
    each = F.array(*[F.struct(F.lit(name).alias("id"), F.when(F.coalesce(F.expr(cond), F.lit(False)), "supported").otherwise("rejected").alias("verdict")) for name, cond in rules.items()])
    return evidence.select(F.explode(each).alias("v")).select("v.*")


def scored_panel(rows: DataFrame, splits: DataFrame, key: str = "id") -> DataFrame:
    """(key, split, max_p, margin): every row with its split, its largest probability and the lead over the next."""
    ordered = F.sort_array(F.array("p_down", "p_flat", "p_up"), asc=False)
    return rows.select(key, ordered[0].alias("max_p"), (ordered[0] - ordered[1]).alias("margin")).join(splits.select(key, "split"), key)


def trace_digest(traces: DataFrame, key: str, thinking: str = "thinking", content: str = "content") -> DataFrame:
    """(key, thinking_chars, content_chars, trace_len): lengths of the texts of each trace; null texts have none."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return traces.select(key, n(thinking).alias("thinking_chars"), n(content).alias("content_chars"), (n(thinking) + n(content)).alias("trace_len"))


def leak_hits(texts: DataFrame, key: str, text: str, decision_date: str, reach: int = 40) -> DataFrame:
    """(key, kind, hit, at, snippet): every sign of later knowledge in ``text``, where it begins, and what is around it; see ``leak_counts``.

    One text gives any number of rows, which no built-in function does with
    places, so Python walks each text once for each pattern.
    """
    patterns = [(kind, re.compile(p, re.I)) for kind, ps in LEAK_PATTERNS.items() for p in ps]
    iso = LEAK_PATTERNS["post_decision_date"][0]

    def known(hit: str, limit) -> bool:
        day = pd.to_datetime(hit, format="%Y-%m-%d", errors="coerce")
        return limit is not None and not pd.isna(limit) and not pd.isna(day) and day.date() <= pd.Timestamp(limit).date()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, limit in zip(pdf["k"], pdf["t"], pdf["d"]):
                for kind, p in patterns:
                    for m in p.finditer(t or ""):
                        if p.pattern == iso and known(m.group(0), limit):
                            continue
                        out.append((k, kind, m.group(0), m.start(), t[max(0, m.start() - reach) : m.end() + reach]))
            yield pd.DataFrame(out, columns=["k", "kind", "hit", "at", "snippet"])

    kind = dict(texts.dtypes)[key]
    narrow = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(decision_date).alias("d"))
    return narrow.mapInPandas(run, f"k {kind}, kind string, hit string, at int, snippet string").withColumnRenamed("k", key)


def envelope(rows: DataFrame, as_of: Column, order: list[str]) -> DataFrame:
    """(as_of, n, rows): a small report as one row, its rows as JSON text in order; dates are ISO text, and NaN and infinities are null."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    newest = whole(rows, at=F.max(as_of))
    texts = rows.select(F.struct(*order).alias("o"), F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("j"))
    # A report is what a page shows: few rows.
    return texts.agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]).alias("rows")).select(newest["at"].cast("string").alias("as_of"), "n", "rows")


def first_bucket(cases: DataFrame, tagged: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``cases`` with ``values`` of the first row of ``tagged`` (key, start, values) for each key, by start and then by value; null without one."""
    w = Window.partitionBy(key).orderBy("start", *values)
    first = tagged.where(F.col(values[0]).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, *values)
    return cases.join(first, key, "left")
