"""Analytics of an append-only rating ledger.

Columns: seq, case_id, symbol, pool, vote, conf, label, harness_fail, kept, no_news, secs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.operators.quality import two_sided

VOTES = ["DOWN", "FLAT", "UP"]


def judged() -> Column:
    """A vote of the set, from a message that did not fail; null flags count as not failed."""
    return F.coalesce(F.col("vote").isin(VOTES), F.lit(False)) & ~F.coalesce(F.col("harness_fail"), F.lit(False))


def funnel(ledger: DataFrame) -> DataFrame:
    """(step, stage, n, retention): attempted, rated (distinct cases), judged, kept; retention is over the stage before."""
    row = ledger.agg(F.count(F.lit(1)).alias("attempted"), F.count_distinct("case_id").alias("rated"), F.count_if(judged()).alias("judged"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"))
    stages = row.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in ("attempted", "rated", "judged", "kept")])).alias("step", "s")).select("step", "s.*")
    return stages.withColumn("retention", F.try_divide("n", F.lag("n").over(Window.orderBy("step"))))


def vote_matrix(ledger: DataFrame) -> DataFrame:
    """(label, DOWN, FLAT, UP): judged rows by label and vote, zero cells kept."""
    labels = ledger.sparkSession.createDataFrame([(v,) for v in VOTES], "label string")
    wide = ledger.where(judged()).groupBy("label").agg(*[F.count_if(F.col("vote") == v).alias(v) for v in VOTES])
    return labels.join(wide, "label", "left").fillna(0, VOTES)


def confidence_histogram(ledger: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, hit_rate) of judged rows by confidence, [lo, hi) with 1.0 in the last."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return ledger.where(judged() & F.col("conf").isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("vote") == F.col("label")).cast("double")).alias("hit_rate"), F.avg("conf").alias("mean_conf"))


def vote_calibration_error(ledger: DataFrame) -> DataFrame:
    """(n, ece) of judged votes."""
    return confidence_histogram(ledger).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("hit_rate") - F.col("mean_conf"))), F.sum("n")).alias("ece"))


def score_vote(score: Column, bound: float = 0.2) -> Column:
    """UP above the bound, DOWN below its negative, else FLAT; a missing score is FLAT."""
    return F.when(score > bound, "UP").when(score < -bound, "DOWN").otherwise("FLAT")


def disagreement(ledger: DataFrame) -> DataFrame:
    """(vote_right, score_right, n): quadrants of the vote and the score's vote against the label."""
    rows = ledger.where(judged()).select((F.col("vote") == F.col("label")).alias("vote_right"), (score_vote(F.col("score")) == F.col("label")).alias("score_right"))
    return rows.groupBy("vote_right", "score_right").agg(F.count(F.lit(1)).alias("n"))


def latency(ledger: DataFrame) -> DataFrame:
    """(outcome, n, p50, p90, mean) of seconds by outcome: failed, judged or unjudged."""
    outcome = F.when(F.coalesce("harness_fail", F.lit(False)), "failed").when(judged(), "judged").otherwise("unjudged")
    return ledger.where("secs is not null and secs >= 0 and not isnan(secs)").groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("secs", F.lit(0.5)).alias("p50"), F.percentile("secs", F.lit(0.9)).alias("p90"), F.avg("secs").alias("mean")
    )


def cohorts(ledger: DataFrame, by: str) -> DataFrame:
    """(by, n, judged, hit_rate, kept)."""
    hit = F.when(judged(), (F.col("vote") == F.col("label")).cast("double"))
    return ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(judged()).alias("judged"), F.avg(hit).alias("hit_rate"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"))


def progress(ledger: DataFrame, n: int = 50, block: int = 4096) -> DataFrame:
    """(seq, done, hits, trailing_rate): counts so far, and the hit rate of the last n judged rows.

    The order is over the whole ledger. Prefixes are taken within blocks of
    consecutive numbers and over blocks, and the trailing rate is a difference
    of prefixes n rows apart, found by an equi-join on the row number: no task
    ever holds the ledger.
    """
    rows = ledger.where(judged()).select("seq", (F.col("vote") == F.col("label")).cast("long").alias("hit"), F.floor(F.col("seq") / block).alias("block"))
    sums = rows.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("hit").alias("h"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    inside = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"i": F.count(F.lit(1)).over(inside), "h": F.sum("hit").over(inside)}).join(offsets, "block")
    out = out.select("seq", (F.col("i") + F.col("m0")).alias("done"), (F.col("h") + F.col("h0")).alias("hits"))
    past = out.select((F.col("done") + n).alias("done"), F.col("hits").alias("past"))
    joined = out.join(past, "done", "left")
    rate = (F.col("hits") - F.coalesce("past", F.lit(0))) / F.least(F.col("done"), F.lit(n))
    return joined.select("seq", "done", "hits", rate.alias("trailing_rate"))


def value_shares(ledger: DataFrame, column: str, k: int = 12) -> DataFrame:
    """(value, n, share): the k most frequent values, null as ``(missing)``; share is of all rows."""
    counts = ledger.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = whole(counts, n=F.sum("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k).select("value", "n", (F.col("n") / total["n"]).alias("share"))


def summary(ledger: DataFrame) -> DataFrame:
    """One row of means, spreads and ranges."""
    return ledger.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("n_symbols"), F.avg("conf").alias("mean_conf"), F.percentile("conf", F.lit(0.1)).alias("p10_conf"), F.percentile("conf", F.lit(0.9)).alias("p90_conf"),
        F.min("decision_date").alias("first_date"), F.max("decision_date").alias("last_date"), F.avg(F.coalesce("harness_fail", F.lit(False)).cast("double")).alias("fail_rate"),
    )


def gate(ledger: DataFrame) -> DataFrame:
    """(n, vote_rate, score_rate, delta, two_se, passed): whether votes beat score votes by more than two standard errors of proportions; fails below 30 rows."""
    rows = ledger.where(judged()).select((F.col("vote") == F.col("label")).cast("double").alias("v"), (score_vote(F.col("score")) == F.col("label")).cast("double").alias("s"))
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("vote_rate"), F.avg("s").alias("score_rate"))
    v, s, n = F.col("vote_rate"), F.col("score_rate"), F.col("n")
    a = a.withColumns({"delta": v - s, "two_se": 2 * F.sqrt(F.try_divide(v * (1 - v) + s * (1 - s), n))})
    return a.withColumn("passed", F.coalesce((F.col("n") >= 30) & (F.col("delta") > F.col("two_se")), F.lit(False)))


def case_page(ledger: DataFrame, vote: str | None, only_matches: bool | None, offset: int, limit: int) -> DataFrame:
    """A page of filtered cases, newest first, each with the number of all that match. A missing verdict is no mismatch."""
    rows = ledger
    if vote:
        rows = rows.where(F.col("vote") == vote)
    if only_matches is not None:
        rows = rows.where(F.col("vote").isNotNull() & ((F.col("vote") == F.col("label")) == only_matches))
    total = whole(rows, n=F.count(F.lit(1)))
    page = rows.orderBy(F.desc("decision_date"), F.desc("seq")).offset(offset).limit(limit).select("seq", "case_id", "decision_date", "vote", "label")
    return page.withColumn("total", total["n"])


def stratified(ledger: DataFrame, by: str, quotas: dict[str, int], key: str, seed: int = 7) -> DataFrame:
    """Up to ``quotas`` rows of each class, chosen by a hash of key and seed; ties by key."""
    draw = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw, key))
    rows = ledger.where(F.col(by).isin(list(quotas))).withColumn("__r", rank)
    # A bound known beforehand lets the optimizer prune the sort to the largest quota.
    return rows.where(F.col("__r") <= max(quotas.values())).where(F.col("__r") <= F.try_element_at(quota, F.col(by))).drop("__r")


def permutation_split(ledger: DataFrame, key: str, share: float = 0.05, seed: int = 7) -> DataFrame:
    """(key, part): the rows that come first by hash are validation, at least one."""
    draw = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
    n = ledger.count()
    chosen = ledger.select(key, draw.alias("__d")).orderBy("__d", key).limit(max(1, int(n * share))).select(key, F.lit("validation").alias("part"))
    return ledger.select(key).join(chosen, key, "left").fillna("train", ["part"])


def thinned(rows: DataFrame, order: str, stride: int, part: str) -> DataFrame:
    """Every ``stride``-th row of each part, and its last."""
    w = Window.partitionBy(part).orderBy(order)
    i = F.row_number().over(w)
    return rows.withColumns({"__i": i, "__last": F.lead(order).over(w).isNull()}).where(((F.col("__i") - 1) % stride == 0) | F.col("__last")).drop("__i", "__last")


def reasons(rows: DataFrame) -> DataFrame:
    """(seq, reasons): all reasons for which a row is dropped, joined by semicolons; empty for none."""
    tests = {"no-vote": F.col("vote").isNull(), "failed": F.coalesce("harness_fail", F.lit(False)), "no-news": F.coalesce("no_news", F.lit(False)), "mismatch": F.coalesce(F.col("vote") != F.col("label"), F.lit(False)), "unsure": F.coalesce(F.col("conf") < 0.3, F.lit(False))}
    return rows.select("seq", F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in tests.items()]).alias("reasons"))


def level_pairs(rows: DataFrame, case: str, level: str, value: str, least: int = 10) -> DataFrame:
    """(level_a, level_b, n, only_a, only_b, p_value, winner): right answers of each two levels on shared cases, where there are enough.

    Levels are the few settings of a study; a case has at most one row for each.
    ``p_value`` is the exact two-sided test of the cases that one level alone has
    right, ``winner`` the level with more of them where it is below 0.05.
    """
    a = rows.where(f"{value} is not null").groupBy(case, level).agg(F.max(value).alias("v"))
    b = a.select(case, F.col(level).alias("level_b"), F.col("v").alias("v_b"))
    both = a.select(case, F.col(level).alias("level_a"), F.col("v").alias("v_a")).join(b, case).where("level_a < level_b")
    g = both.groupBy("level_a", "level_b").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("v_a") == 1) & (F.col("v_b") == 0)).alias("only_a"), F.count_if((F.col("v_b") == 1) & (F.col("v_a") == 0)).alias("only_b")).where(F.col("n") >= least)
    p = two_sided("only_a", "only_b")
    return g.withColumn("p_value", p).withColumn("winner", F.when(F.col("p_value") < 0.05, F.when(F.col("only_a") > F.col("only_b"), F.col("level_a")).otherwise(F.col("level_b"))))


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, the first by a hash of key and seed."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), key).limit(n)


def keep_rates(ledger: DataFrame, by: str = "label") -> DataFrame:
    """(by, n, kept, rate, se): share of kept rows of each class with the standard error of a proportion."""
    g = ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"))
    rate = F.col("kept") / F.col("n")
    return g.withColumns({"rate": rate, "se": F.sqrt(rate * (1 - rate) / F.col("n"))})
