"""Hand-computed cases of path-dependent and recursive operators, and of text functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import decisions as D
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import quality as G
from tidemark.operators import windows as W
from tidemark.operators.joins import decision_day, validated_join

BARS = "symbol string, ts date, open double, high double, low double, close double, volume double"


def bars(spark, closes, spread=0.5):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([("A", day + dt.timedelta(days=k), c, c + spread, c - spread, c, 10.0) for k, c in enumerate(closes)], BARS)


def test_recursive_mean_by_hand(spark):
    df = spark.createDataFrame([("A", k, x) for k, x in enumerate([None, 10.0, 20.0, None, 40.0])], "symbol string, ts int, x double")
    got = [r["y"] for r in W.ewm_means(df, {"y": ("x", 0.5)}).orderBy("ts").collect()]
    a = 15.0
    b = (0.25 * a + 0.5 * 40.0) / 0.75
    assert got[0] is None and got[1:] == pytest.approx([10.0, a, a, b])


def test_rsi_atr_by_hand(spark):
    closes = [10.0, 11.0, 10.5, 11.5]
    rows = X.recursive_features(bars(spark, closes)).orderBy("ts").collect()
    gain, loss = 1.0, 0.0
    for d in (-0.5, 1.0):
        gain, loss = gain + (max(d, 0) - gain) / 14, loss + (max(-d, 0) - loss) / 14
    assert rows[1]["rsi_14"] is None and rows[3]["rsi_14"] == pytest.approx(100 - 100 / (1 + gain / loss))
    atr = 1.0
    for t in (1.5, 1.0, 1.5):
        atr += (t - atr) / 14
    assert rows[3]["atr_14"] == pytest.approx(atr)


def test_fractional_weights():
    w = W.fractional_weights(0.5, most=4)
    assert w == pytest.approx([1.0, -0.5, -0.125, -0.0625])
    assert abs(W.fractional_weights(0.9, 1e-2)[-1]) < 1e-2 <= abs(W.fractional_weights(0.9, 1e-2)[-2])


def barrier(spark, path):
    """Twenty-one quiet bars, then ``path`` of (high, low, close) at entry 100."""
    quiet = [100.0 + (1 if k % 2 else -1) for k in range(21)]
    day = dt.date(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=k), c, c + 0.1, c - 0.1, c, 1.0) for k, c in enumerate(quiet)]
    rows += [("A", day + dt.timedelta(days=21 + k), 100.0, h, lo, c, 1.0) for k, (h, lo, c) in enumerate(path)]
    df = L.triple_barrier(spark.createDataFrame(rows, BARS), horizon=3)
    return df.where(F.col("ts") == day + dt.timedelta(days=20)).collect()


def test_barriers(spark):
    flat = (100.5, 99.5, 100.0)
    assert barrier(spark, [flat, (103.0, 99.9, 102.0), flat])[0]["label_raw"] == 1
    assert barrier(spark, [flat, (100.1, 97.0, 98.0), (110.0, 99.0, 109.0)])[0]["label_raw"] == -1
    both = barrier(spark, [(105.0, 95.0, 101.5), flat, flat])[0]
    assert both["label_raw"] == 0 and both["exit_price"] == 101.5 and both["event_start"] == both["event_end"]
    late = barrier(spark, [flat, flat, (101.0, 99.5, 100.9)])[0]
    assert late["label_raw"] == 0 and late["exit_price"] == 100.9
    assert barrier(spark, [flat, flat]) == []


def test_acceptance(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("A", 1, d(0), d(3), True), ("A", 2, d(0), d(1), True), ("A", 3, d(3), d(4), True), ("A", 4, d(4), d(5), False), ("A", 5, d(4), d(6), True), ("A", 6, None, d(9), True), ("B", 7, d(2), d(2), True), ("B", 8, d(9), None, True)]
    df = spark.createDataFrame(rows, "symbol string, id long, event_start date, event_end date, wants boolean")
    got = {r["id"]: r["accepted"] for r in D.accept_without_overlap(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False}


def test_cut_off(spark):
    at = lambda s: spark.sql(f"select timestamp'{s}' t").select(decision_day(F.col("t")).alias("d")).first()["d"]
    assert at("2024-03-04 10:00:00") == dt.date(2024, 3, 4)
    assert at("2024-03-04 10:00:00.000001") == dt.date(2024, 3, 5)


def test_rates_of_few_classes(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 2)], "actual int, predicted int").withColumns({"p_down": F.lit(0.2), "p_flat": F.lit(0.2), "p_up": F.lit(0.6)})
    r = G.directional(rows).first()
    assert r["n_nonflat"] == 3 and r["accuracy_nonflat"] == 1.0
    only = rows.where("actual = 2")
    assert {x["class"]: x["auc"] for x in G.auc_by_class(only, {2: "p_up"}).collect()} == {2: None}
    assert G.scores(only.limit(0)).first()["accuracy"] is None
    assert G.binomial_two_sided(0, 0) == 1.0 and G.binomial_two_sided(0, 5) == pytest.approx(2 / 32)


def test_stability_of_equal_sets(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("c"))
    got = {r["feature"]: r["psi"] for r in G.stability_index(df, df, ["x", "c"]).collect()}
    assert got["x"] == pytest.approx(0.0, abs=1e-12) and got["c"] is None


def test_leaks_and_answers(spark):
    text = "It rose 5 percent on 2024-05-01 and 2024-02-31. The label was UP. I have seen future notes."
    row = spark.createDataFrame([(text,), (None,)], "t string").select(*[c.alias(n) for n, c in T.leak_counts(F.col("t"), F.lit("2024-06-01").cast("date")).items()]).collect()
    assert row[0].asDict() == {"post_decision_date": 1, "outcome_mentions": 1, "future_prices_returns": 1, "self_incrimination": 1}
    assert set(row[1].asDict().values()) == {0}
    think = "x" * 60
    reason = lambda c, t=think: spark.createDataFrame([(c, t)], "c string, t string").select(T.rated_answer(F.col("c"), F.col("t")).alias("r")).first()["r"]["reason"]
    ok = '{"sentiment": 0.5, "vote": "UP", "confidence": 0.6, "trace_steps": [1, 2, 3, 4]}'
    assert reason(ok) == "" and reason(ok, "short") == "empty-thinking" and reason(None) == "no-json-vote" and reason(ok.replace("0.5", "-0.5")) == "sign-mismatch"
    assert reason(ok.replace('"UP"', '"MAYBE"')) == "bad-vote:MAYBE" and reason(ok.replace("0.6", "1.6")) == "out-of-range" and reason(ok.replace("0.6", '"x"')) == "bad-numbers"
    assert reason(ok.replace("[1, 2, 3, 4]", "[1, 2]")) == "bad-trace-steps" and reason('{"vote": "UP", }x') == "json-parse"


def test_business_days(spark):
    pairs = [("2024-01-05", "2024-01-08", 1), ("2024-01-06", "2024-01-07", 0), ("2024-01-01", "2024-01-31", 22), ("2024-01-31", "2024-01-01", 0)]
    for a, b, n in pairs:
        assert spark.range(1).select(T.business_days(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("n")).first()["n"] == n


def test_lookup_must_be_unique(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        validated_join(a, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"])


def test_drift_columns(spark):
    df = spark.createDataFrame([], "symbol string, close double, ret_1 double, macro_index double, macro_index_z60 double, calendar_month int, fiscal_year int, days_to_month_end int")
    assert X.drift_columns(df) == ["ret_1", "macro_index_z60"]


def test_variants_and_differences(spark, small):
    from tidemark.sources.views import predictions

    p = predictions(spark, small)
    rows = {r["variant"]: r for r in D.variants(p, {"base": {}, "one": {"per_day": 1}}).collect()}
    base = D.curve_figures(D.equity_curve(D.daily_net(D.backtest(p)))).first()
    assert rows["base"]["sharpe"] == pytest.approx(base["sharpe"]) and rows["one"]["n_accepted"] <= rows["base"]["n_accepted"]
    same = p.select("id", "actual", F.col("p_up").alias("x"), F.col("p_up").alias("y"))
    r = G.auc_difference(same, "x", "y", F.col("actual") == 2, reps=5).first()
    auc = {a["class"]: a["auc"] for a in G.auc_by_class(p, {2: "p_up"}).collect()}[2]
    assert r["difference"] == 0 and r["se"] == 0 and r["auc_a"] == pytest.approx(auc)


def test_auc_difference_takes_a_thousand_draws_of_all_rows(spark):
    """Against areas by counting pairs, with ties that go over ranges and batches."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 400
    y, x, z = rng.integers(0, 2, n), rng.integers(0, 6, n) / 5, rng.random(n)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i]), float(z[i])) for i in range(n)], "id long, actual int, x double, z double")
    keys = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.col("id").cast("string"), F.lit(7)).alias("h")).collect()}
    w = G.poisson_draws(np.array([keys[i] for i in range(n)], dtype=np.int64), 1000)
    assert w[:, 1:].mean() == pytest.approx(1, abs=0.01) and w[:, 1:].var() == pytest.approx(1, abs=0.02)

    def areas(s):
        won = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
        p, q = w[y == 1], w[y == 0]
        return np.einsum("ir,ij,jr->r", p, won, q, optimize=True) / (p.sum(0) * q.sum(0))

    a, b = areas(x), areas(z)
    r = G.auc_difference(df.repartition(7), "x", "z", F.col("actual") == 1).first()
    assert (r["auc_a"], r["auc_b"]) == (pytest.approx(a[0]), pytest.approx(b[0]))
    assert r["se"] == pytest.approx(np.std((b - a)[1:], ddof=1))


def test_bootstrap_query_takes_the_default_draws(spark, small, monkeypatch):
    import inspect

    from tidemark.plans import model_queries as Q

    asked, full = [], G.clustered_bootstrap
    monkeypatch.setattr(Q.G, "clustered_bootstrap", lambda *a, **k: asked.append(inspect.signature(full).bind(*a, **k)))
    Q.clustered_bootstrap(spark, small)
    asked[0].apply_defaults()
    assert asked[0].arguments["reps"] == 1000


def test_overfitting_takes_sixteen_blocks_and_five_hundred_splits(spark):
    import random

    from tidemark.operators.studies import overfitting

    rng = random.Random(5)
    days = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), 1 + rng.gauss(0, 1)) for i in range(400)], "day int, a double, b double, c double, good double")
    r = overfitting(days, ["a", "b", "c"]).first()
    assert r["n_splits"] == 500 and 0 < r["pbo"] < 1 and (r["pbo"] * 500) % 1 == pytest.approx(0)
    assert overfitting(days, ["a", "good"]).first()["pbo"] == 0
    assert overfitting(days.where("day < 79"), ["a", "b"]).first()["pbo"] is None
