"""Reports: statuses, resampled axes, hits with their places, lookups beyond the list of aliases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import quality as G
from tidemark.operators import reports as R
from tidemark.sources.views import predictions


def test_statuses(spark):
    d, t = dt.date, lambda day: dt.datetime(2024, 1, day)
    rows = [("none", None, d(2024, 1, 10), None, None, False), ("fresh", d(2024, 1, 10), d(2024, 1, 10), t(9), "x", False), ("late", d(2024, 1, 4), d(2024, 1, 10), t(4), "x", False), ("weekend", d(2024, 1, 5), d(2024, 1, 7), t(5), "x", False)]
    rows += [("young", None, None, t(9), "complete", True), ("done", None, None, t(9), "complete", False), ("half", None, None, t(9), "running", False)]
    df = spark.createDataFrame(rows, "step string, as_of date, expected date, updated_at timestamp, state string, age_based boolean")
    got = {r["step"]: (r["status"], r["lag_sessions"]) for r in R.step_status(df, F.lit(dt.datetime(2024, 1, 11))).collect()}
    assert got == {"none": ("missing", 0), "fresh": ("fresh", 0), "late": ("stale", 4), "weekend": ("fresh", 0), "young": ("fresh", 0), "done": ("fresh", 0), "half": ("partial", 0)}
    old = R.step_status(df.where("step = 'young'"), F.lit(dt.datetime(2024, 6, 1))).first()
    assert old["status"] == "stale"
    summary = R.health_summary(R.step_status(df, F.lit(dt.datetime(2024, 1, 11))), F.col("step") != "none").first()
    assert (summary["n_steps"], summary["stale"], summary["missing"], summary["actionable"]) == (7, "late", "none", "late")
    assert R.step_status(df.limit(0), F.lit(None).cast("timestamp")).count() == 0


def test_axis_deltas(spark, small):
    a, b = G.daily_statistics(predictions(spark, small)), G.daily_statistics(predictions(spark, small, 1))
    points = [R.axis_points(x).first() for x in (a, b)]
    rows = {r["axis"]: r for r in R.axis_deltas(a, b).collect()}
    assert set(rows) == set(R.AXES)
    for axis, r in rows.items():
        assert r["a"] == pytest.approx(points[0][axis]) and r["b"] == pytest.approx(points[1][axis]) and r["low"] <= r["high"]
        assert (r["better"] is not None) == r["significant"] == (r["low"] > 0 or r["high"] < 0)
    same = R.axis_deltas(a, a, reps=20).collect()
    assert all(r["delta"] == r["low"] == r["high"] == 0 and r["better"] is None for r in same)
    assert R.axis_verdict(spark.createDataFrame([("x", "a"), ("y", None)], "axis string, better string")).first()["verdict"] == "a: x; b: -; no difference: y"
    # The interval is that of dates drawn with replacement: about the standard error by dates.
    pairs = G.paired_days(_pairs(spark, small)).toPandas()["delta"]
    width = rows["accuracy_all"]["high"] - rows["accuracy_all"]["low"]
    assert width == pytest.approx(2 * 1.96 * pairs.std() / len(pairs) ** 0.5, rel=0.4)


def _pairs(spark, small):
    return J.paired(predictions(spark, small), predictions(spark, small, 1), ["id", "ts"], "actual", ["predicted", "p_up"])


def test_hits_have_places(spark):
    df = spark.createDataFrame([(1, "On 2024-05-01 it rose 4% and on 2023-01-01 too.", dt.date(2024, 1, 1), "x"), (2, None, None, "x")], "id long, t string, d date, kind string")
    rows = R.leak_hits(df, "id", "t", "d").collect()
    assert {(r["kind"], r["hit"]) for r in rows} >= {("post_decision_date", "2024-05-01")} and all(r["hit"] != "2023-01-01" for r in rows)
    assert all(r["hit"] in r["snippet"] and "On 2024-05-01 it rose 4% and on"[r["at"] : r["at"] + len(r["hit"])] == r["hit"] for r in rows)


def test_aliases_beyond_the_list(spark):
    texts = spark.createDataFrame([(1, "Steel and tin", "k"), (2, "TIN", "k"), (3, "no", "k"), (4, None, "k"), (5, "", "k"), (2, "TIN", "k")], "id long, hay string, note string")
    aliases = spark.createDataFrame([("m", "tin"), ("m", "Steel"), ("n", "N"), ("o", "no"), ("p", " "), ("q", "steel and tin roof"), ("r", None)], "key string, alias string")
    few = sorted(map(tuple, J.substring_matches(texts, aliases, "hay", "alias").collect()))
    assert few == sorted(map(tuple, J.substring_matches(texts, aliases, "hay", "alias", max_aliases=2).collect())) and len(few) == 8


def test_envelope(spark):
    df = spark.createDataFrame([("b", float("nan"), dt.date(2024, 1, 2)), ("a", 1.5, dt.date(2024, 1, 1))], "name string, x double, day date")
    r = R.envelope(df, F.col("day"), ["name"]).first()
    assert r["as_of"] == "2024-01-02" and r["n"] == 2 and r["rows"] == ['{"name":"a","x":1.5,"day":"2024-01-01"}', '{"name":"b","x":null,"day":"2024-01-02"}']
