"""Small cases of the general training-data operators: nulls, ties, repeats, empty tables, clashing names, brute force."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import versions_at, with_attributes
from tidemark.operators.deliveries import DeliveryStore, _sorted_buckets, exactly_once, repeated_deliveries
from tidemark.operators.instants import InstantDictionary, duration_micros, news_instants, parse_instants
from tidemark.operators.trailing import idle_days, trailing_totals
from tidemark.plans.skew import bounded_join, hot_keys, salted_join, split_join

UTC = dt.timezone.utc


def micros(*a, tz=UTC, fold=0):
    return round(dt.datetime(*a, tzinfo=tz, fold=fold).timestamp() * 1_000_000)


INSTANTS = [
    ("2022-01-04 02:27:18 America/New_York", "UTC", "DMY", micros(2022, 1, 4, 7, 27, 18)),
    ("Wed, 05 Jan 2022 06:55:51 GMT", "America/New_York", "MDY", micros(2022, 1, 5, 6, 55, 51)),
    ("Thu, 13 Jan 2022 12:24:52 IST", "Asia/Kolkata", "DMY", micros(2022, 1, 13, 6, 54, 52)),
    ("Tue, 11 Jul 2023 04:11:27 BST", "Europe/London", "DMY", micros(2023, 7, 11, 3, 11, 27)),
    ("2022-03-18T16:31:25+05:30", "UTC", "DMY", micros(2022, 3, 18, 11, 1, 25)),
    ("2022-01-17T18:44:47+11:00[Australia/Sydney]", "UTC", "DMY", micros(2022, 1, 17, 7, 44, 47)),
    ("2022-01-25 12:37:43.150+0530", "UTC", "DMY", micros(2022, 1, 25, 7, 7, 43) + 150_000),
    ("20220423T110159", "Asia/Kolkata", "DMY", micros(2022, 4, 23, 5, 31, 59)),
    ("20220423110159", "Asia/Kolkata", "DMY", micros(2022, 4, 23, 5, 31, 59)),
    ("01-Apr-2022 16:49:46", "Asia/Kolkata", "DMY", micros(2022, 4, 1, 11, 19, 46)),
    ("10 Feb 23, 10:02", "Asia/Singapore", "DMY", micros(2023, 2, 10, 2, 2)),
    ("1/10/2024 4:58 AM", "America/New_York", "MDY", micros(2024, 1, 10, 9, 58)),
    ("1/10/2024 12:05 AM", "UTC", "MDY", micros(2024, 1, 10, 0, 5)),
    ("1/10/2024 12:05 PM", "UTC", "DMY", micros(2024, 10, 1, 12, 5)),
    ("13/02/2024 09:00", "UTC", "MDY", micros(2024, 2, 13, 9)),
    ("1643691461", "Asia/Kolkata", "DMY", 1643691461_000000),
    ("1641290968170", "UTC", "DMY", 1641290968170_000),
    ("1649139364276844", "UTC", "DMY", 1649139364276844),
    (" 2022-01-25 02:38:09z\t", "Asia/Kolkata", "DMY", micros(2022, 1, 25, 2, 38, 9)),
    ("2022-04-20T10:08Z", "UTC", "DMY", micros(2022, 4, 20, 10, 8)),
    ("Jan 5, 2024 10:02 PM", "UTC", "DMY", micros(2024, 1, 5, 22, 2)),
    ("2024-07-05 10:00 IST", "Europe/Dublin", "DMY", micros(2024, 7, 5, 9)),
    ("2024-07-05 10:00 CST", "Asia/Shanghai", "DMY", micros(2024, 7, 5, 2)),
    ("2024-01-05 10:00 AEDT", "Australia/Sydney", "DMY", micros(2024, 1, 4, 23)),
    ("2024-01-05 10:00 SAST", "Africa/Johannesburg", "DMY", micros(2024, 1, 5, 8)),
    ("2024-02-30 10:00:00", "UTC", "DMY", None),
    ("0000-00-00 00:00:00", "UTC", "DMY", None),
    ("2024-01-05 25:00", "UTC", "DMY", None),
    ("2024-01-05 10:00 Mars/Olympus", "UTC", "DMY", None),
    ("2024-01-05 10:00", None, "DMY", None),
    ("2024-01-05 10:00", "No/Where", "DMY", None),
    ("yesterday", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
]


def test_instants(spark):
    rows = spark.createDataFrame([(i, r, z, o) for i, (r, z, o, _) in enumerate(INSTANTS)], "i int, raw string, zone string, ord string")
    got = {r["i"]: r["earlier"] for r in parse_instants(rows, "raw", "zone", "ord").collect()}
    for i, (raw, _, _, expected) in enumerate(INSTANTS):
        assert got[i] == expected, (raw, got[i], expected)


def test_wall_times_that_occur_twice(spark):
    zone = ZoneInfo("America/New_York")
    early, late = micros(2024, 11, 3, 1, 30, tz=zone), micros(2024, 11, 3, 1, 30, tz=zone, fold=1)
    assert late - early == 3_600_000_000
    at = lambda us: dt.datetime.fromtimestamp(us / 1e6, UTC)
    news = spark.createDataFrame(
        [(1, "2024-11-03 01:30:00", "ny", at(late + 60_000_000)), (2, "2024-11-03 01:30:00", "ny", at(late - 60_000_000)), (3, "2024-11-03 01:30:00", "ny", None), (4, "2024-03-10 02:30:00", "ny", None), (5, "2024-11-03 01:30:00", "gone", None)],
        "ingest_id long, published_utc string, source string, received_at timestamp",
    )
    feeds = spark.createDataFrame([("ny", "America/New_York", "MDY", "wire")], "source string, tz string, date_order string, feed_kind string")
    got = {r["ingest_id"]: r["norm_micros"] for r in news_instants(news, feeds).collect()}
    assert got[1] == late and got[2] == early and got[3] == early and got[5] is None
    assert got[4] == micros(2024, 3, 10, 7, 30)  # skipped wall time: the offset before the change


def test_dictionary_parses_new_texts_only(spark, tmp_path):
    path = f"file://{tmp_path}/dict"
    req = lambda *raws: spark.createDataFrame([("duration", r, None, None) for r in raws], "kind string, raw string, zone string, date_order string")
    d = InstantDictionary(spark, path)
    d.absorb(req("5m", "5m", None, "x"))
    d.absorb(req("5m", "1h"))
    assert len(d.folder.names()) == 2 and spark.read.parquet(*[f"{path}/{n}" for n in d.folder.names()]).count() == 3
    # Another writer that saw nothing of this adds a key once more.
    spark.read.parquet(f"{path}/{d.folder.names()[0]}").write.parquet(f"{path}/texts-other")
    again = InstantDictionary(spark, path)
    assert sorted((r["raw"], r["earlier"]) for r in again.read().collect()) == [("1h", 3_600_000_000), ("5m", 300_000_000), ("x", None)]
    rows = spark.createDataFrame([("5m",), ("zz",), (None,)], "t string")
    assert {r["t"]: r["norm_micros"] for r in again.resolve(rows, "duration", "t").collect()} == {"5m": 300_000_000, "zz": None, None: None}


@pytest.mark.parametrize(
    "raw,us",
    [
        ("10.006", 10_006_000), ("10024 ms", 10_024_000), ("00:00:03.338", 3_338_000), ("00:01:49.621", 109_621_000), ("10.044s", 10_044_000), ("PT10.014S", 10_014_000), ("1.900 sec", 1_900_000),
        ("0.334900e1", 3_349_000), ("1m 0.826s", 60_826_000), ("PT1M31.251S", 91_251_000), ("-1", None), ("nan", None), ("", None), (None, None), ("half-hourly", 1_800_000_000), ("1 hour 30 min", 5_400_000_000),
        ("P1DT12H", 129_600_000_000), ("1wk", 604_800_000_000), ("0.25h", 900_000_000), ("3600000 ms", 3_600_000_000), ("P", None), ("5 parsecs", None), ("1 day 02:00:00", 93_600_000_000), ("-5m", None),
    ],
)
def test_durations(spark, raw, us):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(duration_micros(F.col("raw")).alias("us")).first()["us"] == us


SCHEMA = "msg_id long, case_id string, delivered_at timestamp, key string"


def test_exactly_once(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=UTC)
    rows = [(1, "A|1", t(5), "k"), (2, " a|1 ", t(3), "k"), (3, "a|1", t(3), "k"), (4, "B", None, "k"), (5, "b", t(9), "k"), (6, None, t(1), "k"), (7, None, t(1), "k"), (8, "", t(1), "k"), (9, " ", t(2), "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["msg_id"] for r in repeated_deliveries(df).collect()) == [1, 3, 4, 9]
    kept = exactly_once(df)
    assert kept.columns == df.columns and sorted(r["msg_id"] for r in kept.collect()) == [2, 5, 6, 7, 8]
    assert repeated_deliveries(df.limit(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_over_two_sessions(spark, tmp_path):
    rows = [(i, f"c{i % 7}", dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=(i * 37) % 11), "x") for i in range(60)] + [(90, None, None, "x"), (91, "late", None, "x"), (92, "late", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    best = {}
    for i, c, at, _ in rows:
        if c:
            best[c.upper()] = min(best.get(c.upper(), (at or dt.datetime.max.replace(tzinfo=UTC), i)), (at or dt.datetime.max.replace(tzinfo=UTC), i))
    expected = {k: v[1] for k, v in best.items()}
    path = f"file://{tmp_path}/store"
    store = DeliveryStore(spark, path, buckets=3)
    store.upsert(df.where("msg_id < 20"), batch_id="one")
    store.upsert(df.where("msg_id between 15 and 40"), batch_id="two")
    # A second session knows the runs and the number of buckets, and takes no batch twice.
    again = DeliveryStore(spark, path)
    assert again.buckets == 3 and again.runs == store.runs and len(again.runs) == 2
    again.upsert(df, batch_id="two")
    assert len(again.runs) == 2
    again.upsert(df, batch_id="three", cut=dt.datetime(2024, 1, 1, 0, 0, 5, tzinfo=UTC))
    assert len(again.runs) == 4
    with _sorted_buckets(spark):
        plan = _plan(again._merged(*again.runs[:2]))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort [" not in plan
    assert {r["key"]: r["msg_id"] for r in again.compact().collect()} == expected
    # Only the merged run is left; a batch that comes again changes nothing.
    assert [n for n in again.folder.names() if n.startswith("merge-")] == again.runs and not any(again.folder.names(n) for n in again.folder.names() if n.startswith("run-"))
    again.upsert(df)
    assert {r["key"]: r["msg_id"] for r in DeliveryStore(spark, path).compact().collect()} == expected
    assert DeliveryStore(spark, f"file://{tmp_path}/none").compact().count() == 0


PANEL = "symbol string, ts date, ret_20 double, volatility_20 double, news_count double, updated_at timestamp, cal_day string"


def test_trailing_totals_against_brute_force(spark):
    u = lambda h: dt.datetime(2024, 2, 1, h, tzinfo=UTC)
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("A", d(0), 0.1, None, 1.0, u(1), "z"), ("A", d(0), 0.2, None, 5.0, u(0), "z"), ("A", d(9), None, 1.5, None, u(1), "z"), ("A", d(12), float("nan"), 2.0, 2.0, None, "z"), ("A", d(12), float("nan"), 2.0, 2.0, None, "z"), ("B", d(3), 0.3, 0.1, 0.0, u(1), "z"), (None, d(3), 1.0, 1.0, 1.0, u(1), "z"), ("A", None, 1.0, 1.0, 1.0, u(1), "z")]
    df = spark.createDataFrame(rows, PANEL)
    got = {(r["symbol"], r["cal_day"]): r for r in trailing_totals(df, ["news_count", "ret_20"], [7]).collect()}
    assert len(got) == 13 + 1
    news = {0: 1.0, 12: 2.0}
    for k in range(13):
        window = range(max(0, k - 6), k + 1)
        total = sum(news.get(j, 0.0) for j in window)
        r = got[("A", d(k))]
        assert r["news_count_total_7"] == total and r["news_count_obs_7"] == sum(j in news for j in window)
        assert r["news_count_avg_7"] == pytest.approx(total / len(window))
        assert r["ret_20_total_7"] == (0.1 if k <= 6 else 0.0)
    idle = {(r["symbol"], r["cal_day"], r["window_days"]) for r in idle_days(df).collect()}
    assert ("A", "2024-01-08", 7) in idle and ("A", "2024-01-07", 7) not in idle and ("B", "2024-01-04", 30) in idle and not any(s == "A" and w == 30 for s, _, w in idle)
    assert trailing_totals(df.limit(0), ["news_count"], [7]).count() == 0


def test_trailing_total_is_exact(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=k), 0.1 * (-1) ** k, 0.0, 0.1 if k < 5 else 0.0, None, "z") for k in range(40)]
    got = {r["cal_day"] for r in idle_days(spark.createDataFrame(rows, PANEL), windows=(7,)).collect()}
    assert got == {str(dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(11, 40)}


def test_large_values_are_summed(spark):
    v = [1e300, -3e20, 1e15, 2.5, None, 7e13]
    rows = [("A", dt.date(2024, 1, 1 + k), x, 0.0, 0.1, None, "z") for k, x in enumerate(v)] + [("B", dt.date(2024, 1, 1), float("inf"), 0.0, 1e-15, None, "z")]
    got = {(r["symbol"], r["cal_day"].day): r for r in trailing_totals(spark.createDataFrame(rows, PANEL), ["ret_20", "news_count"], [2]).collect()}
    assert got["A", 1]["ret_20_total_2"] == 1e300 and got["A", 3]["ret_20_total_2"] == -3e20 + 1e15 and got["A", 4]["ret_20_total_2"] == 1e15 + 2.5
    assert got["A", 6]["ret_20_total_2"] == 7e13 and got["A", 6]["ret_20_obs_2"] == 1
    assert got["B", 1]["ret_20_total_2"] == 0 and got["B", 1]["news_count_total_2"] == 1e-15


def test_versions_against_brute_force(spark):
    import random

    rng = random.Random(5)
    t = lambda h: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=h)
    versions = []
    for i in range(60):
        a = rng.randrange(0, 400)
        versions.append((i, rng.choice(["A", "b ", "C", None]), rng.choice(["x", "y"]), t(a), rng.choice([None, t(a + rng.randrange(1, 200))]), t(a + rng.randrange(-50, 90))))
    events = [(i, rng.choice(["a", " B", "C", "D", None, ""]), None if i % 17 == 0 else round(t(rng.randrange(0, 700)).timestamp() * 1e6), "v") for i in range(500)]
    v = spark.createDataFrame(versions, "version_id long, symbol string, bucket string, valid_from timestamp, valid_to timestamp, known_at timestamp")
    e = spark.createDataFrame(events, "id long, symbol string, at long, version_id string")
    expected = set()
    for i, s, at, _ in events:
        if at is None or s is None or not s.strip():
            continue
        fits = [(a, k, vid) for vid, vs, _, a, z, k in versions if vs and vs.strip().upper() == s.strip().upper() and a.timestamp() * 1e6 <= at and k.timestamp() * 1e6 <= at and (z is None or z.timestamp() * 1e6 > at)]
        if fits:
            expected.add((i, max(fits)[2]))
    got = versions_at(e.drop("version_id"), v, "symbol", "at", ["id"])
    assert {(r["id"], r["version_id"]) for r in got.collect()} == expected
    wide = with_attributes(e, v, "symbol", "at", ["id"], ["bucket"])
    assert wide.count() == 500 and wide.where("asof_bucket is not null").count() == len(expected)
    assert versions_at(e.limit(0), v, "symbol", "at", ["id"]).count() == 0 and versions_at(e, v.limit(0), "symbol", "at", ["id"]).count() == 0


def test_joins_beyond_the_broadcast_bound(spark):
    facts = spark.createDataFrame([(i, i % 5 if i % 3 else 0) for i in range(200)], "i long, k long")
    dim = spark.createDataFrame([(k, k * 10) for k in range(4)], "k long, v long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = sorted(map(tuple, bounded_join(facts, dim, ["k"], how).select("i").collect()))
        assert small == sorted(map(tuple, bounded_join(facts, dim, ["k"], how, max_rows=1).select("i").collect()))
        assert small == sorted(map(tuple, salted_join(facts, dim, ["k"], how, salts=3, hot_floor=20).select("i").collect()))
    assert {r["k"] for r in hot_keys(facts, ["k"], floor=40).collect()} == {0}
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = sorted(map(str, facts.join(dim, "k", "left").select("i", "v").collect()))
    assert plain == sorted(map(str, split_join(facts, dim, ["k"], counts, "n", hot_floor=20).select("i", "v").collect()))
