"""Files, the provider source, the scorer seam, and streams against their batch forms."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scorers import keyword_scorer, scored
from tidemark.operators.ingest import keep_last
from tidemark.operators.joins import with_decision_date
from tidemark.plans.ship import ship_package
from tidemark.sources import files as S
from tidemark.sources.provider import BarsDataSource
from tidemark.sources.tables import table
from tidemark.sources.views import articles, sessions
from tidemark.streaming import jobs


def write(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl_with_bad_lines(spark, tmp_path):
    good, bad = S.read_jsonl(spark, write(tmp_path / "a.jsonl", '{"k": "a", "n": 1}\n\n{"k": "b"\n{"k": "c", "n": 3}\nnot json\n'), "k string, n long")
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("c", 3)]
    assert sorted(r["line"] for r in bad.collect()) == ["not json", '{"k": "b"'] or bad.count() == 2


def test_last_by_key(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq int, v string")
    assert sorted(map(tuple, S.last_by_key(log, "k", "seq").collect())) == [("a", 2, None), ("b", 1, "y")]


def test_exchange_csv(spark, tmp_path):
    path = write(tmp_path / "x.csv", " SYMBOL , SERIES , CLOSE \nA, EQ ,\"1,234.5\"\nB,BE,2\nC,EQ,-\n")
    rows = S.read_exchange_csv(spark, path, ["CLOSE"]).collect()
    assert [(r["SYMBOL"], r["CLOSE"]) for r in rows] == [("A", 1234.5), ("C", None)]
    assert S.read_exchange_csv(spark, write(tmp_path / "y.csv", "<html>\nblocked\n"), ["CLOSE"]).count() == 0


def test_announcements(spark):
    raw = ['{"id": "1", "an_dt": "05-Jan-2024 10:00:00", "symbol": " a ", "desc": "Result"}', '{"id": "1", "an_dt": "05-Jan-2024 11:00:00", "symbol": "A", "desc": "Later"}', '{"id": "2", "an_dt": "bad", "sort_date": "2024-01-05 10:00:00", "symbol": "B", "desc": "x"}', '{"id": "3", "an_dt": "bad", "symbol": "B"}', "nonsense", None]
    rows = {r["article_id"]: r for r in S.parse_announcements(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["subject"] == "Result" and rows["1"]["published_utc"] == dt.datetime(2024, 1, 5, 4, 30)


def test_validity_map_and_universe(spark):
    m = S.validity_map(spark.createDataFrame([('{"A": {"sector": "x", "from": "2020-01-01", "to": "2021-01-01"}, "B": {"sector": "y"}}',)], "raw string"))
    got = {r["symbol"]: r for r in m.collect()}
    assert got["B"]["from"] == dt.date(2010, 1, 1) and got["B"]["to"] is None and got["A"]["to"] == dt.date(2021, 1, 1)
    days = spark.createDataFrame([(dt.date(2020, 6, 1),), (dt.date(2005, 1, 1),)], "day date")
    assert sorted(map(tuple, S.universe_at(m, days, ["Z"]).collect())) == [(dt.date(2005, 1, 1), "Z"), (dt.date(2020, 6, 1), "A"), (dt.date(2020, 6, 1), "B")]


def test_bounds_and_missing_files(spark, small, tmp_path):
    row = S.time_bounds(spark, f"{small}/orders.parquet", "o_orderdate").first()
    assert row["n_rows"] == table(spark, small, "orders").count()
    assert S.read_parquet_or_none(spark, str(tmp_path / "none.parquet")) is None
    S.write_json(str(tmp_path / "r.json"), {"a": 1})
    assert S.read_json(str(tmp_path / "r.json")) == {"a": 1} and S.read_json(str(tmp_path / "q.json"), 5) == 5


def test_provider_source(spark):
    ship_package(spark)
    spark.dataSource.register(BarsDataSource)
    load = lambda **o: spark.read.format("tidemark_bars").options(**o).load()
    df = load(symbols="A,B", start="2024-01-01", end="2024-01-07")
    assert df.count() == 10 and df.where("high < low").count() == 0
    with pytest.raises(Exception, match="unknown provider"):
        load(provider="nobody", symbols="A").count()


def test_scorer(spark):
    ship_package(spark)
    df = spark.createDataFrame([("good good bad",), ("bad",), (" ",), (None,)], "t string")
    rows = df.select(scored(F.col("t"), keyword_scorer(["good"], ["bad"])).alias("s")).select("s.*").collect()
    assert [(r["label"], round(r["score"], 3)) for r in rows] == [("positive", 0.333), ("negative", -1.0), ("neutral", 0.0), ("neutral", 0.0)]


def run(stream, tmp_path, name, mode="append", **batch):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
    q = (writer.foreachBatch(batch["each"]) if batch else writer.format("memory").queryName(name)).start()
    q.awaitTermination()


@pytest.fixture()
def feed(spark, small, tmp_path):
    a = articles(spark, small)
    a.repartition(3).write.parquet(str(tmp_path / "feed"))
    return lambda: spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_decision_stream_equals_batch(spark, small, feed, tmp_path):
    s = sessions(spark, small)
    run(jobs.decided(feed(), s), tmp_path, "decided")
    batch = with_decision_date(articles(spark, small), s)
    key = lambda df: sorted((r["article_id"], r["decision_date"]) for r in df.select("article_id", "decision_date").collect())
    assert key(spark.table("decided")) == key(batch)


def test_duplicates_within_the_watermark(spark, feed, tmp_path):
    twice = feed()
    run(jobs.unique_articles(twice.unionByName(feed()), "published_utc", late="400 days"), tmp_path, "unique_articles")
    got = spark.table("unique_articles")
    assert got.count() == got.select("article_id").distinct().count() > 0


def test_windows_equal_batch(spark, small, feed, tmp_path):
    run(jobs.window_figures(feed(), "published_utc", "score", "symbol", late="400 days"), tmp_path, "figures", mode="complete")
    batch = articles(spark, small).groupBy(F.window("published_utc", "5 minutes"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("figures").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0] and spark.table("figures").count() == batch.count()
    for stream in (jobs.sliding_counts(feed(), "published_utc", "symbol"), jobs.sessions_of(feed(), "published_utc", "symbol")):
        assert stream.isStreaming


def test_upserts_survive_a_repeated_batch(spark, small, feed, tmp_path):
    path = str(tmp_path / "out")
    write_batch = jobs.upsert_batches(path, "symbol", "published_utc")
    run(feed(), tmp_path, "upserts", each=lambda df, e: (write_batch(df, e), write_batch(df, e)))
    got = jobs.read_upserts(spark, path, "symbol", "published_utc").select("symbol", "published_utc", "article_id")
    want = keep_last(articles(spark, small), ["symbol"], ["published_utc"]).select("symbol", "published_utc", "article_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_acceptance_stream(spark, tmp_path):
    ship_package(spark)
    t = lambda d: pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)
    rows = [("A", 1, t(0), t(3)), ("A", 2, t(2), t(4)), ("A", 3, t(4), t(5)), ("B", 4, t(0), t(9)), ("B", 5, t(9), t(10)), ("B", 6, t(10), t(11))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "id", "start", "end"]), "symbol string, id long, start timestamp, end timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "trades"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "trades"))
    run(jobs.accepted_stream(stream), tmp_path, "accepted")
    assert {r["id"] for r in spark.table("accepted").where("accepted").collect()} == {1, 3, 4, 6}


def test_session_sums_and_recursive_means_over_batches(spark, tmp_path):
    """Two batches, the second of which repeats a part of the first: the same as over all rows at once."""
    ship_package(spark)
    days = pd.date_range("2024-01-01", periods=90).date
    rows = [(s, d, (k * 7 + len(s)) % 5) for s in ("A", "BB") for k, d in enumerate(days)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "session", "n"]), "symbol string, session date, n long")
    path = str(tmp_path / "sessions")
    df.where("session < date'2024-02-20'").coalesce(1).write.parquet(path + "/a")
    df.where("session >= date'2024-02-10'").coalesce(1).write.parquet(path + "/b")
    feed = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    run(jobs.session_sums(feed()), tmp_path, "session_sums")
    got = {(r["symbol"], r["session"]): (r["n_5"], r["n_20"], r["n_60"]) for r in spark.table("session_sums").collect()}
    values = {s: [n for t, _, n in rows if t == s] for s in ("A", "BB")}
    assert got == {(s, d): tuple(sum(values[s][max(0, k - w + 1) : k + 1]) for w in (5, 20, 60)) for s in values for k, d in enumerate(days)}
    series = feed().select("symbol", F.col("session").cast("timestamp").alias("ts"), F.when(F.col("n") != 3, F.col("n").cast("double")).alias("value"))
    run(jobs.ewm_stream(series, 0.2), tmp_path, "ewm")
    means = {(r["symbol"], r["ts"].date()): r["mean"] for r in spark.table("ewm").collect()}
    for s in values:
        want = pd.Series([float(n) if n != 3 else None for n in values[s]]).ewm(alpha=0.2, adjust=False).mean()
        assert all(means[s, d] == pytest.approx(w) if w == w else means[s, d] is None for d, w in zip(days, want))


def test_difference_scorer_and_cache(spark, tmp_path):
    from tidemark.functions.scorers import difference_scorer

    score = difference_scorer(lambda texts: [{"positive": 0.7, "negative": 0.2}, {"positive": 0.1, "negative": 0.4}, {}])()
    labels, values = score(["a", "b", "c"])
    assert labels == ["positive", "negative", "neutral"] and values == pytest.approx([0.5, 0.3, 0.0])
    reads = []
    cache = S.FileCache(lambda p: reads.append(p) or open(p).read(), most=1)
    (tmp_path / "x").write_text("one")
    assert cache.get(str(tmp_path / "x")) == cache.get(str(tmp_path / "x")) == "one" and len(reads) == 1
    (tmp_path / "x").write_text("other")
    assert cache.get(str(tmp_path / "x")) == "other" and cache.get(str(tmp_path / "none")) is None
