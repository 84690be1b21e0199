"""Readers and writers of files as feeds deliver them: tolerant scans, logs, exchange tables, announcements, reports."""

from __future__ import annotations

import json
import os
import tempfile
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import whole


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, without files that are corrupt; None where there is none or no file can be read."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    except Exception as e:  # a schema can't be had from corrupt files alone
        if "CANNOT_READ_FILE" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_panel(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One panel of many files named by symbol: columns of the files and ``symbol``."""
    reader = spark.read.schema(schema) if schema else spark.read
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:%2E|\.)parquet$|([^/]+)/[^/]+\.parquet$", 1)
    return reader.parquet(path).withColumn("symbol", F.url_decode(name))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines as ``line``: those that are no JSON object of the schema. Blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    kept = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in fields.fields]), parsed.where(bad).select(F.col("value").alias("line"))


def last_by_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key of an append-only log; a maximum, so combined before the shuffle."""
    rest = [c for c in log.columns if c not in (key, order)]
    best = log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("__r"))
    return best.select(*[c if c == key else F.col(f"__r.`{c}`").alias(c) for c in log.columns])


def read_exchange_csv(spark: SparkSession, path: str, numbers: list[str], series: str = "EQ") -> DataFrame:
    """Rows of one series of an exchange's table, with trimmed headers and values and numbers where they can be read."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = raw.toDF(*[c.strip().upper() for c in raw.columns])
    if "SERIES" not in named.columns:
        return named.limit(0)  # a page that says the table is blocked
    rows = named.where(F.upper(F.trim("SERIES")) == series)
    return rows.withColumns({c: F.regexp_replace(F.trim(c), ",", "").try_cast("double") for c in numbers if c in rows.columns})


def clean_deals(deals: DataFrame) -> DataFrame:
    """Deals with a key, a side of BUY or SELL and a positive quantity, each once."""
    out = deals.select(F.to_date("date").alias("date"), F.upper(F.trim("symbol")).alias("symbol"), F.trim("client").alias("client"), F.upper(F.trim("side")).alias("side"), F.regexp_replace("qty", ",", "").try_cast("long").alias("qty"), F.regexp_replace("price", ",", "").try_cast("double").alias("price"))
    return out.where(F.col("side").isin("BUY", "SELL") & (F.col("qty") > 0)).na.drop(subset=["date", "symbol", "client"]).dropDuplicates()


def first_time(*texts: Column, zone: str = "Asia/Kolkata") -> Column:
    """UTC instant of the first text that is a local time, as ``dd-MMM-yyyy HH:mm:ss`` or ISO."""
    tries = []
    for t in texts:
        tries += [F.try_to_timestamp(t, F.lit("dd-MMM-yyyy HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(t, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))]
    return F.to_utc_timestamp(F.coalesce(*tries), zone)


def parse_announcements(records: DataFrame, raw: str = "raw") -> DataFrame:
    """(article_id, published_utc, symbol, subject, text, text_sha) of JSON announcements; records without time or symbol are left out, each id once."""
    r = records.select(F.from_json(raw, "id string, an_dt string, sort_date string, symbol string, desc string, attchmntText string").alias("r")).select("r.*")
    text = F.coalesce(F.trim("attchmntText"), F.lit(""))
    out = r.select(
        F.coalesce("id", F.substring(F.sha2(F.concat_ws("|", "symbol", "an_dt", "desc"), 256), 1, 32)).alias("article_id"), first_time(F.col("an_dt"), F.col("sort_date")).alias("published_utc"),
        F.upper(F.trim("symbol")).alias("symbol"), F.trim("desc").alias("subject"), text.alias("text"), F.substring(F.sha2(text, 256), 1, 16).alias("text_sha"),
    )
    from tidemark.operators.ingest import keep_first

    return keep_first(out.where("published_utc is not null and symbol is not null and symbol <> ''"), ["article_id"], ["published_utc"])


def parse_entries(entries: DataFrame) -> DataFrame:
    """(article_id, published_utc, title, url) of feed entries: the first usable of three dates; entries without title are left out."""
    when = first_time(F.col("published"), F.col("updated"), F.col("created"), zone="UTC")
    title = F.trim("title")
    out = entries.select(F.substring(F.sha2(F.concat_ws("|", F.coalesce("url", F.lit("")), title), 256), 1, 32).alias("article_id"), when.alias("published_utc"), title.alias("title"), "url")
    return out.where("title is not null and title <> ''").dropDuplicates(["article_id"])


def validity_map(records: DataFrame, raw: str = "raw", start: str = "2010-01-01") -> DataFrame:
    """(symbol, bucket, from, to) of a nested JSON map symbol -> {sector, from, to}; a missing start is ``start``, an open end null."""
    m = records.select(F.explode(F.from_json(raw, "map<string, struct<sector: string, `from`: string, `to`: string>>")).alias("symbol", "v"))
    return m.select("symbol", F.col("v.sector").alias("bucket"), F.coalesce(F.try_to_date("v.from", "yyyy-MM-dd"), F.lit(start).cast("date")).alias("from"), F.try_to_date("v.to", "yyyy-MM-dd").alias("to"))


def time_bounds(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """(n_rows, first, last) of a parquet table; with aggregate push-down from the footers alone."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.parquet.aggregatePushdown", "spark.sql.sources.useV1SourceList")}
    try:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in before["spark.sql.sources.useV1SourceList"].split(",") if x != "parquet"))
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        return spark.createDataFrame(row.collect(), row.schema)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trading_calendar(index: DataFrame, value: str = "close", ts: str = "ts") -> DataFrame:
    """(session): dates on which an index has a value."""
    return index.where(F.col(value).isNotNull()).select(F.to_date(ts).alias("session")).distinct()


def universe_at(members: DataFrame, days: DataFrame, static: list[str]) -> DataFrame:
    """(day, symbol): members valid on each day, or the static list where there are none."""
    wanted = days.select("day").distinct()
    span = whole(wanted, a=F.min("day"), z=F.max("day"))
    clipped = members.select("symbol", F.greatest("from", span["a"]).alias("a"), F.least(F.coalesce("to", span["z"]), span["z"]).alias("z")).where("a <= z")
    held = clipped.select("symbol", F.explode(F.sequence("a", "z")).alias("day")).join(wanted, "day").groupBy("day").agg(F.collect_set("symbol").alias("s"))
    return wanted.join(held, "day", "left").select("day", F.explode(F.coalesce("s", F.array(*map(F.lit, static)))).alias("symbol"))


def wide_series(rows: DataFrame, names: list[str], value: str = "close") -> DataFrame:
    """Series (name, ts, value) side by side on ts; a date that one lacks is null there."""
    return rows.groupBy("ts").pivot("name", names).agg(F.first(value))


def write_json(path: str, document: object) -> None:
    """A small report on the driver, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(document, f, indent=1, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def read_json(path: str, default: object = None) -> object:
    """The report, or ``default`` where there is none or it can't be read."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


class FileCache:
    """Values read from small files on the driver, read again once a file's time or size is another; the least used ones go first."""

    def __init__(self, read: Callable[[str], object], most: int = 64):
        self.read, self.most = read, most
        self._kept: OrderedDict[str, tuple[tuple[int, int], object]] = OrderedDict()

    def get(self, path: str) -> object:
        """The value, or None where there is no such file."""
        try:
            stat = os.stat(path)
        except OSError:
            self._kept.pop(path, None)
            return None
        stamp = (stat.st_mtime_ns, stat.st_size)
        if path not in self._kept or self._kept[path][0] != stamp:
            self._kept[path] = (stamp, self.read(path))
        self._kept.move_to_end(path)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)
        return self._kept[path][1]
