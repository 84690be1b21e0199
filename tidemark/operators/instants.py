"""Mixed timestamp and duration texts, normalised to microseconds.

Raw strings repeat, and a parser that tries every format is the costly part. So
the distinct (text, zone, date order) combinations become a dictionary table:
each new combination is parsed once, appended to the stored dictionary, and the
rows get their instants by an equi-join. All parsing is native Spark
expressions.

A wall time that a zone shows twice keeps both readings in the dictionary; the
row's own arrival time picks one at the join.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import Folder, materialize, scratch_path
from tidemark.plans.skew import salted_join, split_join

# English month names, and zone abbreviations with their offsets in minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "PKT": 300, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BST": 60,
}
#: Years whose abbreviations of a zone are known; where one had several offsets, the latest counts.
ABBREVIATION_YEARS = range(1990, 2036)

_ZONE = r"(?:\s*(z|[a-z]{2,5}|[a-z]+(?:/[a-z0-9_+-]+)+|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?(?:\[[^\]]*\])?))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?(?![a-z]))?"
_DAYNAME = r"(?:[a-z]{3,9}\.?,?\s+)?"
#: Pattern, and the order in which its groups give year, month, day, hour, minute, second, fraction, am/pm, zone.
_FORMATS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:t|,?\s+){_CLOCK})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th)?[ -]+([a-z]{{3,9}})\.?,?[ -]+(\d{{4}}|\d{{2}})(?:(?:,?\s+|t){_CLOCK})?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAYNAME}([a-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:(?:,?\s+|t){_CLOCK})?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_NUMERIC = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK})?{_ZONE}$"

_DAY_US = 86_400_000_000


def _clean(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def _try_int(c: Column) -> Column:
    return c.try_cast("int")


def zone_ids(spark: SparkSession) -> list[str]:
    """Every region that the JVM's time zone database knows."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


@lru_cache(maxsize=None)
def abbreviations_of(zone: str) -> dict[str, int]:
    """Abbreviations that ``zone`` itself uses in ``ABBREVIATION_YEARS``, with their offsets in minutes; none where it has only numbers."""
    try:
        clock = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        return {}
    found = {}
    for year in ABBREVIATION_YEARS:
        for month in range(1, 13):
            at = datetime(year, month, 15, tzinfo=clock)
            if at.tzname().isalpha():
                found[at.tzname().upper()] = round(at.utcoffset().total_seconds() / 60)
    return found


def parse_instants(df: DataFrame, raw: str, zone: str, date_order: str) -> DataFrame:
    """``df`` with ``earlier`` and ``later``: the readings of ``raw`` in microseconds since 1970 UTC.

    They differ only for wall times that the zone shows twice. Null where the
    text is missing, unreadable, no date of the calendar, or a wall time
    without any known zone. Wall times that a zone skips are read with the
    offset before the change. Bare numbers are seconds, milli-, micro- or
    nanoseconds by their digits. All-digit dates follow ``date_order`` unless
    one of the two numbers can only be a day.

    The work is staged in projections, each of which uses a few columns of the
    one before, so that no regular expression is evaluated twice.
    """
    col = F.col
    keep = df.columns
    text = F.regexp_replace(F.lower(_clean(col(raw))), r"(?U)\s+", " ")
    df = df.withColumn("__text", text)

    canonical = F.when(col("__text").rlike(_FORMATS[0][0]), F.regexp_replace("__text", *map(F.lit, _FORMATS[0])))
    for pattern, groups in _FORMATS[1:]:
        canonical = canonical.when(col("__text").rlike(pattern), F.regexp_replace("__text", F.lit(pattern), F.lit(groups)))
    first = _try_int(F.regexp_extract("__text", r"^(\d{1,2})[/.-]", 1))
    second = _try_int(F.regexp_extract("__text", r"^\d{1,2}[/.-](\d{1,2})[/.-]", 1))
    month_first = F.when(first > 12, F.lit(False)).when(second > 12, F.lit(True)).otherwise(F.upper(col(date_order)) == "MDY")
    numeric = lambda groups: F.regexp_replace("__text", F.lit(_NUMERIC), F.lit(groups))
    canonical = (
        canonical.when(~col("__text").rlike(_NUMERIC), F.lit(None))
        .when(month_first, numeric("$3|$1|$2|$4|$5|$6|$7|$8|$9"))
        .when(~month_first, numeric("$3|$2|$1|$4|$5|$6|$7|$8|$9"))
    )
    length = F.length("__text")
    digits = col("__text").rlike(r"^\d{9,20}$") & ~col("__text").rlike(r"^(19|20)\d{12}$")
    number = col("__text").try_cast("decimal(20,0)")
    epoch = (
        F.when(digits & (length <= 11), number * 1_000_000)
        .when(digits & (length <= 14), number * 1_000)
        .when(digits & (length <= 17), number)
        .when(digits, F.floor(number / 1_000))
        .when(col("__text").rlike(r"^\d{9,11}\.\d{1,9}$"), F.floor(col("__text").try_cast("decimal(30,9)") * 1_000_000))
        .try_cast("long")
    )
    df = df.withColumns({"__epoch": epoch, "__part": F.split(F.when(~digits, canonical), r"\|", -1)})

    get = lambda i: F.when(col("__part")[i] != "", col("__part")[i])
    year = F.when(F.length(get(0)) == 2, _try_int(get(0)) + F.when(_try_int(get(0)) < 70, 2000).otherwise(1900)).otherwise(_try_int(get(0)))
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(get(1), 1, 3)).cast("int")
    month = F.coalesce(_try_int(get(1)), F.when(by_name > 0, by_name))
    hour = F.coalesce(_try_int(get(3)), F.lit(0))
    half = get(7)
    hour = (
        F.when(half.isNull(), hour)
        .when((hour < 1) | (hour > 12), F.lit(None))
        .when(half == "p", hour % 12 + 12)
        .otherwise(hour % 12)
    )
    date = F.try_to_date(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(_try_int(get(2)).cast("string"), 2, "0")),
        "yyyy-MM-dd",
    )
    df = df.withColumns(
        {
            "__date": F.when(get(0).isNotNull() & month.isNotNull() & (year >= 1), date),
            "__hour": hour,
            "__minute": F.coalesce(_try_int(get(4)), F.lit(0)),
            "__second": F.coalesce(_try_int(get(5)), F.lit(0)),
            "__micros": F.coalesce(_try_int(F.rpad(F.substring(get(6), 1, 6), 6, "0")), F.lit(0)),
            "__mark": get(8),
        }
    )

    offset = F.regexp_extract("__mark", r"^(?:utc|gmt)?([+-]\d.*?)(?:\[.*)?$", 1)
    named = F.array_join(F.transform(F.split("__mark", "/"), lambda p: F.array_join(F.transform(F.split(p, "_"), F.initcap), "_")), "/")
    written = F.regexp_extract(col(raw), r"([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)(?U)\s*$", 1)
    ids = zone_ids(df.sparkSession)
    region = F.when(col("__mark").isNull(), col(zone)).when(col("__mark").contains("/"), F.when(written.isin(ids), written).otherwise(named))
    seconds = ((col("__hour") * 60 + col("__minute")) * 60 + col("__second")).cast("long")
    df = df.withColumns(
        {
            "__wall": F.when((col("__hour") < 24) & (col("__minute") < 60) & (col("__second") < 60), F.unix_date("__date") * F.lit(_DAY_US) + seconds * F.lit(1_000_000) + col("__micros")).cast("long"),
            "__offset": F.when(offset != "", offset),
            "__region": F.when(region.isin(ids), region),
        }
    )

    width = F.length(F.regexp_replace("__offset", "[^0-9]", ""))
    padded = F.lpad(F.regexp_replace("__offset", "[^0-9]", ""), 4, "0")
    minutes = F.when(width <= 2, _try_int(F.regexp_replace("__offset", "[^0-9]", "")) * 60).otherwise(
        _try_int(F.substring(padded, 1, 2)) * 60 + _try_int(F.substring(padded, 3, 2))
    )
    by_offset = F.when(minutes <= 18 * 60, F.when(col("__offset").startswith("-"), -minutes).otherwise(minutes))
    upper = F.upper("__mark")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    # One row an identifier of a zone: no more than the database of zones has.
    used = [r[0] for r in df.select(zone).where(col(zone).isin(ids)).distinct().collect()]
    local = [F.lit(x) for z in sorted(used) for a, m in abbreviations_of(z).items() for x in (f"{z}|{a}", m)]
    by_zone = F.try_element_at(F.create_map(*local), F.concat_ws("|", col(zone), upper)) if local else F.lit(None).cast("int")
    by_abbreviation = F.coalesce(by_zone, F.try_element_at(table, upper))
    df = df.withColumns(
        {
            "__fixed": F.coalesce(by_offset, by_abbreviation).cast("long"),
            "__zoned": F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__wall"), col("__region"))),
        }
    )

    after = col("__zoned") + F.lit(_DAY_US)
    offset_after = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(after), col("__region"))) - after
    df = df.withColumn("__late", col("__wall") - offset_after)

    shown_again = (col("__late") > col("__zoned")) & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("__late"), col("__region"))) == col("__wall"))
    known = F.coalesce(col("__epoch"), col("__wall") - col("__fixed") * F.lit(60_000_000))
    return df.select(
        *[col(f"`{c}`") for c in keep],
        F.coalesce(known, col("__zoned")).alias("earlier"),
        F.coalesce(known, F.when(shown_again, col("__late")).otherwise(col("__zoned"))).alias("later"),
    )


# Unit words of durations with their length in microseconds.
UNITS = {
    "us": 1, "µs": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "msec": 1_000, "msecs": 1_000, "millisecond": 1_000, "milliseconds": 1_000, "millis": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "secs": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "mins": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hrs": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": _DAY_US, "day": _DAY_US, "days": _DAY_US,
    "w": 7 * _DAY_US, "wk": 7 * _DAY_US, "wks": 7 * _DAY_US, "week": 7 * _DAY_US, "weeks": 7 * _DAY_US,
}
#: Words for the time between two of a regular event.
WORDS = {
    "secondly": 1_000_000, "minutely": 60_000_000, "quarter-hourly": 900_000_000, "half-hourly": 1_800_000_000,
    "hourly": 3_600_000_000, "half-daily": 43_200_000_000, "daily": _DAY_US, "weekly": 7 * _DAY_US, "biweekly": 14 * _DAY_US, "fortnightly": 14 * _DAY_US,
}

_NUM = r"\d+(?:[.,]\d+)?(?:e[+-]?\d+)?"


def duration_micros(raw: Column) -> Column:
    """Length of a duration text in microseconds, halves rounded up.

    Reads bare numbers (seconds, also with an exponent), numbers with units one
    after another, ``[d ]hh:mm[:ss[.f]]``, ISO 8601 (``PT1M2.5S``, ``P1DT12H``,
    ``P2W``) and words such as ``hourly``. A day is 24 hours, a week seven days;
    calendar months and years have no fixed length. Null where the text is
    missing, unreadable or negative.
    """
    text = F.regexp_replace(F.lower(_clean(raw)), r"(?U)\s+", " ")
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    micros = lambda c: F.floor(c + 0.5).try_cast("long")
    # seconds as decimals first, so that 1.005 stays exact
    plain = F.when(
        text.rlike(r"^\d{1,12}(\.\d{1,12})?$"), F.floor(text.try_cast("decimal(30,12)") * 1_000_000 + F.lit(0.5).cast("decimal(2,1)")).try_cast("long")
    ).when(text.rlike(rf"^{_NUM}$"), micros(number(text) * 1_000_000))
    clock = r"^(?:(\d{1,6})(?: days?,?)? )?(\d{1,4}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?$"
    c = lambda i: F.coalesce(F.regexp_extract(text, clock, i).try_cast("long"), F.lit(0))
    by_clock = F.when(
        text.rlike(clock) & (c(3) < 60) & (c(4) < 60),
        c(1) * _DAY_US + ((c(2) * 60 + c(3)) * 60 + c(4)) * 1_000_000 + F.coalesce(F.rpad(F.substring(F.regexp_extract(text, clock, 5), 1, 6), 6, "0").try_cast("long"), F.lit(0)),
    )
    iso = rf"^p(?:({_NUM})w)?(?:({_NUM})d)?(?:t(?:({_NUM})h)?(?:({_NUM})m)?(?:({_NUM})s)?)?$"
    i = lambda k, us: F.coalesce(number(F.regexp_extract(text, iso, k)), F.lit(0.0)) * us
    by_iso = F.when(
        text.rlike(iso) & text.rlike(r"\d"), micros(i(1, 7 * _DAY_US) + i(2, _DAY_US) + i(3, 3_600_000_000) + i(4, 60_000_000) + i(5, 1_000_000))
    )
    names = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    units = rf"^(?:{_NUM} ?(?:{names})(?:,? and |,? |(?=\d)|$))+$"
    table = F.create_map(*[F.lit(x) for u, us in UNITS.items() for x in (u, float(us))])
    pairs = F.regexp_extract_all(text, F.lit(rf"({_NUM}) ?({names})(?![a-zµ])"), F.lit(0))
    total = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda acc, p: acc + number(F.regexp_extract(p, rf"^({_NUM})", 1)) * F.try_element_at(table, F.regexp_extract(p, rf"^{_NUM} ?(.*)$", 1)),
    )
    by_units = F.when(text.rlike(units), micros(total))
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.coalesce(plain, by_clock, by_iso, by_units, F.try_element_at(words, text)).cast("long")


class InstantDictionary:
    """Stored readings of distinct time texts.

    ``kind`` is ``instant`` or ``duration``; the key is the raw text with the
    zone and date order of its source. ``absorb`` parses only keys that are not
    stored yet and adds them as one more folder, which counts once it is
    complete; so a later batch pays for its new texts alone. The folder is
    ``path``, else the one that the session names in ``spark.tidemark.instants.dir``,
    which all queries then share, else one of its own. Two writers may add the
    same key: both read the same, and one of the rows is used.
    """

    KEY = ["kind", "raw", "zone", "date_order"]
    SCHEMA = "kind string, raw string, zone string, date_order string, earlier long, later long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.folder = Folder(spark, path or spark.conf.get("spark.tidemark.instants.dir", None) or scratch_path(spark, "instants"))
        self._asked: DataFrame | None = None

    def read(self) -> DataFrame:
        """One row for each key that was ever absorbed."""
        parts = [n for n in self.folder.names() if "_SUCCESS" in self.folder.names(n)]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        stored = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder.path}/{n}" for n in parts])
        return stored if len(parts) == 1 else stored.dropDuplicates(self.KEY)

    def absorb(self, requests: DataFrame) -> None:
        """Add the keys of ``requests`` (kind, raw, zone, date_order); null texts are left out."""
        asked = (
            requests.where(F.col("raw").isNotNull())
            .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("zone", "date_order")})
            .groupBy(*self.KEY)
            .agg(F.count(F.lit(1)).alias("n"))
        )
        self._asked = asked = materialize(asked, "time-texts")
        fresh = asked.join(self.read().select(*self.KEY), self.KEY, "left_anti") if self.folder.names() else asked
        read = parse_instants(fresh.withColumn("__key_zone", F.when(F.col("zone") != "", F.col("zone"))), "raw", "__key_zone", "date_order")
        length = F.when(F.col("kind") == "duration", duration_micros(F.col("raw")))
        instant = F.col("kind") == "instant"
        read.select(*self.KEY, F.when(instant, F.col("earlier")).otherwise(length).alias("earlier"), F.when(instant, F.col("later")).otherwise(length).alias("later")).write.parquet(
            f"{self.folder.path}/texts-{uuid.uuid4().hex}"
        )

    def resolve(self, rows: DataFrame, kind: str, raw: str, zone: str | None = None, date_order: str | None = None, not_after: str | None = None, out: str = "norm_micros") -> DataFrame:
        """``rows`` with the column ``out``: the reading of ``raw``, or null.

        Of two readings of a wall time the later one counts that is not after
        the timestamp ``not_after``; without one, or where it is null, the
        earlier. Null texts, which match nothing, are spread over all tasks.
        """
        nowhere = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(1 << 16)).cast("string")
        keyed = rows.withColumns(
            {
                "__raw": F.col(raw),
                "__zone": F.coalesce(F.col(zone), F.lit("")) if zone else F.lit(""),
                "__order": F.when(F.col(raw).isNull(), nowhere).otherwise(F.coalesce(F.col(date_order), F.lit("")) if date_order else F.lit("")),
            }
        )
        names = [F.col("raw").alias("__raw"), F.col("zone").alias("__zone"), F.col("date_order").alias("__order")]
        dim = self.read().where(F.col("kind") == kind).select(*names, F.col("earlier").alias("__earlier"), F.col("later").alias("__later"))
        if self._asked is None:
            joined = salted_join(keyed, dim, ["__raw", "__zone", "__order"], "left")
        else:
            joined = split_join(keyed, dim, ["__raw", "__zone", "__order"], self._asked.where(F.col("kind") == kind).select(*names, "n"), "n")
        reading = F.col("__earlier")
        if not_after:
            reading = F.when(F.col("__later") <= F.unix_micros(F.col(not_after)), F.col("__later")).otherwise(F.col("__earlier"))
        return joined.withColumn(out, reading).drop("__raw", "__zone", "__order", "__earlier", "__later")


def with_source_zone(news: DataFrame, feed_sources: DataFrame) -> DataFrame:
    """``news`` with ``__tz`` and ``__date_order`` of its source; null where the source is unknown."""
    from tidemark.plans.skew import bounded_join

    feeds = feed_sources.select(F.col("source"), F.col("tz").alias("__tz"), F.col("date_order").alias("__date_order")).dropDuplicates(["source"])
    return bounded_join(news, feeds, ["source"], "left")


def news_instants(news: DataFrame, feed_sources: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """``news`` with ``norm_micros``, the instant of ``published_utc``.

    Rows whose text is null, empty or unreadable keep a null. Extra columns are
    kept; columns named ``__tz`` and ``__date_order`` are used on the way and dropped.
    """
    dictionary = dictionary or InstantDictionary(news.sparkSession)
    zoned = with_source_zone(news, feed_sources)
    dictionary.absorb(zoned.select(F.lit("instant").alias("kind"), F.col("published_utc").alias("raw"), F.col("__tz").alias("zone"), F.col("__date_order").alias("date_order")))
    return dictionary.resolve(zoned, "instant", "published_utc", "__tz", "__date_order", "received_at").drop("__tz", "__date_order")


def normalized_times(news: DataFrame, feed_sources: DataFrame, harness: DataFrame, settings: DataFrame) -> DataFrame:
    """(field_name, record_id, norm_micros) of every readable time text of the three tables."""
    spark = news.sparkSession
    dictionary = InstantDictionary(spark)
    zoned = with_source_zone(news.select("ingest_id", "published_utc", "source", "received_at"), feed_sources)
    durations = harness.select(F.lit("seconds").alias("field_name"), F.col("msg_id").alias("record_id"), F.col("seconds").alias("raw")).unionByName(
        settings.select(F.lit("bar_interval").alias("field_name"), F.col("run_id").alias("record_id"), F.col("bar_interval").alias("raw"))
    )
    requests = zoned.select(F.lit("instant").alias("kind"), F.col("published_utc").alias("raw"), F.col("__tz").alias("zone"), F.col("__date_order").alias("date_order")).unionByName(
        durations.select(F.lit("duration").alias("kind"), "raw", F.lit(None).cast("string").alias("zone"), F.lit(None).cast("string").alias("date_order"))
    )
    dictionary.absorb(requests)
    instants = dictionary.resolve(zoned, "instant", "published_utc", "__tz", "__date_order", "received_at").select(
        F.lit("published_utc").alias("field_name"), F.col("ingest_id").alias("record_id"), "norm_micros"
    )
    lengths = dictionary.resolve(durations, "duration", "raw").select("field_name", "record_id", "norm_micros")
    return instants.unionByName(lengths).where(F.col("norm_micros") >= 0)
