"""SQL of the general problems' queries."""

from __future__ import annotations

from tidemark.plans.oracle import sql

_ABBREVIATION = "CASE upper(mark) WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'IST' THEN 330 WHEN 'BST' THEN 60 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'SGT' THEN 480 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 END"
_FORMATS = "['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y%m%dT%H%M%S', '%d-%b-%Y %H:%M:%S', '%a, %d %b %Y %H:%M:%S', '%d %b %y, %H:%M']"

NEWS_TIMES = rf"""nt1 AS (
  SELECT ingest_id, symbol, received_at, tz, date_order, regexp_replace(published_utc, '^\s+|\s+$', '', 'g') AS s FROM news_articles LEFT JOIN feed_sources USING (source) WHERE published_utc IS NOT NULL),
nt2 AS (SELECT *, CASE WHEN regexp_full_match(s, '\d{{9,11}}') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_full_match(s, '\d{{12,14}}') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_full_match(s, '\d{{15,17}}') THEN CAST(s AS BIGINT) END AS epoch,
    regexp_extract(s, '(?:\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?|T\d{{6}})\s*(Z|z|[A-Z]{{3,4}}|[A-Za-z]+/[A-Za-z_]+|[+-]\d{{2}}:?\d{{2}}(?:\[[^\]]*\])?)$', 1) AS mark FROM nt1),
nt3 AS (SELECT *, trim(substr(s, 1, length(s) - length(mark))) AS body FROM nt2),
nt4 AS (SELECT *, CASE WHEN regexp_matches(body, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN CASE WHEN date_order = 'MDY' THEN try_strptime(body, ['%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M']) ELSE try_strptime(body, ['%d/%m/%Y %I:%M %p', '%d/%m/%Y %H:%M']) END ELSE try_strptime(body, {_FORMATS}) END AS wall,
    regexp_replace(regexp_replace(mark, '\[.*$', ''), ':', '') AS off, CASE WHEN mark = '' THEN tz WHEN contains(mark, '/') AND NOT contains(mark, '[') THEN mark END AS zone FROM nt3),
nt5 AS (SELECT *, CASE WHEN zone IS NOT NULL THEN timezone(zone, wall) END AS last_z FROM nt4),
nt6 AS (SELECT *, CASE WHEN timezone(zone, last_z - INTERVAL 1 HOUR) = wall THEN last_z - INTERVAL 1 HOUR ELSE last_z END AS first_z FROM nt5),
news_times AS (SELECT ingest_id, symbol, coalesce(epoch, CASE WHEN regexp_matches(off, '^[+-]\d{{4}}$') THEN epoch_us(wall) - (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS BIGINT) * 60 + CAST(off[4:5] AS BIGINT)) * 60000000 WHEN {_ABBREVIATION} IS NOT NULL THEN epoch_us(wall) - CAST({_ABBREVIATION} AS BIGINT) * 60000000::BIGINT
    WHEN last_z <= received_at THEN epoch_us(last_z) ELSE epoch_us(first_z) END) AS norm_micros FROM nt6)"""

_UNIT = "CASE WHEN regexp_matches(u, '^(ms|msec|millis.*)$') THEN 1000 WHEN regexp_matches(u, '^s(ec.*)?$') THEN 1000000 WHEN regexp_matches(u, '^m(in.*)?$') THEN 60000000 WHEN regexp_matches(u, '^h(r|our)?s?$') THEN 3600000000 WHEN regexp_matches(u, '^d(ay)?s?$') THEN 86400000000 WHEN regexp_matches(u, '^w(k|eek)?s?$') THEN 604800000000 END"

DURATIONS = rf"""du1 AS (SELECT 'seconds' AS field_name, msg_id AS record_id, lower(trim(seconds)) AS s FROM harness_results UNION ALL SELECT 'bar_interval', run_id, lower(trim(bar_interval)) FROM run_settings),
du2 AS (SELECT field_name, record_id, s, CASE WHEN s IN ('nan', 'n/a', '', 'p', 'pt') THEN NULL
    WHEN s = 'half-hourly' THEN 1800000000 WHEN s = 'hourly' THEN 3600000000 WHEN s = 'daily' THEN 86400000000 WHEN s = 'weekly' THEN 604800000000
    WHEN regexp_full_match(s, '\d+(\.\d+)?(e\d+)?') THEN CAST(s AS DOUBLE) * 1000000
    WHEN regexp_full_match(s, '\d+:\d+:\d+(\.\d+)?') THEN (CAST(split_part(s, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(s, ':', 2) AS DOUBLE) * 60 + CAST(split_part(s, ':', 3) AS DOUBLE)) * 1000000
    WHEN regexp_full_match(s, 'p(\d+w)?(\d+d)?(t(\d+h)?(\d+m)?([\d.]+s)?)?') OR regexp_full_match(s, '([\d.]+ ?[a-z]+[ ,]*)+') THEN
      list_sum(list_transform(regexp_extract_all(CASE WHEN s[1] = 'p' THEN replace(s, 't', ' ') ELSE s END, '[\d.]+ ?[a-z]+'), lambda x: CAST(regexp_extract(x, '^[\d.]+') AS DOUBLE) * {_UNIT.replace("(u,", "(regexp_extract(x, '([a-z]+)$', 1),")}))
    END AS us FROM du1),
durations AS (SELECT field_name, record_id, CAST(floor(us + 0.5) AS BIGINT) AS norm_micros FROM du2 WHERE us >= 0)"""

_DAYS = """f AS (SELECT symbol, ts, updated_at, ret_20, volatility_20, news_count FROM feature_panel WHERE symbol IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY updated_at DESC NULLS LAST, news_count DESC NULLS LAST, ret_20 DESC NULLS LAST, volatility_20 DESC NULLS LAST) = 1),
b AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM f GROUP BY 1), d AS (SELECT symbol, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS cal_day FROM b),
j AS (SELECT d.symbol, d.cal_day, date_diff('day', a, d.cal_day) + 1 AS age, ret_20, volatility_20, news_count FROM d LEFT JOIN f ON f.symbol = d.symbol AND f.ts = d.cal_day)"""


def _measure(m: str, w: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY cal_day ROWS {w - 1} PRECEDING)"
    total = f"coalesce(sum(CAST({m} AS DECIMAL(26, 12))) {over}, 0)"
    return f"CAST({total} AS DOUBLE) AS {m}_total_{w}, count({m}) {over} AS {m}_obs_{w}, CAST({total} AS DOUBLE) / least({w}, age) AS {m}_avg_{w}"


_MEASURES = ["news_count", "ret_20", "volatility_20"]
_FIRST = "k AS (SELECT *, upper(trim(case_id)) AS key, row_number() OVER (PARTITION BY upper(trim(case_id)) ORDER BY delivered_at, msg_id) AS r FROM harness_results)"

ORACLE_SQL = {
    "p1_found": f"WITH {NEWS_TIMES}, {DURATIONS} SELECT 'published_utc' AS field_name, ingest_id AS record_id, norm_micros FROM news_times WHERE norm_micros >= 0 UNION ALL SELECT field_name, record_id, norm_micros FROM durations",
    "p2_found": f"WITH {_FIRST} SELECT msg_id FROM k WHERE key IS NOT NULL AND r > 1",
    "p2_kept": f"WITH {_FIRST} SELECT msg_id, batch_id, case_id, harness_fail, fail_reason FROM k WHERE key IS NULL OR r = 1",
    "p5_found": f"WITH {_DAYS}, w AS (SELECT symbol, strftime(cal_day, '%Y-%m-%d') AS cal_day, coalesce(sum(news_count) OVER (PARTITION BY symbol ORDER BY j.cal_day ROWS 6 PRECEDING), 0) AS t7, coalesce(sum(news_count) OVER (PARTITION BY symbol ORDER BY j.cal_day ROWS 29 PRECEDING), 0) AS t30 FROM j) SELECT symbol, cal_day, 7 AS window_days FROM w WHERE t7 = 0 UNION ALL SELECT symbol, cal_day, 30 FROM w WHERE t30 = 0",
    "p5_trailing": sql(
        [_DAYS],
        f"SELECT symbol, strftime(cal_day, '%Y-%m-%d') AS cal_day, {', '.join(_measure(m, w) for w in (7, 30) for m in _MEASURES)} FROM j",
        ["symbol", "cal_day", *[f"{m}_obs_{w}" for w in (7, 30) for m in _MEASURES]],
        [f"{m}_{kind}_{w}" for w in (7, 30) for m in _MEASURES for kind in ("total", "avg")],
    ),
    "p6_found": f"""WITH {NEWS_TIMES}, ev AS (SELECT 'news_articles' AS event_table, ingest_id AS event_id, upper(trim(symbol)) AS s, norm_micros AS us FROM news_times UNION ALL SELECT 'sentiment_records', record_id, upper(trim(symbol)), epoch_us(ts) FROM sentiment_records)
      SELECT event_table, event_id, version_id FROM ev JOIN symbol_versions v ON s = upper(trim(v.symbol)) AND epoch_us(valid_from) <= us AND epoch_us(known_at) <= us AND (valid_to IS NULL OR epoch_us(valid_to) > us)
      QUALIFY row_number() OVER (PARTITION BY event_table, event_id ORDER BY valid_from DESC, known_at DESC, version_id DESC) = 1""",
}
