"""Text functions: identifiers, leakage scan, validation of rated answers, label values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that a text knows what came after its decision date, by class.
LEAK_PATTERNS = {
    "post_decision_date": [
        r"\b(20\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b",
        r"\b(next|following) (week|day|days)\b",
        r"\bfive days later\b",
        r"\bafter the event\b",
    ],
    "outcome_mentions": [
        r"\btriple.?barrier\b",
        r"\bupper barrier (was )?hit\b",
        r"\blower barrier (was )?hit\b",
        r"\btouched the (ceiling|floor)\b",
        r"\blabel (is|was) (UP|DOWN|FLAT)\b",
    ],
    "future_prices_returns": [
        r"\b(rose|fell|gained|lost|closed at|settled at)\s+\d+(?:\.\d+)?\s*(?:%|percent|rs|inr)\b",
        r"\b5-day return\b",
        r"\brealized return\b",
        r"\bevent_end\b",
    ],
    "self_incrimination": [
        r"\bi have seen (future|post|subsequent)\b",
        r"\bas an ai\b.*\bknowledge cutoff\b",
        r"\bbased on what happened (after|next)\b",
    ],
}
_ISO_DATE = LEAK_PATTERNS["post_decision_date"][0]


def article_id(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the trimmed parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), 256), 1, 32)


def leak_counts(text: Column, decision_date: Column) -> dict[str, Column]:
    """Number of signs in ``text`` by class, without regard to case; null texts have none.

    ISO dates up to the decision date are no sign; those that are no date of
    the calendar are, and so are all where the decision date is missing.
    """
    body = F.coalesce(text, F.lit(""))
    dates = F.regexp_extract_all(body, F.lit(_ISO_DATE), F.lit(0))
    later = F.size(F.filter(dates, lambda d: F.coalesce(F.try_to_date(d, "yyyy-MM-dd") > decision_date, F.lit(True))))
    out = {}
    for name, patterns in LEAK_PATTERNS.items():
        counts = [later if p == _ISO_DATE else F.regexp_count(body, F.lit(f"(?i){p}")) for p in patterns]
        out[name] = sum(counts[1:], counts[0]).cast("int")
    return out


def rated_answer(content: Column, thinking: Column) -> Column:
    """(vote, confidence, sentiment, reason) of the first flat object with a vote in ``content``.

    reason is empty for a valid answer, else the first test that fails:
    ``empty-thinking`` (below fifty characters), ``no-json-vote``,
    ``json-parse``, ``bad-vote:X``, ``bad-numbers``, ``out-of-range``,
    ``bad-trace-steps``, ``sign-mismatch``. The values are null unless valid.
    """
    raw = F.regexp_extract(F.coalesce(content, F.lit("")), r'(?s)(\{[^{}]*"vote"[^{}]*\})', 1)
    obj = F.from_json(raw, "vote string, confidence string, sentiment string, trace_steps string")
    vote = F.upper(F.coalesce(obj["vote"], F.lit("")))
    confidence, sentiment = obj["confidence"].try_cast("double"), obj["sentiment"].try_cast("double")
    steps = F.regexp_replace(F.coalesce(obj["trace_steps"], F.lit("[1,2,3,4]")), r"\s", "")
    reason = (
        F.when(F.length(F.trim(F.coalesce(thinking, F.lit("")))) < 50, "empty-thinking")
        .when(raw == "", "no-json-vote")
        .when(F.try_parse_json(raw).isNull(), "json-parse")
        .when(~vote.isin("UP", "DOWN", "FLAT"), F.concat(F.lit("bad-vote:"), vote))
        .when(confidence.isNull() | sentiment.isNull() | F.isnan(confidence) | F.isnan(sentiment), "bad-numbers")
        .when(~sentiment.between(-1, 1) | ~confidence.between(0, 1), "out-of-range")
        .when(steps != "[1,2,3,4]", "bad-trace-steps")
        .when(((vote == "UP") & (sentiment < 0)) | ((vote == "DOWN") & (sentiment > 0)) | ((vote == "FLAT") & (F.abs(sentiment) >= 0.5)), "sign-mismatch")
        .otherwise("")
    )
    valid = lambda c: F.when(reason == "", c)
    return F.struct(valid(vote).alias("vote"), valid(confidence).alias("confidence"), valid(sentiment).alias("sentiment"), reason.alias("reason"))


def sentiment_value(score: Column, label: Column) -> Column:
    """The number if there is one, else 1, -1 or 0 by the label, else 0."""
    by_label = F.when(F.lower(label) == "positive", 1.0).when(F.lower(label) == "negative", -1.0)
    return F.coalesce(score.try_cast("double"), by_label, F.lit(0.0))


def case_parts(case_id: Column) -> Column:
    """(symbol, day, hash) of ``symbol|date|hash``; missing parts are null."""
    parts = F.split(case_id, r"\|")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("symbol"), F.try_to_date(F.try_element_at(parts, F.lit(2)), "yyyy-MM-dd").alias("day"), F.try_element_at(parts, F.lit(3)).alias("hash"))


def capped_words(text: Column, most: int = 1500) -> Column:
    """The first ``most`` blank-separated words, for prompts of bounded size."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def business_days(a: Column, b: Column) -> Column:
    """Weekdays after ``a`` up to ``b``, in closed form; negative intervals count 0."""
    upto = lambda d: F.floor((F.unix_date(d) + 3) / 7) * 5 + F.least((F.unix_date(d) + 3) % 7, F.lit(4)) + 1
    return F.greatest(upto(b) - upto(a), F.lit(0)).cast("int")
