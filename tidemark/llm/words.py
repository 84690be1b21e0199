"""Text as comparable words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that part words as blanks do, and signs that vanish inside their word.
PARTING = "\n\r\t   　  \u0085\x0b\x0c–—/|"
VANISHING = ".,;:!?\"'()[]{}%*_`~^$#@+=<>&\\-‐‑“”‘’„‚«»‹›…·•°§©®™₹€£¥­​‌‍﻿"


def words_of(text: Column) -> Column:
    """Lower-case words of ``text`` without markup, line marks and punctuation; null gives an empty array.

    Tags and entities become blanks, and so do dashes and slashes between
    words. All other signs vanish inside their word, so ``same-store`` and
    ``1,101`` are one word each. Common signs go by a table; the general
    patterns run only on texts that need them.
    """
    low = F.lower(text)
    plain = F.when(low.contains("<") | low.contains("&"), F.regexp_replace(low, r"<[^<>\n]{1,200}>|&#?[a-z0-9]{2,8};", " ")).otherwise(low)
    plain = F.translate(plain, PARTING + VANISHING, " " * len(PARTING))
    rest = r"[^\p{L}\p{N}\p{M} ]+"
    plain = F.when(plain.rlike(rest), F.regexp_replace(plain, rest, "")).otherwise(plain)
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))
