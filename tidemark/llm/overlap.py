"""Same or nearly the same records across the splits of a data set.

Texts become arrays of word hashes, and equal arrays one class. Two classes are
the same text if few words were changed, added or dropped. Every evaluation
class of L words is cut into k + 1 + SPARE + COMMON segments of equal length,
k being the most segments that a match can touch. The COMMON segments that would
make the most pairs are left out: they are the phrases that a large part of all
texts may share. At least SPARE + 1 of the others stand unchanged in each match,
shifted by the most edits at most. Training classes offer every substring of
those lengths that is such a segment; the join on its hash and position finds
the pairs that share enough segments, and banded dynamic programming decides
each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import PARTING, VANISHING
from tidemark.plans.scratch import materialize
from tidemark.plans.skew import HOT_ROWS, HOT_SHARE, salted_join

#: Of this many words one may differ.
WORDS_PER_EDIT = 10
#: Words that remarks before or after a text may have without counting, beyond those told by their form.
REMARK = 4
#: Segments beyond those that the most edits can touch. More of them ask for more shared segments, but shorter ones.
SPARE = 1
#: Further segments of a text, those with the most pairs, that are left out: phrases that very many texts share.
COMMON = 4
#: Texts whose substrings are sent on at once.
SLICE = 1000
#: Bits of the filter for each evaluation segment; two of them are set, so one substring in some sixty passes by chance.
BITS_A_SEGMENT = 16
#: Most segments of one filter (64 MB); more evaluation texts are matched block by block.
SEGMENTS_A_BLOCK = 1 << 25
# Signs that part words here, besides those that always do.
HYPHENS = "-‐‑"
_BLANKS = " \t\r\n\u00a0"


def with_article(rows: DataFrame, prompt: str, out: str) -> DataFrame:
    """``rows`` with ``out``: text between the lines ARTICLE: and TASK: of a prompt (or their German names); without them the prompt itself; null gives null."""
    parts = F.split(F.col(prompt), r"(?i)(?:^|\n)[ \t]*(?:ARTICLE|ARTIKEL)[ \t]*:", 2)
    body = F.split(F.element_at("__parts", -1), r"(?i)\n[ \t]*(?:TASK|AUFGABE)[ \t]*:", 2)[0]
    return rows.withColumn("__parts", parts).withColumn(out, F.when(F.size("__parts") > 1, F.btrim(body, F.lit(_BLANKS))).otherwise(F.col("__parts")[0])).drop("__parts")


def with_words(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the words of ``text`` as they count here, without case, punctuation, spacing or number style; null gives none.

    Hyphens part words, all other signs vanish inside their word, and words for
    percent are left out as the sign is. Short remarks around the text, such as
    ``Corrected -`` or ``(Desk copy)``, are left out where they can be told by
    their form: bracketed, before a colon or dash at the start, or a closing
    sentence of one or two words. Common signs go by a table; the general
    patterns run only on texts that need them. Each step is a projection of its
    own, so that no text is worked out twice.
    """
    remark = r"^(?:\([^()]{1,40}\)|\[[^\[\]]{1,40}\]|\p{L}{1,40}(?: \p{L}{1,40})?(?::| [-–—](?=\s)))"
    step = rows.withColumn("__w", F.regexp_replace(F.ltrim(F.lower(text), F.lit(_BLANKS)), remark, ""))
    step = step.withColumn("__w", F.rtrim("__w", F.lit(_BLANKS)))
    bracketed = F.substring("__w", -1, 1).isin(")", "]")
    step = step.withColumn("__w", F.when(bracketed, F.regexp_replace("__w", r"(?:\([^()]{1,40}\)|\[[^\[\]]{1,40}\])$", "")).otherwise(F.col("__w")))
    # Two words and their signs have no more room than this.
    step = step.withColumn("__c", F.length(F.regexp_extract(F.substring("__w", -100, 100), r"[.;!?](\s+\p{L}{1,40}(?: \p{L}{1,40})?[.!]?\s*)$", 1)))
    step = step.withColumn("__w", F.when(F.col("__c") > 0, F.substring("__w", F.lit(1), F.length("__w") - F.col("__c"))).otherwise(F.col("__w")))
    step = step.withColumn("__w", F.translate("__w", PARTING + HYPHENS + VANISHING, " " * len(PARTING + HYPHENS)))
    rest = r"[^\p{L}\p{N}\p{M} ]+"
    step = step.withColumn("__w", F.when(F.col("__w").rlike(rest), F.regexp_replace("__w", rest, "")).otherwise(F.col("__w")))
    return step.withColumn(out, F.coalesce(F.filter(F.split("__w", " "), lambda w: ~w.isin("", "pct", "percent", "prozent")), F.array().cast("array<string>"))).drop("__w", "__c")


def most_edits(n_words):
    """Edits that any match of a text of ``n_words`` may have, remarks included; a match may be the longer text."""
    return (n_words + REMARK) // (WORDS_PER_EDIT - 1) + REMARK


def plan_segments(n_words: int) -> tuple[int, int, int]:
    """(segments, words of each, most that a match can touch) of an evaluation text.

    A changed word touches one segment. Remark words stand at the ends, so up to
    ``REMARK`` of them touch no more segments than are needed to hold them.
    """
    changes = (n_words + REMARK) // (WORDS_PER_EDIT - 1)
    for width in range(REMARK, 0, -1):
        by_remark = max(-(-a // width) - (-(REMARK - a) // width) for a in range(REMARK + 1))
        touched = changes + by_remark
        number = touched + 1 + SPARE + COMMON
        if n_words // number >= width:
            return number, n_words // number, touched
    # Shorter texts are cut into single words, fewer than a match could touch.
    return n_words, 1, touched


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each substring of ``width`` codes."""
    if len(codes) < width:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - width + 1 + j]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def _slots(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    return [hashes & np.uint64(n_bits - 1), (hashes >> np.uint64(32)) & np.uint64(n_bits - 1)]


def filter_bits(n_segments: int) -> int:
    """Size of a filter of ``n_segments``: a power of two with ``BITS_A_SEGMENT`` for each at least."""
    return 1 << max(10, (n_segments * BITS_A_SEGMENT - 1).bit_length())


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of evaluation classes: (seg, width, cls, no, at, n)."""
    for pdf in batches:
        seg, owner = [np.empty(0, dtype=np.uint64)], []
        for cls, words in zip(pdf["cls"].tolist(), pdf["codes"]):
            codes = np.asarray(words, dtype=np.int64).view(np.uint64)
            n = len(codes)
            if n:
                number, width, _ = plan_segments(n)
                seg.append(_rolling(codes, width)[np.arange(number) * width])
                owner.append((cls, width, n, number))
        cls, width, n, times = (np.array(c, dtype=np.int64) for c in zip(*owner)) if owner else (np.empty(0, dtype=np.int64) for _ in range(4))
        no = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        each = lambda c: np.repeat(c, times)
        yield pd.DataFrame({"seg": np.concatenate(seg).view(np.int64), "width": each(width), "cls": each(cls), "no": no, "at": no * each(width), "n": each(n)})


def _filter_words(n_bits: int):
    """(word, bits): the 64-bit words of the filter that the segments of a partition set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: set[int] = set()
        for pdf in batches:
            for s in _slots(pdf["seg"].to_numpy(dtype=np.int64).view(np.uint64), n_bits):
                bits.update(np.unique(s).tolist())
        slots = np.fromiter(bits, dtype=np.int64, count=len(bits))
        order = np.argsort(slots)
        words, starts = np.unique(slots[order] >> 6, return_index=True)
        masks = (np.uint64(1) << (slots[order] & 63).astype(np.uint64)).view(np.int64)
        yield pd.DataFrame({"word": words, "bits": np.bitwise_or.reduceat(masks, starts) if len(words) else masks})

    return run


def segment_filter(segments: DataFrame, n_segments: int) -> bytes:
    """Filter of the hashes ``seg``; no larger than ``SEGMENTS_A_BLOCK`` segments make it."""
    n_bits = filter_bits(n_segments)
    bits = np.zeros(n_bits // 64, dtype=np.uint64)
    table = segments.select("seg").mapInPandas(_filter_words(n_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits.tobytes()


def _substrings(filter_bc, widths_bc, count: bool):
    """Substrings of training classes that pass the filter: (seg, width, cls, at, n), or with ``count`` (seg, width, ft), how many a slice of texts has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(filter_bc.value, dtype=np.uint64)
        n_bits, widths = len(bits) * 64, widths_bc.value
        passes = lambda h: np.all([(bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) for s in _slots(h, n_bits)], axis=0)
        for pdf in batches:
            # Texts are strung together a slice at a time, so that each width is rolled over all of them at once.
            for start in range(0, len(pdf), SLICE):
                part = pdf.iloc[start : start + SLICE]
                texts, n = part["codes"].to_list(), part["codes"].map(len).to_numpy(dtype=np.int64)
                cls = part["cls"].to_numpy(dtype=np.int64)
                for width, (low, high) in widths.items():
                    # A text of m words is cut by its own length; only lengths within the most edits of either can match.
                    fit = np.flatnonzero((n >= max(width, low - most_edits(low))) & (n <= high + most_edits(high)))
                    if not len(fit):
                        continue
                    rolled = _rolling(np.concatenate([texts[k] for k in fit]).astype(np.int64).view(np.uint64), width)
                    sizes = n[fit]
                    text = np.repeat(np.arange(len(fit)), sizes)[: len(rolled)]
                    at = np.arange(len(rolled)) - (np.cumsum(sizes) - sizes)[text]
                    # What begins in one text and ends in the next is no substring.
                    hits = np.flatnonzero((at <= sizes[text] - width) & passes(rolled))
                    segs = rolled[hits].view(np.int64)
                    if count:
                        found, ft = np.unique(segs, return_counts=True)
                        yield pd.DataFrame({"seg": found, "width": width, "ft": ft})
                    else:
                        yield pd.DataFrame({"seg": segs, "width": width, "cls": cls[fit][text[hits]], "at": at[hits], "n": sizes[text[hits]]})

    return run


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two arrays where it is at most ``most``, else None.

    Dynamic programming over the diagonals within the band: for each number of
    edits the furthest point that each diagonal reaches.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    goal = m - n
    reach = {0: _slide(a, b, 0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for e in range(1, most + 1):
        grown = {}
        for d in range(-min(e, most), min(e, most) + 1):
            i = max(
                reach.get(d, -2) + 1,  # replaced
                reach.get(d + 1, -2) + 1,  # dropped from a
                reach.get(d - 1, -2),  # added in b
            )
            if i < 0:
                continue
            i = min(i, n)
            if i + d > m or i + d < 0:
                i = min(i, m - d)
                if i < 0 or i + d < 0:
                    continue
            grown[d] = _slide(a, b, i, i + d)
        reach = grown
        if reach.get(goal, -1) >= n:
            return e
    return None


def _slide(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    k = min(len(a) - i, len(b) - j)
    if k <= 0:
        return i
    if a[i] != b[j]:
        return i
    differ = np.flatnonzero(a[i : i + k] != b[j : j + k])
    return i + (int(differ[0]) if len(differ) else k)


def same_text(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one word in ``WORDS_PER_EDIT`` differs, after up to ``REMARK`` extra words at either end of one text."""
    longest = max(len(a), len(b))
    allowed = longest // WORDS_PER_EDIT
    if min(len(a), len(b)) == 0:
        return False
    if len(np.intersect1d(a, b)) < (len(np.unique(a if len(a) <= len(b) else b)) - 2 * allowed - REMARK):
        return False
    most = allowed + REMARK
    found = edits_within(a, b, most)
    if found is None:
        return False
    if found <= allowed:
        return True
    # The text with the remark may be the shorter one, where it lost other words.
    for plain, remarked in ((a, b), (b, a)):
        for lead in range(REMARK + 1):
            for tail in range(REMARK - lead + 1):
                if (lead or tail) and lead + tail < len(remarked) and edits_within(plain, remarked[lead : len(remarked) - tail], allowed) is not None:
                    return True
    return False


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [same_text(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)) for a, b in zip(pdf["codes_e"], pdf["codes_t"])]
        yield pdf.loc[keep, ["cls_e", "cls_t"]]


def _block_pairs(segments: DataFrame, n_segments: int, training: DataFrame) -> DataFrame:
    """(cls_e, cls_t) of evaluation and training classes that share enough of ``segments``.

    Training texts are gone through twice: first to count the substrings that
    are segments, then, once the commonest segments of each evaluation class are
    left out, to offer those that are still asked for.
    """
    spark = segments.sparkSession
    # At most one range for each segment length.
    widths = spark.sparkContext.broadcast({r["width"]: (r["low"], r["high"]) for r in segments.groupBy("width").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()})
    every = spark.sparkContext.broadcast(segment_filter(segments, n_segments))
    in_train = training.mapInPandas(_substrings(every, widths, True), "seg long, width int, ft long").groupBy("seg", "width").agg(F.sum("ft").alias("ft"))
    in_eval = segments.groupBy("seg", "width").agg(F.count(F.lit(1)).alias("fe"))
    weight = materialize(in_eval.join(in_train, ["seg", "width"]), "segment-weights")
    # Segments that no training text has make no pairs and count as left out last.
    weighed = salted_join(segments, weight, ["seg", "width"], "left", spread=F.col("cls"), hot=_hot(weight, "fe"))
    pairs = F.col("ft").cast("double") * F.col("fe")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc_nulls_last(pairs), "no"))
    n_cut = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    cut = weighed.withColumns({"rank": rank, "n_cut": n_cut}).where((F.col("rank") > F.least(F.lit(COMMON), F.col("n_cut") - 1)) & F.col("ft").isNotNull())
    cut = materialize(cut.select("seg", "width", "no", F.col("cls").alias("cls_e"), F.col("at").alias("at_e"), F.col("n").alias("n_e"), F.greatest(F.col("n_cut") - COMMON, F.lit(1)).alias("kept")), "segments-asked")

    asked = spark.sparkContext.broadcast(segment_filter(cut, cut.count()))
    offered = training.mapInPandas(_substrings(asked, widths, False), "seg long, width int, cls long, at int, n int").withColumnsRenamed({"cls": "cls_t", "at": "at_t", "n": "n_t"})
    k = F.floor(F.greatest("n_e", "n_t") / WORDS_PER_EDIT) + REMARK
    met = salted_join(offered, cut, ["seg", "width"], "inner", spread=F.col("cls_t"), hot=_hot(weight, "ft"))
    met = met.where((F.abs(F.col("at_t") - F.col("at_e")) <= k) & (F.abs(F.col("n_t") - F.col("n_e")) <= k) & (F.col("cls_e") != F.col("cls_t")))
    # What a match of these two lengths can touch; see plan_segments.
    by_remark = F.when(F.col("width") >= 3, 2).when(F.col("width") == 2, 3).otherwise(REMARK)
    shared = met.groupBy("cls_e", "cls_t").agg(F.count_distinct("no").alias("shared"), F.max(F.col("kept") - (k - REMARK + by_remark)).alias("least"))
    return shared.where(F.col("shared") >= F.greatest("least", F.lit(1))).select("cls_e", "cls_t")


def _hot(weight: DataFrame, count: str) -> DataFrame:
    """Segments with very many rows on one side; few by definition."""
    total = weight.agg(F.sum(count).alias("s")).scalar()
    return weight.where((F.col(count) > HOT_ROWS) & (F.col(count) > total * HOT_SHARE))


def matching_classes(classes: DataFrame) -> DataFrame:
    """(cls_e, cls_t) of evaluation and training classes with nearly the same words.

    ``classes`` has (cls, codes, in_train, in_eval); a class in both splits
    matches itself without any comparison. Evaluation classes are taken in
    blocks, whose filter of segments has a bounded size, against all training
    classes.
    """
    evaluation = classes.where("in_eval").select("cls", "codes")
    training = classes.where("in_train").select("cls", "codes")
    segments = materialize(evaluation.mapInPandas(_cut, "seg long, width int, cls long, no int, at int, n int"), "segments")
    n_segments = segments.count()
    blocks = max(1, -(-n_segments // SEGMENTS_A_BLOCK))
    pairs = None
    for b in range(blocks):
        own = segments if blocks == 1 else segments.where(F.pmod("cls", F.lit(blocks)) == b)
        found = materialize(_block_pairs(own, n_segments // blocks + 1, training), "overlap-pairs")
        pairs = found if pairs is None else pairs.unionByName(found)

    with_e = pairs.join(evaluation.select(F.col("cls").alias("cls_e"), F.col("codes").alias("codes_e")), "cls_e")
    with_both = with_e.join(training.select(F.col("cls").alias("cls_t"), F.col("codes").alias("codes_t")), "cls_t")
    near = with_both.select("cls_e", "cls_t", "codes_e", "codes_t").mapInPandas(_verify, "cls_e long, cls_t long")
    same = classes.where("in_eval and in_train").select(F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"))
    return near.unionByName(same)


def case_key(case_id: str) -> Column:
    """Case without case and outer blanks; null and blank name no case."""
    key = F.upper(F.regexp_replace(F.col(case_id), r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def _split_side(split: Column) -> Column:
    name = F.lower(F.trim(split))
    return F.when(name == "train", "t").when(name.isin("validation", "test"), "e")


def cross_split_pairs(candidates: DataFrame) -> DataFrame:
    """(cand_id_a, cand_id_b, split, source_a, source_b, by_case, by_text), a < b: one row train, the other validation or test.

    Two rows pair up if they have the same case or the same article. Rows of
    other or no split, and articles without words, pair with nothing; copies
    are compared once a class and expanded at the end. A case or class that
    holds many rows of both sides has that many pairs; its rows are salted, so
    that no task makes them all.
    """
    rows = candidates.select(
        F.col("cand_id").cast("long").alias("cand_id"), _split_side(F.col("split")).alias("side"), F.lower(F.trim("split")).alias("split"), "source", case_key("case_id").alias("case_key"), "prompt"
    ).where("side is not null")
    rows = with_words(with_article(rows, "prompt", "article"), "article", "words")
    codes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("cand_id", "side", "split", "source", "case_key", F.when(F.size("words") > 0, codes).alias("codes"))
    rows = materialize(rows.withColumn("cls", F.when(F.col("codes").isNotNull(), F.xxhash64("codes"))), "overlap-rows")
    classes = materialize(
        rows.where("cls is not null").groupBy("cls").agg(F.any_value("codes").alias("codes"), F.max(F.col("side") == "t").alias("in_train"), F.max(F.col("side") == "e").alias("in_eval")), "overlap-classes"
    )
    matched = materialize(matching_classes(classes), "overlap-matches")
    members = rows.select("cand_id", "side", "cls")
    of_eval = members.where("side = 'e'").join(matched.withColumnRenamed("cls_e", "cls"), "cls").select(F.col("cand_id").alias("e"), "cls_t")
    by_text = salted_join(members.where("side = 't'").select(F.col("cand_id").alias("t"), F.col("cls").alias("cls_t")), of_eval, ["cls_t"], spread=F.col("t")).select("t", "e")
    cases = rows.where("case_key is not null").select("cand_id", "side", "case_key")
    of_case = cases.where("side = 'e'").select(F.col("cand_id").alias("e"), "case_key")
    by_case = salted_join(cases.where("side = 't'").select(F.col("cand_id").alias("t"), "case_key"), of_case, ["case_key"], spread=F.col("t")).select("t", "e")
    both = by_text.select("t", "e", F.lit(True).alias("x"), F.lit(False).alias("c")).unionByName(by_case.select("t", "e", F.lit(False).alias("x"), F.lit(True).alias("c")))
    pairs = both.groupBy("t", "e").agg(F.max("c").alias("by_case"), F.max("x").alias("by_text"))
    info = rows.select("cand_id", "split", "source")
    full = pairs.join(info.select(F.col("cand_id").alias("t"), F.col("source").alias("source_t")), "t").join(info.select(F.col("cand_id").alias("e"), "split", F.col("source").alias("source_e")), "e")
    return full.select(F.least("t", "e").alias("cand_id_a"), F.greatest("t", "e").alias("cand_id_b"), "split", "source_t", "source_e", "by_case", "by_text")


def overlap_report(candidates: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_rows, n_by_case, n_by_text): overlaps by split and source of the evaluation row."""
    pairs = cross_split_pairs(candidates)
    return pairs.groupBy("split", F.col("source_e").alias("source")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("by_case").cast("long")).alias("n_by_case"), F.sum(F.col("by_text").cast("long")).alias("n_by_text")
    )
