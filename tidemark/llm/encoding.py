"""Text that was decoded with the wrong character encoding, and its restoration.

Each blank-separated token with signs outside ASCII is read as a byte lattice:
a run of its characters is turned back into bytes by one of several encodings
and the bytes are decoded as UTF-8, once or several times over; or single bytes
of a Western encoding are read again as what they were. A lost byte (U+FFFD) is a
wildcard: within a UTF-8 sequence it makes the whole sequence one, and a run of r
wildcards stands for one to r signs outside ASCII. The words of the corpus that
fit the letters around the wildcards are readings of the token too. Each reading
costs the negative logarithm of the corpus frequency of its word and of its
signs. A Viterbi search over the tokens of a text picks the cheapest sequence of
readings, where changing the encoding from one token to the next costs extra,
since damage comes in stretches.

Which word fits a wildcard best is decided by how often it occurs, and how often
beside the same neighbours. Where fewer than ``EVIDENCE`` letters are left, only a
word that the corpus has beside one of them is taken; otherwise the mark stays. A
word of which no letter is left, however long, is looked up by its neighbours alone.

Frequencies are counts over the whole corpus. Sign frequencies are few (at most
the signs of Unicode). Word frequencies are joined to the readings that need
them and are never held in one place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import materialize
from tidemark.plans.skew import bounded_join, salted_join

#: Encodings by which UTF-8 bytes may have been read, and by which Western single bytes may have been.
WRONG = ["latin-1", "cp1252", "cp1251", "cp437", "mac_roman", "cp850", "cp1250", "cp1254", "koi8-r", "cp866", "iso8859-15", "cp1253"]
#: Encodings that single bytes may have had before.
WESTERN = ["cp1252"]
#: How often in a row UTF-8 may have been misread.
DEPTH = 3
LOST = "�"
#: Cost of one step of repair, of a step another than that of the token before, and of a sign never seen.
STEP_COST = 2.0
SWITCH_COST = 3.0
UNSEEN = 0.02
#: Letters of a word with lost signs that tell it without its neighbours, and how many times more a neighbour tells than the word's own frequency.
EVIDENCE = 2
NEIGHBOUR_WEIGHT = 2.0
#: Weight of a word's cost beside that of its signs, which are part of it.
WORD_WEIGHT = 0.5

_BLANK = re.compile(r"([ \t\r\n]+)")
#: Letters with whatever signs outside ASCII stand among them: a garbled word holds such signs. An apostrophe parts words.
_WORD = re.compile(r"[^\W\d_](?:(?:[^\x00-\x7f’]|[^\W\d_])*(?:[^\W\d_]|[̀-ͯऀ-ॿ‌‍]))?")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_LETTER = r"(?:[^\W\d_]|[̀-ͯऀ-ॿ‌‍])"
_LOST_WORD = re.compile(rf"{_LETTER}*(?:{LOST}+{_LETTER}*)+")
_PLAIN_WORD = re.compile(rf"[^\W\d_]{_LETTER}*")


@lru_cache(maxsize=None)
def _to_byte(codec: str) -> dict[str, int]:
    """Sign to byte of ``codec``; bytes without a sign stand for the control sign of that number, as browsers read them."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    if codec.startswith("cp125") or codec.startswith("iso"):
        for b in range(128, 160):
            if b not in table.values():
                table[chr(b)] = b
    return table


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern | None:
    """Pattern of the signs of ``codec`` whose bytes form one UTF-8 sequence."""
    signs = lambda low, high: "".join(re.escape(ch) for ch, b in _to_byte(codec).items() if low <= b <= high)
    more = f"[{signs(0x80, 0xBF)}]" if signs(0x80, 0xBF) else ""
    leads = [(signs(0xC2, 0xDF), 1), (signs(0xE0, 0xEF), 2), (signs(0xF0, 0xF4), 3)]
    parts = [f"[{lead}]{more}{{{k}}}" for lead, k in leads if lead and more]
    return re.compile("|".join(parts)) if parts else None


@lru_cache(maxsize=None)
def _broken(codec: str) -> re.Pattern | None:
    """Pattern of the signs of ``codec`` whose bytes form one UTF-8 sequence of which bytes after the first are lost."""
    signs = lambda low, high: "".join(re.escape(ch) for ch, b in _to_byte(codec).items() if low <= b <= high)
    more = f"[{signs(0x80, 0xBF)}{LOST}]"
    leads = [(signs(0xC2, 0xDF), 1), (signs(0xE0, 0xEF), 2), (signs(0xF0, 0xF4), 3)]
    parts = [f"[{lead}](?={more}{{0,{k - 1}}}{LOST}){more}{{{k}}}" for lead, k in leads if lead]
    return re.compile("|".join(parts)) if parts else None


def decode_once(token: str, codec: str) -> tuple[str, int]:
    """``token`` with each UTF-8 sequence of its ``codec`` bytes decoded, one with lost bytes to one wildcard, and the number of sequences."""
    pattern, table, done = _sequences(codec), _to_byte(codec), 0

    def decoded(m: re.Match) -> str:
        nonlocal done
        try:
            sign = bytes(table[ch] for ch in m.group(0)).decode("utf-8")
        except UnicodeDecodeError:
            return m.group(0)
        done += 1
        return sign

    if pattern is not None and pattern.search(token):
        token = pattern.sub(decoded, token)
    if LOST in token and (broken := _broken(codec)) is not None:
        token, n = broken.subn(LOST, token)
        done += n
    return token, done


def reread(token: str, codec: str, western: str) -> str | None:
    """``token`` with its ``codec`` bytes read as ``western``; None where a sign has no such byte."""
    table, out = _to_byte(codec), []
    for ch in token:
        if ch <= "\x7f":
            out.append(ch)
            continue
        b = table.get(ch)
        if b is None:
            return None
        try:
            out.append(bytes([b]).decode(western))
        except UnicodeDecodeError:
            return None
    return "".join(out)


@lru_cache(maxsize=50_000)
def readings(token: str) -> dict[str, str]:
    """Reading of ``token`` by the way it is reached; ``""`` is the token as it stands."""
    found = {"": token}
    if not _NON_ASCII.search(token):
        return found
    seen, front = {token}, [("", token)]
    for _ in range(DEPTH):
        grown = []
        for way, text in front:
            for codec in WRONG:
                better, done = decode_once(text, codec)
                if done and better not in seen:
                    seen.add(better)
                    label = f"{way}>{codec}" if way else codec
                    found[label] = better
                    grown.append((label, better))
        front = grown
    if LOST not in token:
        for codec in WRONG[2:6]:
            for western in WESTERN:
                other = reread(token, codec, western)
                if other is not None and other not in seen and other != token:
                    seen.add(other)
                    found[f"{codec}={western}"] = other
    return found


def words_in(token: str) -> list[str]:
    """Lower-case words of ``token`` with a sign outside ASCII: those whose frequency tells readings apart."""
    return [w.lower() for w in _WORD.findall(token) if _NON_ASCII.search(w)]


def lost_words(token: str) -> list[str]:
    """Lower-case words of ``token`` with lost signs, marks and all."""
    return [w.lower() for w in _LOST_WORD.findall(token)]


def known_letters(pattern: str) -> int:
    return sum(ch != LOST for ch in pattern)


def pattern_regex(pattern: str) -> str:
    """Regular expression of the words that fit: a run of r lost signs is one to r signs outside ASCII."""
    return "^" + re.sub(f"{LOST}+", lambda m: rf"[^\x00-\x7f]{{1,{len(m.group(0))}}}", pattern) + "$"


def pattern_keys(pattern: str) -> list[tuple[str, str, int]]:
    """(side, affix, length): the longer of the letters before the first and after the last lost sign, with each length that a fitting word can have."""
    first, last = pattern.index(LOST), pattern.rindex(LOST)
    before, after = pattern[:first], pattern[last + 1 :]
    side, affix = ("p", before) if len(before) >= len(after) else ("s", after)
    return [(side, affix, n) for n in range(known_letters(pattern) + len(re.findall(f"{LOST}+", pattern)), len(pattern) + 1)]


def neighbours(tokens: list[str], k: int) -> tuple[str, str]:
    """The whole lower-case words before and after token ``k`` of blank-separated ``tokens``; empty where there is none or it has lost signs."""
    def word(at: int, which: int) -> str:
        if not 0 <= at < len(tokens) or LOST in tokens[at]:
            return ""
        found = _PLAIN_WORD.findall(tokens[at])
        return found[which].lower() if found else ""

    return word(k - 2, -1), word(k + 2, 0)


class Costs:
    """Costs of readings under the frequencies of a corpus."""

    def __init__(self, signs: dict[str, int], words: dict[str, int], texts: int):
        self.words, self.texts = words, max(1, texts)
        self.signs = {ch: -math.log((n + UNSEEN) / self.texts) for ch, n in signs.items()}
        self.unseen = -math.log(UNSEEN / self.texts)

    def sign(self, ch: str) -> float:
        return self.signs.get(ch, self.unseen)

    def of(self, token: str) -> float:
        cost = sum(self.sign(ch) for ch in token if ch > "\x7f")
        for w in words_in(token):
            cost -= WORD_WEIGHT * math.log((self.words.get(w, 0) + UNSEEN) / self.texts)
        return cost


def fill_lost(token: str, left: str, right: str, fills: dict[tuple[str, str, str], str]) -> str:
    """``token`` with its words of lost signs replaced by what ``fills`` has for them between these neighbours."""

    def best(m: re.Match) -> str:
        word = m.group(0)
        known = fills.get((word.lower(), left, right))
        if known is None:
            return word
        return known.upper() if word.upper() == word and known_letters(word) > 1 else known.capitalize() if word[:1].isupper() else known

    return _LOST_WORD.sub(best, token)


def restore(text: str, costs: Costs, fills: dict[tuple[str, str, str], str] | None = None) -> tuple[str, int, bool]:
    """Restored ``text``, the number of tokens changed, and whether signs were lost for good.

    Viterbi over the tokens: a state is the way by which a token is read.
    """
    tokens = _BLANK.split(text)
    # ASCII tokens fit any way, so only the others are stages of the search.
    stages = [k for k, t in enumerate(tokens) if _NON_ASCII.search(t)]
    best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
    for k in stages:
        options = readings(tokens[k])
        if fills and LOST in tokens[k]:
            around = neighbours(tokens, k)
            # A word that fits a wildcard is a reading by the same way.
            options = {way: fill_lost(t, *around, fills) if LOST in t else t for way, t in options.items()}
        cheapest = min(best.values(), key=lambda x: x[0])
        grown: dict[str, tuple[float, tuple]] = {}
        for way, text_k in options.items():
            steps = 0 if not way else way.count(">") + 1
            own = costs.of(text_k) + STEP_COST * steps
            stay = best.get(way)
            change = cheapest[0] + SWITCH_COST
            if stay is not None and stay[0] <= change:
                grown[way] = (stay[0] + own, (stay[1], k, text_k))
            else:
                grown[way] = (change + own, (cheapest[1], k, text_k))
        best = grown
    _, path = min(best.values(), key=lambda x: x[0])
    changed, lost = 0, LOST in text
    while path:
        path, k, text_k = path
        if text_k != tokens[k]:
            changed += 1
        tokens[k] = text_k
    return "".join(tokens), changed, lost


def sign_counts(documents: DataFrame, text: str) -> DataFrame:
    """(sign, n): in how many texts each sign outside ASCII occurs."""
    signs = F.array_distinct(F.split(F.regexp_replace(F.col(text), r"[\x00-\x7F]+", ""), ""))
    return documents.select(F.explode(signs).alias("sign")).where("sign != ''").groupBy("sign").agg(F.count(F.lit(1)).alias("n"))


#: Letters of a word for Spark's patterns.
_LETTERS = r"[\p{L}̀-ͯऀ-ॿ‌‍]"


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """(word, n): in how many texts each lower-case word with a sign outside ASCII occurs."""
    chunks = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(\p{{L}}{_LETTERS}*)"), F.lit(1))
    words = F.array_distinct(F.filter(chunks, lambda w: w.rlike(r"[^\x00-\x7F]")))
    return documents.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fitting_words(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern, known, word, n): the corpus words that fit each of ``patterns`` (pattern, known, regex, keys).

    Words are looked up by their beginning or end and their length, whatever the
    script, and then tested.
    """
    wanted = patterns.select("pattern", "known", "regex", F.explode("keys").alias("k")).select("pattern", "known", "regex", "k.*")
    n = F.length("word")
    whole = counts.where(~F.col("word").contains(LOST))
    affix = lambda side, cut: F.transform(F.sequence(F.lit(0), n - 1), lambda m: F.struct(F.lit(side).alias("side"), cut(m).alias("affix"), n.alias("length")))
    keys = F.concat(affix("p", lambda m: F.substring("word", F.lit(1), m)), affix("s", lambda m: F.substring("word", n - m + 1, m)))
    offered = whole.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    met = salted_join(offered, wanted, ["side", "affix", "length"], spread=F.col("word"))
    return met.where(F.regexp_like("word", F.col("regex"))).select("pattern", "known", "word", "n").distinct()


def neighbour_counts(documents: DataFrame, text: str, words: DataFrame, places: DataFrame) -> DataFrame:
    """(word, side, other, m): in how many places the word ``other`` stands before ("l") or after ("r") a word.

    Counted for each of ``words``, and beside each of ``places`` (side, other) for every word without a sign of ASCII.
    """
    chunks = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(\p{{L}}{_LETTERS}*)"), F.lit(1))
    listed = documents.select(chunks.alias("w"))
    around = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get("w", i - 1)).alias("l"), F.get("w", i + 1).alias("r")))
    each = listed.select(F.explode(F.filter(around, lambda s: s["word"].rlike(r"[^\x00-\x7F]"))).alias("s")).select("s.*")
    marked = bounded_join(each, words.withColumn("fits", F.lit(True)), ["word"], "left").where(F.col("fits") | _wholly("word"))
    pairs = marked.select("word", "fits", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("other")), F.struct(F.lit("r").alias("side"), F.col("r").alias("other")))).alias("o")).select("word", "fits", "o.*")
    asked = bounded_join(pairs.where("other is not null"), places.withColumn("asked", F.lit(True)), ["side", "other"], "left")
    return asked.where(F.col("fits") | (F.col("asked") & _wholly("word"))).groupBy("word", "side", "other").agg(F.count(F.lit(1)).alias("m"))


def _wholly(word: str):
    """Whether ``word`` has no sign of ASCII."""
    return ~F.col(word).rlike(r"[\x00-\x7F]")


def _score(n: str, seen):
    return F.log(F.col(n) + 1.0) + NEIGHBOUR_WEIGHT * F.log(1.0 + seen)


def _sides(places: DataFrame, *kept: str) -> DataFrame:
    """``kept`` of ``places`` (left, right) with (side, other, far), once for each neighbour that there is; ``far`` is the one at the other side."""
    at = lambda s, near, far: F.struct(F.lit(s).alias("side"), F.col(near).alias("other"), F.col(far).alias("far"))
    return places.select(*kept, F.explode(F.array(at("l", "left", "right"), at("r", "right", "left"))).alias("o")).select(*kept, "o.*").where("other != ''")


def bare_fills(bare: DataFrame, counts: DataFrame, beside: DataFrame) -> DataFrame:
    """(pattern, left, right, fill, n): the word for each of ``bare`` (pattern, left, right), of which no letter is left.

    A lost sign leaves one mark, or up to one for each of its bytes. Of the words
    without ASCII that ``beside`` has at one of the neighbours and that can have left
    so many marks, the best with just as many signs or bytes, else the best of all. A
    word that stands beside both neighbours is found from the neighbour with fewer
    words, any other from its one neighbour; of each size only the best meets the marks.
    """
    near = beside.where(_wholly("word")).join(counts, "word").select("side", "other", "word", "m", "n", F.length("word").alias("signs"), F.octet_length("word").alias("bytes"))
    near = materialize(near, "bare-neighbours")
    place, marks = ["pattern", "left", "right"], F.length("pattern")

    def best(fits: DataFrame, asked: DataFrame, keys: list[str], seen) -> DataFrame:
        """The best of ``fits`` by each of ``asked`` (pattern, left, right, keys), of all that ``keys`` share."""
        by_size = fits.groupBy(*keys, "signs", "bytes").agg(F.max(F.struct(_score("n", seen).alias("score"), "n", "word")).alias("x"))
        met = asked.join(by_size, keys).where((F.col("signs") <= marks) & (marks <= F.col("bytes")))
        whole = (F.col("signs") == marks) | (F.col("bytes") == marks)
        return met.select(*place, F.struct(whole.alias("whole"), "x.score", "x.n", "x.word").alias("x"))

    by_one = best(near, _sides(bare, *place), ["side", "other"], F.col("m"))

    n_words = near.groupBy("side", "other").agg(F.count(F.lit(1)).alias("words"))
    pairs = _sides(bare.where("left != '' and right != ''").select("left", "right").distinct(), "left", "right").join(n_words, ["side", "other"])
    fewer = pairs.groupBy("left", "right").agg(F.min(F.struct("words", "side", "other", "far")).alias("o"), F.count(F.lit(1)).alias("known")).where("known = 2").select("left", "right", "o.side", "o.other", "o.far")
    there = near.select(F.when(F.col("side") == "l", "r").otherwise("l").alias("side"), F.col("other").alias("far"), "word", F.col("m").alias("m_far"))
    both = fewer.join(near, ["side", "other"]).join(there, ["side", "far", "word"])
    by_both = best(both, bare.select(*place), ["left", "right"], F.col("m") + F.col("m_far"))

    found = by_one.unionByName(by_both).groupBy(*place).agg(F.max("x").alias("x"))
    return materialize(found.select(*place, F.col("x.word").alias("fill"), F.col("x.n").alias("n")), "bare-fills")


def best_fills(lost: DataFrame, counts: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """(pattern, left, right, fill, n): the word for each of ``lost`` (pattern, left, right, known, regex, keys) that has evidence."""
    asked = lost.groupBy("pattern", "left", "right").agg(F.any_value("known").alias("known"), F.any_value("regex").alias("regex"), F.any_value("keys").alias("keys"))
    asked = materialize(asked, "lost-words")
    bare, lettered = asked.where("known = 0"), asked.where("known > 0")
    patterns = lettered.groupBy("pattern").agg(F.any_value("known").alias("known"), F.any_value("regex").alias("regex"), F.any_value("keys").alias("keys"))
    fitting = materialize(fitting_words(patterns, counts), "fitting-words")
    places = _sides(bare).select("side", "other").distinct()
    beside = materialize(neighbour_counts(documents, text, fitting.select("word").distinct(), places), "neighbours")
    tried = salted_join(lettered.select("pattern", "left", "right"), fitting, ["pattern"])
    side = lambda s, name: beside.where(F.col("side") == s).select("word", F.col("other").alias(name), F.col("m").alias(f"m_{name}"))
    tried = tried.join(side("l", "left"), ["word", "left"], "left").join(side("r", "right"), ["word", "right"], "left")
    seen = F.coalesce("m_left", F.lit(0)) + F.coalesce("m_right", F.lit(0))
    tried = tried.where((F.col("known") >= EVIDENCE) | (seen > 0)).withColumn("score", _score("n", seen))
    filled = tried.groupBy("pattern", "left", "right").agg(F.max(F.struct("score", "n", "word")).alias("x")).select("pattern", "left", "right", F.col("x.word").alias("fill"), F.col("x.n").alias("n"))
    return filled.unionByName(bare_fills(bare, counts, beside))


#: A word with lost signs at its place, with what it is looked up by.
_PLACE = "struct<pattern:string,left:string,right:string,known:int,regex:string,keys:array<struct<side:string,affix:string,length:int>>>"


def _suspects(signs: dict[str, int], texts: int):
    """Which tokens of each text may be damaged, with all words of their readings."""
    costs = Costs(signs, {}, texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[bool, list[str]]] = {}
        for pdf in batches:
            ids, needed, gone = [], [], []
            for row, text in zip(pdf["row_id"], pdf["text"]):
                words: set[str] = set()
                lost: dict[tuple, dict] = {}
                suspect = LOST in text
                tokens = _BLANK.split(text)
                for k, token in enumerate(tokens):
                    if not _NON_ASCII.search(token):
                        continue
                    if token not in known:
                        if len(known) > 100_000:
                            known.clear()
                        options = readings(token)
                        plain = sum(costs.sign(ch) for ch in token if ch > "\x7f")
                        odd = any(sum(costs.sign(ch) for ch in t if ch > "\x7f") <= plain for way, t in options.items() if way)
                        known[token] = (odd, sorted({w for t in options.values() for w in words_in(t)}))
                    odd, own = known[token]
                    suspect |= odd
                    words.update(own)
                    if LOST in token:
                        around = neighbours(tokens, k)
                        for pattern in {w for t in readings(token).values() for w in lost_words(t)}:
                            # Without letters a word is looked up by its neighbours.
                            keys = [{"side": a, "affix": b, "length": c} for a, b, c in pattern_keys(pattern)] if known_letters(pattern) else []
                            lost[pattern, *around] = {"pattern": pattern, "left": around[0], "right": around[1], "known": known_letters(pattern), "regex": pattern_regex(pattern), "keys": keys}
                if suspect:
                    ids.append(row)
                    needed.append(sorted(words))
                    gone.append(list(lost.values()))
            yield pd.DataFrame({"row_id": pd.Series(ids, dtype="int64"), "words": needed, "lost": gone})

    return run


def _restorer(signs: dict[str, int], texts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = Costs(signs, {}, texts)
        for pdf in batches:
            rows = []
            for row, text, words, counts, fills in zip(pdf["row_id"], pdf["text"], pdf["words"], pdf["counts"], pdf["fills"]):
                costs.words = dict(zip(words, counts)) if words is not None else {}
                by_place = {(f["pattern"], f["left"], f["right"]): f["fill"] for f in fills} if fills is not None else {}
                costs.words |= {f["fill"]: f["n"] for f in fills} if fills is not None else {}
                restored, changed, lost = restore(text, costs, by_place)
                if changed or lost:
                    rows.append((row, restored, changed, lost))
            yield pd.DataFrame(rows, columns=["row_id", "restored", "changed", "lost"])

    return run


def restored_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, changed_tokens, lost) of every document with garbled text.

    ``lost`` marks documents where signs are gone; there ``restored`` holds the
    words of the corpus that fit what is left, where there is evidence for one,
    and the marks elsewhere. Null and empty texts are never garbled. ``doc_id``
    is unique.
    """
    narrow = documents.select(F.col(doc_id).cast("long").alias("row_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    # Bounded by the number of signs in Unicode.
    signs = {r["sign"]: r["n"] for r in sign_counts(narrow, "text").collect()}
    texts = max(1, max(signs.values(), default=1))
    suspects = materialize(narrow.mapInPandas(_suspects(signs, texts), f"row_id long, words array<string>, lost array<{_PLACE}>"), "garbled")

    counts = materialize(word_counts(narrow, "text"), "word-counts")
    needed = suspects.select("row_id", F.explode("words").alias("word"))
    frequency = counts.join(needed.select("word").distinct(), "word", "left_semi")
    by_row = salted_join(needed, frequency, ["word"], spread=F.col("row_id")).groupBy("row_id").agg(F.collect_list(F.struct("word", "n")).alias("w"))

    lost = suspects.select("row_id", F.explode("lost").alias("p")).select("row_id", "p.*")
    fills = best_fills(lost, counts, narrow, "text")
    place = ["pattern", "left", "right"]
    fill_by_row = salted_join(lost.select("row_id", *place), fills, place, spread=F.col("row_id")).groupBy("row_id").agg(F.collect_list(F.struct(*place, "fill", "n")).alias("fills"))

    asked = narrow.join(suspects.select("row_id"), "row_id").join(by_row, "row_id", "left").join(fill_by_row, "row_id", "left")
    flat = asked.select("row_id", "text", F.col("w.word").alias("words"), F.col("w.n").alias("counts"), "fills")
    fixed = flat.mapInPandas(_restorer(signs, texts), "row_id long, restored string, changed long, lost boolean")
    return fixed.select(F.col("row_id").alias("doc_id"), "restored", F.col("changed").alias("changed_tokens"), "lost")
