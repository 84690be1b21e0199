"""Texts that were cut off, told by how they end.

Most values are intact, so positives are made: values are cut inside a sentence
and a logistic regression over hashed features of the end learns to tell them
from values as they are. Features are closing words and characters, the shape of
the closing, open brackets and quotes, marks of a cut, and whether the length is
one at which suspiciously many values end. Given values that a model fitted on
other values takes for cut are left out of the last fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most values that the classifier is fitted on, chosen by the hash of their id. Scoring covers all values.
FIT_ROWS = 12_000
DIMENSIONS = 1 << 18
EPOCHS = 60
#: Fewest rows of a fit that a feature must have for a weight of its own.
SEEN = 5
#: A length is a limit if this share of all values has it, and so many times more than lengths nearby.
LIMIT_SHARE = 0.002
LIMIT_PEAK = 5.0

# Signs that end a sentence, what may follow them, and marks that someone put at a cut.
ENDERS = ".!?।…"
CLOSERS = "\"'”’»)]}*_`"
MARKS = ["[truncated]", "[cut]", "[cut", "[...]", "[…]", "(cut)", "(truncated)", "<truncated>", "[snip]", "(continued)", "...", "…"]
#: Share of the made cuts that get such a mark.
MARKED = 0.1

_MARK = re.compile(r"(?:\s*(?:\[(?:truncated|cut|snip|continued|\.\.\.|…)\]?|\((?:truncated|cut|continued)\)|<truncated>|…|\.\.\.))+\s*$", re.I)


def without_mark(text: str) -> tuple[str, bool]:
    """``text`` without outer blanks and without a closing mark of a cut, and whether there was one."""
    body = text.strip()
    m = _MARK.search(body)
    return (body[: m.start()].rstrip(), True) if m and m.start() else (body, False)


def ends_sentence(text: str) -> bool:
    """Whether ``text`` ends with a sentence's sign; a point between digits may be one."""
    core = text.rstrip(CLOSERS + " \t\r\n")
    return bool(core) and core[-1] in ENDERS


def _shape(token: str) -> str:
    return re.sub(r"[0-9]", "9", token)


def word_kind(word: str) -> str:
    """How a word is written: capitals, capitalised, small letters, digits, other; with the sign that it ends with, if any."""
    core = word.strip(ENDERS + CLOSERS + ",;:([{-–—")
    kind = "9" if re.search(r"\d", core) else "A" if len(core) > 1 and core.isupper() else "Aa" if core[:1].isupper() else "a" if core.isalpha() else "-"
    return kind + ("" if word[-1:].isalnum() else word[-1:])


def features(text: str, limits: frozenset[int] | set[int], length: int | None = None) -> list[str]:
    """Features of the end of ``text``; always as many, so that rows form a matrix."""
    length = len(text) if length is None else length
    body, marked = without_mark(text)
    tail = body[-120:]
    tokens = [_shape(t) for t in tail.split()[-5:]]
    tokens = ["<s>"] * (5 - len(tokens)) + tokens
    end = _shape(body[-8:])
    kinds = re.sub(r"[^\W\d_]", "a", re.sub(r"[^\W\d_a-z]", "A", end))
    last = re.split(r"(?<=[.!?।])\s+|\n", body)[-1]
    kind = word_kind(tokens[-1])
    open_round, open_quote = last.count("(") > last.count(")"), last.count('"') % 2 == 1
    return [
        "t1=" + tokens[-1],
        "t2=" + " ".join(tokens[-2:]),
        "t3=" + " ".join(tokens[-3:]),
        "t4=" + " ".join(tokens[-4:]),
        "c1=" + end[-1:],
        "c2=" + end[-2:],
        "c3=" + end[-3:],
        "c4=" + end[-4:],
        "c6=" + end[-6:],
        "k3=" + kinds[-3:],
        "k6=" + kinds[-6:],
        f"end={ends_sentence(body)}|{kind}",
        f"open={open_round}{open_quote}",
        f"mark={marked}",
        f"limit={length in limits}",
        f"kinds={word_kind(tokens[-3])}|{word_kind(tokens[-2])}|{kind}",
        f"words={min(len(last.split()), 12)}|{ends_sentence(body)}|{kind}",
        "bias",
    ]


def hashed(rows: list[list[str]]) -> np.ndarray:
    return np.array([[1 + zlib.crc32(f.encode()) % (DIMENSIONS - 1) for f in fs] for fs in rows], dtype=np.int64).reshape(len(rows), -1 if rows else 0)


def fit_logistic(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on rows of hashed features, by full-batch Adam.

    Features seen less than ``SEEN`` times have no weight and say nothing.
    """
    counts = np.bincount(x.ravel(), minlength=DIMENSIONS)
    rare = counts < SEEN
    x = np.where(rare[x], 0, x)
    w, m, v = (np.zeros(DIMENSIONS) for _ in range(3))
    for step in range(1, epochs + 1):
        w[0] = 0.0
        p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
        g = np.bincount(x.ravel(), weights=np.repeat((p - y) / len(y), x.shape[1]), minlength=DIMENSIONS) + l2 * w / len(y)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w[rare] = w[0] = 0.0
    return w


def cut_inside(text: str, at: int) -> str | None:
    """``text`` cut at ``at`` where that is inside a sentence, else None.

    A cut that takes only closing signs from the last sentence, or all after a
    sentence's end, leaves an intact value.
    """
    head, rest = text[:at].rstrip(), text[at:]
    if not head or not rest.strip() or not rest.strip(ENDERS + CLOSERS + " \n"):
        return None
    ended = ends_sentence(head) and (rest[:1].isspace() or text[len(head) : len(head) + 1].isspace())
    return None if ended else text[:at]


def made_examples(texts: list[str], limits: set[int], seed: int = 7, per_text: int = 6) -> list[str]:
    """Cut versions of ``texts``, each inside a sentence: a third anywhere, a third near the end, a third at limits of length; some with a mark of the cut."""
    rng = np.random.default_rng(seed)
    out = []
    at_limits = sorted(limits)
    for text in texts:
        n = len(text)
        if n < 20:
            continue
        fitting = [k for k in at_limits if 5 <= k < n]
        for k in range(per_text):
            if k % 3 == 2 and fitting:
                at = fitting[int(rng.integers(len(fitting)))]
            else:
                at = int(rng.integers(5 if k % 3 == 0 else max(5, n - 60), n))
            head = cut_inside(text, at)
            if head:
                out.append(head + ("" if rng.random() > MARKED else " " * int(rng.integers(2)) + MARKS[int(rng.integers(len(MARKS)))]))
    return out


def fit_cut_model(texts: list[str], limits: set[int], seed: int = 7) -> np.ndarray:
    """Weights for values like ``texts``, most of which are intact."""
    given = list(dict.fromkeys(t for t in texts if t and t.strip()))
    if not given:
        return np.zeros(DIMENSIONS)
    halves = [given[0::2], given[1::2]]
    made = [hashed([features(t, limits) for t in made_examples(h, limits, seed + k)]) for k, h in enumerate(halves)]
    whole = [hashed([features(t, limits) for t in h]) for h in halves]

    def fit(cut: list[np.ndarray], intact: list[np.ndarray]) -> np.ndarray:
        positive, negative = [p for p in cut if len(p)], [p for p in intact if len(p)]
        if not positive or not negative:
            return np.zeros(DIMENSIONS)
        x = np.concatenate(positive + negative)
        y = np.concatenate([np.ones(sum(map(len, positive))), np.zeros(sum(map(len, negative)))])
        return fit_logistic(x, y)

    # Each half is judged by a model that has not seen it, so that no cut value among the given ones is learnt by heart.
    for _ in range(2):
        models = [fit([made[k]], [whole[k]]) for k in (0, 1)]
        judged = [models[1 - k][whole[k]].sum(axis=1) < 0 if len(whole[k]) else np.zeros(0, dtype=bool) for k in (0, 1)]
        whole = [w[keep] for w, keep in zip(whole, judged)]
    return fit(made, whole)


def length_limits(values: DataFrame, text: str) -> set[int]:
    """Lengths at which suspiciously many values end; at most 1 / LIMIT_SHARE of them."""
    lengths = values.where(F.length(text) > 1).groupBy(F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    near = Window.orderBy("len").rangeBetween(-20, 20)
    total = F.sum("n").over(Window.partitionBy())
    around = lengths.select("len", "n", total.alias("total"), ((F.sum("n").over(near) - F.col("n")) / 40).alias("around"))
    spikes = around.where((F.col("n") > F.col("total") * LIMIT_SHARE) & (F.col("n") > F.col("around") * LIMIT_PEAK) & (F.col("n") > 3))
    return {r["len"] for r in spikes.select("len").collect()}


def _scorer(weights_bc, limits: frozenset[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights_bc.value
        for pdf in batches:
            score = w[hashed([features(t, limits) for t in pdf["text"]])].sum(axis=1) if len(pdf) else np.zeros(0)
            chance = 1 / (1 + np.exp(-score))
            yield pd.DataFrame({"row_id": pdf["row_id"], "chance": chance, "cut": chance > 0.5})

    return run


def truncation_scores(values: DataFrame, row_id: str, text: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(row_id, chance, cut) of every value that is not null or blank.

    ``chance`` is the fitted probability that the value was cut inside a
    sentence or word; ``cut`` the verdict. ``row_id`` is unique.
    """
    spark = values.sparkSession
    narrow = values.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")).where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    sample = [r["text"] for r in narrow.orderBy(F.xxhash64("row_id"), "row_id").limit(fit_rows).select("text").collect()]
    limits = length_limits(narrow, "text")
    weights = spark.sparkContext.broadcast(fit_cut_model(sample, limits).astype(np.float32))
    return narrow.mapInPandas(_scorer(weights, frozenset(limits)), "row_id long, chance double, cut boolean")


def truncation_rates(values: DataFrame, scores: DataFrame, row_id: str, source: str) -> DataFrame:
    """(source, n_values, n_cut, share_cut): how often each source truncates; a null source is one of its own."""
    joined = scores.join(values.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).alias("source")), "row_id")
    n_cut = F.sum(F.col("cut").cast("long"))
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_values"), n_cut.alias("n_cut"), F.round(n_cut / F.count(F.lit(1)), 6).alias("share_cut"))
