"""Where an external text scorer plugs in: batches of texts go in, labels and signed scores come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], tuple[list[str], list[float]]]


def scored(text: Column, load: Callable[[], Scorer]) -> Column:
    """(label, score) of each text. ``load`` runs once a task; blank and null texts are neutral and never reach the scorer."""

    @F.pandas_udf("label string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for texts in batches:
            out = pd.DataFrame({"label": "neutral", "score": 0.0}, index=texts.index)
            real = texts.notna() & (texts.fillna("").str.strip() != "")
            if real.any():
                labels, values = scorer(list(texts[real]))
                out.loc[real, "label"] = labels
                out.loc[real, "score"] = [v if label == "positive" else -v if label == "negative" else 0.0 for label, v in zip(labels, values)]
            yield out

    return run(text)


def keyword_scorer(positive: list[str], negative: list[str]) -> Callable[[], Scorer]:
    """A scorer by counts of words, as a stand-in where no model is at hand."""

    def load() -> Scorer:
        def score(texts: list[str]) -> tuple[list[str], list[float]]:
            labels, values = [], []
            for t in texts:
                words = t.lower().split()
                p, n = sum(w in positive for w in words), sum(w in negative for w in words)
                labels.append("positive" if p > n else "negative" if n > p else "neutral")
                values.append(abs(p - n) / max(1, p + n))
            return labels, values

        return score

    return load


def difference_scorer(probabilities: Callable[[list[str]], list[dict[str, float]]]) -> Callable[[], Scorer]:
    """A scorer by the probability of positive less that of negative; the label is the likeliest class, and the sign is in the score."""

    def load() -> Scorer:
        def score(texts: list[str]) -> tuple[list[str], list[float]]:
            labels, values = [], []
            for p in probabilities(texts):
                difference = p.get("positive", 0.0) - p.get("negative", 0.0)
                # ``scored`` gives a negative label's score its sign.
                labels.append("positive" if difference > 0 else "negative" if difference < 0 else "neutral")
                values.append(abs(difference))
            return labels, values

        return score

    return load
