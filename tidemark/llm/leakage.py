"""Held-out passages inside a corpus, by a positional inverted index.

Terms are pairs of neighbouring words. Each passage is cut into blocks of
``BLOCK`` words; the anchor of a block is the term within it that is rarest in
the whole corpus. The index stores the positions of all terms of all documents
and is kept for other items. A position less the anchor's offset in its passage says where the
passage would begin; where enough anchors of one passage agree on that, the
document is a candidate, whose words are then compared with those of the
passage.

No leak is lost. ``RUN`` unchanged words in a row hold at least two whole blocks,
hence two anchors that agree exactly. A whole passage with one word in
``CHANGED`` replaced keeps all anchors but one for each change, as terms don't
reach across blocks; inserted or dropped words shift the rest by no more than
the number of changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import words_of
from tidemark.plans.scratch import Folder, materialize, scratch_path
from tidemark.plans.skew import bounded_join

#: Fewest unchanged words in a row that count as a leak.
RUN = 20
#: Of this many words one may be changed where the whole passage is there.
CHANGED = 9
#: Words of a passage that share an anchor; 2 * BLOCK + BLOCK - 1 <= RUN.
BLOCK = 7


def _terms(words: Column) -> Column:
    """Hashes of all pairs of neighbouring words."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def passage_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_words, offset, term) of all passages; terms that reach across blocks are left out."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words"))
    terms = words.select("item_id", F.size("words").alias("n_words"), F.posexplode(_terms(F.col("words"))).alias("offset", "term"))
    return terms.where(F.col("offset") % BLOCK < BLOCK - 1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted index of each batch of documents (doc_id, terms): (term, docs, positions), sorted by term."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        terms = lists.flatten().to_numpy()
        docs = np.repeat(ids, lengths)
        positions = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, dtype=np.int64)
        bounds = pa.array(np.r_[starts, len(terms)].astype(np.int32))
        posted = [pa.ListArray.from_arrays(bounds, pa.array(values[order])) for values in (docs.astype(np.int64), positions.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(terms[starts]), *posted], names=["term", "docs", "positions"])


class CorpusIndex:
    """Stored positional inverted index of a corpus: (term, docs, positions), in segments of documents, sorted by term in each.

    It holds every term of every document, so any items can be looked up in it
    later: they only read it. Segments are made where the documents are, without
    a shuffle; ``add`` puts more documents in. A segment counts once it is
    complete. The folder is ``path``, else the one that the session names in
    ``spark.tidemark.postings.dir``, else one of its own.
    """

    SCHEMA = "term long, docs array<long>, positions array<int>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.folder = Folder(spark, path or spark.conf.get("spark.tidemark.postings.dir", None) or scratch_path(spark, "postings"))

    def _complete(self) -> list[str]:
        return [n for n in self.folder.names() if "_SUCCESS" in self.folder.names(n)]

    def add(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> None:
        """Index ``documents``; a ``name`` that is complete already is not indexed again."""
        name = name or f"part-{uuid.uuid4().hex}"
        if name in self._complete():
            return
        worded = documents.select(F.col(doc_id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words")).where("doc_id is not null")
        worded.select("doc_id", _terms(F.col("words")).alias("terms")).mapInArrow(_segments, self.SCHEMA).write.mode("overwrite").parquet(f"{self.folder.path}/{name}")

    def rows(self, terms: DataFrame) -> DataFrame:
        """Index rows of ``terms``."""
        parts = [f"{self.folder.path}/{n}" for n in self._complete()]
        index = self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return bounded_join(index, terms.select("term").distinct(), ["term"], "left_semi")

    def counts(self, terms: DataFrame) -> DataFrame:
        """(term, n): how often each of ``terms`` occurs in the corpus; none where it doesn't."""
        return self.rows(terms).groupBy("term").agg(F.sum(F.size("positions")).alias("n"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, pos) of every occurrence of ``terms``."""
        return self.rows(terms).select("term", F.explode(F.arrays_zip("docs", "positions")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.positions").alias("pos"))


def anchors_of(passages: DataFrame, index: CorpusIndex) -> DataFrame:
    """(item_id, n_words, offset, term): for each block of each passage its term with the fewest occurrences in the corpus."""
    rated = passages.join(index.counts(passages), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item_id", F.floor(F.col("offset") / BLOCK)).orderBy("n", "term", "offset"))
    return rated.withColumn("rank", rank).where("rank = 1").select("item_id", "n_words", "offset", "term")


def candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, item_id) where enough anchors of a passage agree on its place.

    Two on exactly one place tell a run of words; for the whole passage, those
    left after all changes that it may have lie in a slot. Slots overlap and are
    twice as wide as the largest shift, so any two places that differ by no more
    than that share one.
    """
    changes = F.floor(F.col("n_words") / CHANGED)
    per_item = anchors.groupBy("item_id", "n_words").agg(F.count(F.lit(1)).alias("n_anchors"))
    per_item = per_item.select("item_id", F.greatest(F.lit(1), F.col("n_anchors") - changes).alias("needed"), F.greatest(F.lit(1), changes).alias("shift"))
    keyed = anchors.select("item_id", "offset", "term").join(per_item, "item_id")
    hits = bounded_join(postings, keyed, ["term"], "inner", spread=F.col("doc_id"))
    places = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("offset")).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"), F.max("shift").alias("shift"))
    slot = F.floor(F.col("place") / F.col("shift")).cast("long")
    exact = F.when(F.col("n") >= 2, F.lit(True))
    spread = places.select("doc_id", "item_id", "n", "needed", exact.alias("exact"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    agreed = spread.groupBy("doc_id", "item_id", "slot").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"), F.max("exact").alias("exact"))
    return agreed.where("n >= needed or exact").select("doc_id", "item_id").distinct()


def _changes(item: np.ndarray, doc: np.ndarray) -> int:
    """Fewest changed, added or dropped words that turn ``item`` into some stretch of ``doc``."""
    steps = np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (doc != word))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def leaks(item: list[str], body: str) -> bool:
    """Whether ``body``, words with a blank before and after each, holds ``RUN`` words of ``item`` in a row, or all of it with few changes."""
    n = len(item)
    if n == 0 or not body.strip():
        return False
    if any(" " + " ".join(item[i : i + RUN]) + " " in body for i in range(n - RUN + 1)):
        return True
    allowed = n // CHANGED
    doc = body.split()
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    coded = np.fromiter((ids.get(w, -1) for w in doc), dtype=np.int64, count=len(doc))
    known = coded[coded >= 0]
    if len(known) < n - allowed or len(np.unique(known)) < len(ids) - allowed:
        return False
    return _changes(np.fromiter((ids[w] for w in item), dtype=np.int64, count=n), coded) <= allowed


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [leaks(i.split(), " " + d + " ") for i, d in zip(pdf["item_body"], pdf["doc_body"])]
        yield pdf.loc[keep, ["doc_id", "item_id"]]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", index: CorpusIndex | None = None) -> DataFrame:
    """(doc_id, item_id) of every document that contains a passage, wholly or in good part.

    That is ``RUN`` consecutive words of it unchanged, or all of it with at most
    one word in ``CHANGED`` changed; case, punctuation, spacing and markup don't
    count. Null or empty texts contain nothing and leak nowhere, nor do
    passages of a single word. Rows with one id are matched each for itself and
    reported once. An ``index`` that has these documents is only read; without
    one it is made first.
    """
    if index is None:
        index = CorpusIndex(documents.sparkSession)
        index.add(documents, doc_id, text)
    passages = materialize(passage_terms(items, item_id, text), "passages")
    anchors = materialize(anchors_of(passages, index), "anchors")
    pairs = materialize(candidates(index.postings(anchors), anchors), "leak-pairs")
    body = lambda c: F.array_join(words_of(F.col(c)), " ")
    asked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).join(pairs, "doc_id").select("doc_id", "item_id", body("__text").alias("doc_body"))
    bodies = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("__text")).select("item_id", body("__text").alias("item_body"))
    joined = bounded_join(asked, bodies, ["item_id"], "inner", spread=F.col("doc_id"))
    return joined.select("doc_id", "item_id", "doc_body", "item_body").mapInPandas(_verify, "doc_id long, item_id long").distinct()
