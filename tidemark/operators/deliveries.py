"""Exactly one copy of messages that were delivered at least once.

A store keeps, for each identifier, the winning delivery. It is a folder of
runs and of numbered manifests, the latest of which names the runs that count. A
run is bucketed by the hash of the identifier and sorted by it within each
bucket, one file a bucket. A batch first collapses to one row an identifier with
a map-side combine, so that an identifier that holds a third of all rows costs
one row a task, and is then written as one more run. Compaction merges runs two
by two: as both have the same buckets and order, Spark merges them file by file
in a sort-merge join without exchange or sort, in which equal identifiers
collapse to one. Upserts are idempotent: the winner is a minimum, so that a
batch delivered again, or a task run again, changes nothing.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import Folder, scratch_path


def message_key(case_id: str):
    """Identifier without case and outer blanks; null stays null."""
    return F.upper(F.regexp_replace(F.col(case_id), r"(?U)^\s+|\s+$", ""))


def _order(delivered_at: Column, msg_id: Column) -> Column:
    """What the first delivery is the minimum of; null times come last."""
    return F.struct(delivered_at.isNull().alias("late"), delivered_at.alias("delivered_at"), msg_id.alias("msg_id"))


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made within trust the order of bucket files, and their number is not changed by coalescing."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class DeliveryStore:
    """Hash-bucketed, sorted storage of the first delivery of each identifier.

    A store opened at the path of another goes on with its runs. ``buckets`` is
    fixed when a store is made. One writer at a time: a manifest is committed by
    renaming, and two that make the same number can't both succeed.
    """

    SCHEMA = "key string, delivered_at timestamp, msg_id long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = Folder(spark, path or scratch_path(spark, "deliveries"))
        manifests = sorted(n for n in self.folder.names() if n.startswith("manifest-"))
        state = json.loads(self.folder.read_text(manifests[-1])) if manifests else {}
        self.version = int(manifests[-1].split("-")[1]) if manifests else 0
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = state.get("runs", [])
        self.batches: list[str] = state.get("batches", [])

    def _commit(self, runs: list[str], batches: list[str]) -> None:
        self.version += 1
        self.folder.write_text(f"manifest-{self.version:08d}", json.dumps({"buckets": self.buckets, "runs": runs, "batches": batches}))
        self.runs, self.batches = runs, batches

    def _table(self, run: str) -> DataFrame:
        """The run as a bucketed and sorted table; its definition is made anew in each session."""
        name = "deliveries_" + hashlib.md5(f"{self.folder.path}/{run}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder.path}/{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, run: str, by: list[str] = ()) -> None:
        """Write ``rows``, whose tasks hold whole buckets, as bucket files in order of the key; a subfolder for each value of ``by``."""
        name = f"deliveries_writing_{hashlib.md5(f'{self.folder.path}/{run}'.encode()).hexdigest()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder.path}/{run}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def upsert(self, batch: DataFrame, case_id: str = "case_id", batch_id: str | None = None, cut: object = None) -> None:
        """Add ``batch`` (case_id, delivered_at, msg_id) as one more sorted run. Rows without identifier are left out.

        A ``batch_id`` that was added before is not added again. With the instant
        ``cut``, what was delivered before it and what came later are written
        as two runs, in one pass over the batch.
        """
        if batch_id is not None and batch_id in self.batches:
            return
        rows = batch.select(message_key(case_id).alias("key"), F.col("delivered_at").cast("timestamp").alias("delivered_at"), F.col("msg_id").cast("long").alias("msg_id")).where("key is not null")
        late = F.lit(False) if cut is None else ~F.coalesce(F.col("delivered_at") < F.lit(cut), F.lit(False))
        order = _order(F.col("delivered_at"), F.col("msg_id"))
        first = rows.groupBy("key").agg(F.min(F.when(~late, order)).alias("e"), F.min(F.when(late, order)).alias("l"))
        each = first.select("key", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("e").alias("x")), F.struct(F.lit(1).alias("part"), F.col("l").alias("x")))).alias("p")).where("p.x is not null")
        each = each.select("key", F.col("p.x.delivered_at").alias("delivered_at"), F.col("p.x.msg_id").alias("msg_id"), F.col("p.part").alias("part"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            each = each.repartition(self.buckets, "key")
        run = f"run-{self.version + 1:08d}"
        self._write(each, run, ["part"])
        parts = [f"{run}/{n}" for n in self.folder.names(run) if n.startswith("part=")]
        self._commit([*self.runs, *sorted(parts)], [*self.batches, *([batch_id] if batch_id is not None else [])])

    def _merged(self, a: str, b: str) -> DataFrame:
        left, right = self._table(a).alias("a"), self._table(b).alias("b")
        side = lambda s: F.when(F.col(f"{s}.key").isNotNull(), _order(F.col(f"{s}.delivered_at"), F.col(f"{s}.msg_id")))
        joined = left.join(right, F.col("a.key") == F.col("b.key"), "full")
        return joined.select(F.coalesce("a.key", "b.key").alias("key"), F.least(side("a"), side("b")).alias("x")).select("key", "x.delivered_at", "x.msg_id")

    def compact(self) -> DataFrame:
        """Merge all runs into one and return it: one row an identifier. Runs of which nothing is left to read are removed."""
        made: list[str] = []
        runs, round_no = self.runs, 0
        while len(runs) > 1:
            # Neighbours are merged, so that a row is rewritten a logarithmic number of times.
            grown = []
            for k in range(0, len(runs) - 1, 2):
                name = f"merge-{self.version + 1:08d}-{round_no}-{k // 2}"
                with _sorted_buckets(self.spark):
                    self._write(self._merged(runs[k], runs[k + 1]), name)
                made.append(name)
                grown.append(name)
            runs, round_no = grown + (runs[-1:] if len(runs) % 2 else []), round_no + 1
        if runs != self.runs:
            old = [*self.runs, *made]
            self._commit(runs, self.batches)
            used = {run.split("/")[0] for run in runs}
            for run in old:
                if run not in runs:
                    self.folder.remove(run if run.split("/")[0] in used else run.split("/")[0])
        return self._table(runs[0]) if runs else self.spark.createDataFrame([], self.SCHEMA)


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """(key, delivered_at, msg_id) of the first delivery of each identifier.

    The table enters a store of its own as two runs, the earlier and the later
    half of the time that it spans, which compaction merges.
    """
    store = DeliveryStore(deliveries.sparkSession)
    narrow = deliveries.select("case_id", F.col("delivered_at").cast("timestamp").alias("delivered_at"), "msg_id")
    first, last = narrow.agg(F.min("delivered_at"), F.max("delivered_at")).first()
    store.upsert(narrow, cut=None if first is None else first + (last - first) / 2)
    return store.compact().select("key", "delivered_at", "msg_id")


def exactly_once(deliveries: DataFrame) -> DataFrame:
    """The rows of ``deliveries`` with one copy of each identifier, all columns kept.

    The copy kept has the smallest ``delivered_at``, then the smallest
    ``msg_id``; ``msg_id`` is unique. Rows without identifier can't be told to
    be copies and are all kept; an empty identifier is one like others.
    """
    kept = first_deliveries(deliveries).select(F.col("msg_id"))
    nameless = deliveries.where(F.col("case_id").isNull())
    return deliveries.where(F.col("case_id").isNotNull()).join(kept, "msg_id", "left_semi").select(*deliveries.columns).unionByName(nameless)


def repeated_deliveries(deliveries: DataFrame) -> DataFrame:
    """(msg_id) of every delivery that is not the first of its identifier."""
    kept = first_deliveries(deliveries).select("msg_id")
    return deliveries.where(F.col("case_id").isNotNull()).select("msg_id").join(kept, "msg_id", "left_anti")
