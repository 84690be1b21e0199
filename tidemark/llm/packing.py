"""Texts in containers of fixed capacity, by bulk-synchronous best fit.

Items are placed by falling size, in levels: level j has the items of more than
capacity / 2 ** (j + 1) and at most capacity / 2 ** j. A superstep range-sorts
the items of a level together with the gaps of the open containers. Each task
sweeps its range from large to small with a stack: a gap is put on it, an item
takes the gap on top, which is the smallest one left that holds it, its
successor. What a task leaves over, gaps at the low end of its range and items
at the high end, is matched between tasks by rank: only counts by task reach the
driver, which says which ranks of whose items get which ranks of whose gaps. Gaps
are updated, and the sweep is repeated with what is left. A gap that holds
several items of the level offers as many slots at once. Items that no gap holds
open containers, and fill them in order of size. Every step is a table in the
shared folder; no list of items, gaps or placements comes to the driver.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import materialize, scratch_path

#: Folder of the public tokenizers' vocabulary files, and the one that sizes are counted in.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Items and gaps that one task sorts and sweeps.
ROWS_A_TASK = 50_000
_ITEM = "capacity int, item_id long, piece int, n_pieces int, size int"
_GAP = "capacity int, container long, gap int"
# Fixed value: how the tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for pdf in batches:
            # One text at a time: a batch of encodings would hold all its tokens at once.
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "size": pd.Series(sizes, index=pdf.index, dtype="int64")})

    return run


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """(item_id, size): tokens of each whole text; null and empty texts have none."""
    narrow = documents.select(F.col(doc_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return narrow.mapInPandas(_counter(tokenizer), "item_id long, size long")


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match the items and slots of a range, which come by falling size, a slot before items of its size.

    Rows out have the item's columns and its container, or with neither an item
    or container the ``rank`` among what this task leaves over of that capacity.
    """
    task = TaskContext.get().partitionId()
    capacity, stack, n_items = None, [], 0
    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["capacity", "item_id", "piece", "n_pieces", "size", "container", "task", "rank"])
        out.clear()
        return made.astype({"item_id": "Int64", "container": "Int64", "rank": "Int64"})

    def left_gaps() -> None:
        out.extend((capacity, None, 0, 0, 0, container, task, rank) for rank, container in enumerate(stack))

    for pdf in batches:
        for cap, is_item, size, key, piece, n_pieces in zip(*(pdf[c].tolist() for c in ("capacity", "is_item", "size", "key", "piece", "n_pieces"))):
            if cap != capacity:
                left_gaps()
                capacity, stack, n_items = cap, [], 0
            if not is_item:
                stack.append(key)
            elif stack:
                out.append((cap, key, piece, n_pieces, size, stack.pop(), task, None))
            else:
                out.append((cap, key, piece, n_pieces, size, None, task, n_items))
                n_items += 1
        yield frame()
    left_gaps()
    yield frame()


_SWEPT = "capacity int, item_id long, piece int, n_pieces int, size int, container long, task int, rank long"


def match_left_over(counts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(capacity, item task, first item rank, number, gap task, last gap rank) from (capacity, task, items, gaps) left over.

    Tasks are in order of falling size. The items of a task come before its
    gaps, so they take the gaps on top of the stack of the tasks before: the
    item of the first rank gets the gap of the last one, and so on downwards.
    """
    pairs, stack, at = [], [], None
    for capacity, task, items, gaps in sorted(counts):
        if capacity != at:
            stack, at = [], capacity
        first = 0
        while items and stack:
            owner, n = stack.pop()
            take = min(items, n)
            pairs.append((capacity, task, first, take, owner, n - 1))
            if n > take:
                stack.append((owner, n - take))
            first, items = first + take, items - take
        if gaps:
            stack.append((task, gaps))
    return pairs


def _open(alone: bool):
    """Containers filled one after another with the items of a range, by falling size: (item columns, task, own).

    The last one of a task, which may be far from full, is left to the next
    round (``own`` null) unless the task is ``alone``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        capacity, own, used, tail = None, 0, 0, []
        columns = ["capacity", "item_id", "piece", "n_pieces", "size", "task", "own"]

        def frame(rows: list[tuple], number: int | None) -> pd.DataFrame:
            return pd.DataFrame([(*r, task, number) for r in rows], columns=columns).astype({"own": "Int64"})

        for pdf in batches:
            done: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in columns[:5])):
                cap, size = row[0], row[4]
                if cap != capacity or used + size > cap:
                    if tail:
                        done.extend((*r, task, own if cap == capacity or alone else None) for r in tail)
                    own, used, tail = (own + 1 if cap == capacity else 0), 0, []
                    capacity = cap
                used += size
                tail.append(row)
            yield pd.DataFrame(done, columns=columns).astype({"own": "Int64"})
        yield frame(tail, own if alone else None)

    return run


class _Packing:
    """State of a run: the folder of placements, the open gaps, and the number of containers by capacity."""

    def __init__(self, spark: SparkSession, capacities: list[int]):
        self.spark = spark
        self.path = scratch_path(spark, "placements")
        self.opened = dict.fromkeys(capacities, 0)
        self.gaps: DataFrame | None = None
        self.steps = 0

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Write rows with a container among the placements, and return all of ``rows`` as stored."""
        self.steps += 1
        path = f"{self.path}/step={self.steps}"
        rows.select("capacity", "item_id", "piece", "n_pieces", "size", "container").write.parquet(path)
        return self.spark.read.schema(_ITEM + ", container long").parquet(path)

    def sweep(self, items: DataFrame, level: int, n_items: int, live: DataFrame, n_gaps: int) -> tuple[DataFrame, int, DataFrame]:
        """Match ``items`` with the gaps ``live``: (items still without a container, their number, placements)."""
        high = F.floor(F.col("capacity") / (1 << level))
        # No more slots than twice the items need; gaps that offered fewer than they could do so again in the next sweep.
        most = max(1, -(-2 * n_items // max(1, n_gaps)))
        slots = live.withColumn("q", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("gap") / high))).cast("int"))
        slots = slots.select(
            "capacity", F.lit(0).alias("is_item"), F.floor(F.col("gap") / F.col("q")).cast("int").alias("size"), F.col("container").alias("key"), F.explode(F.sequence(F.lit(1), F.col("q"))).alias("piece"), F.lit(0).alias("n_pieces")
        )
        rows = items.select("capacity", F.lit(1).alias("is_item"), "size", F.col("item_id").alias("key"), "piece", "n_pieces").unionByName(slots)
        order = ["capacity", F.desc("size"), "is_item", "key", "piece"]
        tasks = _tasks(n_items + min(n_gaps * most, 2 * n_items + n_gaps))
        swept = materialize(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(_sweep, _SWEPT), "swept")
        # One row a task and capacity.
        is_item, is_gap = F.col("item_id").isNotNull() & F.col("container").isNull(), F.col("item_id").isNull()
        counts = swept.groupBy("capacity", "task").agg(F.count_if(is_item).alias("i"), F.count_if(is_gap).alias("g")).collect()
        pairs = match_left_over([tuple(r) for r in counts])
        n_left = sum(r["i"] for r in counts) - sum(p[3] for p in pairs)
        own = swept.where("item_id is not null")
        if not pairs:
            return self._split(self._placed(own), n_left)
        ranges = F.broadcast(self.spark.createDataFrame(pairs, "capacity int, task int, first long, number long, gap_task int, last long"))
        matched = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number"))
        left = own.alias("s").join(ranges.alias("r"), (F.col("s.capacity") == F.col("r.capacity")) & (F.col("s.task") == F.col("r.task")) & F.col("s.container").isNull() & matched, "left")
        left = left.select("s.*", "gap_task", (F.col("last") - (F.col("rank") - F.col("first"))).alias("gap_rank"))
        given = swept.where("item_id is null").select("capacity", F.col("task").alias("gap_task"), F.col("rank").alias("gap_rank"), F.col("container").alias("given"))
        crossed = left.where("gap_rank is not null").join(given, ["capacity", "gap_task", "gap_rank"]).withColumn("container", F.col("given"))
        columns = ["capacity", "item_id", "piece", "n_pieces", "size", "container"]
        return self._split(self._placed(left.where("gap_rank is null").select(*columns).unionByName(crossed.select(*columns))), n_left)

    @staticmethod
    def _split(stored: DataFrame, n_left: int) -> tuple[DataFrame, int, DataFrame]:
        return stored.where("container is null").drop("container"), n_left, stored.where("container is not null")

    def open(self, items: DataFrame, n_items: int) -> list[DataFrame]:
        """Open containers for all of ``items``; the placements."""
        done = []
        while n_items:
            tasks = _tasks(n_items)
            order = ["capacity", F.desc("size"), "item_id", "piece"]
            filled = materialize(items.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(_open(tasks == 1), _ITEM + ", task int, own long"), "filled")
            # One row a task and capacity.
            counts = filled.groupBy("capacity", "task").agg(F.max("own").alias("m"), F.count_if(F.col("own").isNull()).alias("left")).collect()
            bases = []
            for r in sorted(counts, key=lambda r: (r["capacity"], r["task"])):
                if r["m"] is not None:
                    bases.append((r["capacity"], r["task"], self.opened[r["capacity"]]))
                    self.opened[r["capacity"]] += r["m"] + 1
            if bases:
                base = F.broadcast(self.spark.createDataFrame(bases, "capacity int, task int, base long"))
                done.append(self._placed(filled.where("own is not null").join(base, ["capacity", "task"]).withColumn("container", F.col("base") + F.col("own"))))
            n_items = sum(r["left"] for r in counts)
            items = filled.where("own is null").select("capacity", "item_id", "piece", "n_pieces", "size")
        return done

    def update(self, placements: list[DataFrame], smallest: dict[int, int]) -> None:
        """Gaps after ``placements``, of old and new containers; what no item fits any more is left out."""
        if not placements:
            return
        used = functools.reduce(DataFrame.unionByName, placements).groupBy("capacity", "container").agg(F.sum("size").alias("used"))
        least = F.element_at(F.create_map(*[F.lit(x) for kv in smallest.items() for x in kv]), F.col("capacity"))
        known = self.gaps if self.gaps is not None else self.spark.createDataFrame([], _GAP)
        after = known.join(used, ["capacity", "container"], "full").select("capacity", "container", (F.coalesce("gap", "capacity") - F.coalesce("used", F.lit(0))).cast("int").alias("gap"))
        # A container that was retired takes no more items, so every unknown one is new.
        self.gaps = materialize(after.where(F.col("gap") >= least), "gaps")


def packed(sizes: DataFrame, capacities: list[int], sweeps: int = 2) -> DataFrame:
    """(capacity, item_id, piece, n_pieces, size, container) of all items for each capacity.

    Items above the capacity are split into full pieces and a rest, and only
    those; piece 0 of each other item is the whole. Items without tokens need
    no container and get container null. Containers are numbered from 0 for
    each capacity; the sizes in one never exceed its capacity. A level is swept
    ``sweeps`` times at most before its rest opens containers.
    """
    spark = sizes.sparkSession
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    if not capacities:
        return spark.createDataFrame([], _ITEM + ", container long")
    each = sizes.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
    each = each.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
    pieces = each.select(
        "capacity", "item_id", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"), F.col("size").alias("whole")
    ).select("capacity", "item_id", "piece", "n_pieces", F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))
    # The largest j with size * 2 ** j <= capacity, as the number of binary digits; null sizes count as 0.
    pieces = pieces.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("level", F.when(F.col("size") > 0, F.length(F.bin(F.floor(F.col("capacity") / F.col("size")))) - 1).otherwise(-1))
    stored = materialize(pieces, "pieces", ["level"])
    # One row a capacity and level.
    table = stored.where("level >= 0").groupBy("level", "capacity").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).collect()
    state = _Packing(spark, capacities)
    smallest: dict[int, int] = {}
    for r in table:
        smallest[r["capacity"]] = min(r["least"], smallest.get(r["capacity"], r["least"]))
    for level in sorted({r["level"] for r in table}):
        n_items = sum(r["n"] for r in table if r["level"] == level)
        items = stored.where(F.col("level") == level).drop("level")
        placements: list[DataFrame] = []
        live = state.gaps
        for _ in range(sweeps if live is not None else 0):
            low = F.floor(F.col("capacity") / (1 << level + 1))
            used = functools.reduce(DataFrame.unionByName, placements).groupBy("capacity", "container").agg(F.sum("size").alias("used")) if placements else None
            fresh = live if used is None else live.join(used, ["capacity", "container"], "left").withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("used")
            fresh = fresh.where((F.col("gap") > low) & F.col("capacity").isin([r["capacity"] for r in table if r["level"] == level]))
            fresh = fresh if used is None else materialize(fresh, "gaps-left")
            n_gaps = fresh.count()
            if not n_gaps or not n_items:
                break
            before = n_items
            items, n_items, placed = state.sweep(items, level, n_items, fresh, n_gaps)
            placements.append(placed)
            if n_items == before:
                break
        placements += state.open(items, n_items)
        state.update(placements, smallest)
    nothing = stored.where("level < 0").select("capacity", "item_id", "piece", "n_pieces", "size", F.lit(None).cast("long").alias("container"))
    if not state.steps:
        return nothing
    placed = spark.read.schema(_ITEM + ", container long, step int").parquet(state.path).drop("step").where("container is not null")
    return placed.unionByName(nothing)


def pack_documents(documents: DataFrame, budgets: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """(budget_id, doc_id, piece, n_pieces, tokens, container) of every document for every budget.

    Budgets with null or non-positive capacity have no containers and no rows.
    """
    sizes = materialize(token_sizes(documents, doc_id, text, tokenizer), "token-sizes")
    rows = [(r["budget_id"], int(r["capacity_tokens"])) for r in budgets.select("budget_id", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    placed = packed(sizes, [c for _, c in rows])
    names = documents.sparkSession.createDataFrame(rows, "budget_id int, capacity int")
    return placed.join(F.broadcast(names), "capacity").select(
        "budget_id", F.col("item_id").alias("doc_id"), "piece", "n_pieces", F.col("size").alias("tokens"), "container"
    )


def container_fill(packing: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, n_containers, tokens, share_used): how full the containers of each budget are."""
    used = packing.where("container is not null").groupBy("budget_id").agg((F.max("container") + 1).alias("n_containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id").select(
        "budget_id", "capacity_tokens", "n_containers", "tokens", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("share_used")
    )
