import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as K
from tidemark.sources.tables import table


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= size]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_left_over_is_matched_as_one_stack_would(tasks):
    counts = [(9, t, i, g) for t, (i, g) in enumerate(tasks)]
    stack, expected = [], set()
    for _, t, i, g in counts:
        for rank in range(i):
            if stack:
                expected.add(((t, rank), stack.pop()))
        stack += [(t, rank) for rank in range(g)]
    got = {((t, first + k), (owner, last - k)) for _, t, first, n, owner, last in K.match_left_over(counts) for k in range(n)}
    assert got == expected


def check(rows, sizes, capacity):
    """Each piece once, whole items not split, no container over its capacity, containers numbered without holes; how many."""
    fill, parts = Counter(), {}
    for r in rows:
        fill[r["container"]] += r["size"]
        parts.setdefault(r["item_id"], []).append((r["piece"], r["size"], r["n_pieces"]))
    assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
    for i, size in sizes.items():
        own = sorted(parts[i])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, n, _ in own) == size
        assert len(own) == -(-size // capacity) == own[0][2] and all(n == capacity for _, n, _ in own[:-1])
    return len(fill)


@pytest.mark.parametrize("seed,capacity,high", [(1, 256, 300), (2, 64, 40), (3, 1000, 999)])
def test_close_to_best_fit_over_many_tasks(spark, monkeypatch, seed, capacity, high):
    # Few rows a task, so that most matches are between tasks.
    monkeypatch.setattr(K, "ROWS_A_TASK", 40)
    rng = random.Random(seed)
    sizes = {i: rng.randrange(1, high) for i in range(400)}
    rows = K.packed(spark.createDataFrame(list(sizes.items()), "item_id long, size long"), [capacity]).collect()
    n = check(rows, sizes, capacity)
    pieces = [min(capacity, s - k) for s in sizes.values() for k in range(0, s, capacity)]
    assert n <= 1.03 * best_fit_decreasing(pieces, capacity) + 2


def test_large_capacity(spark):
    rng = random.Random(4)
    sizes = {i: min(131_072, int(rng.lognormvariate(5.3, 1)) + 1) for i in range(20_000)}
    rows = K.packed(spark.createDataFrame(list(sizes.items()), "item_id long, size long"), [131_072]).collect()
    assert check(rows, sizes, 131_072) <= 1.02 * -(-sum(sizes.values()) // 131_072) + 1


def test_frame(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 25), (4, 0), (5, 5), (6, 7), (7, 3), (8, 20)], "item_id long, size long")
    rows = K.packed(sizes, [10, 20, 0, None]).collect()
    by = Counter()
    for r in rows:
        if r["container"] is not None:
            by[r["capacity"], r["container"]] += r["size"]
        assert (r["n_pieces"] > 1) == (dict((a["item_id"], a["size"]) for a in sizes.collect())[r["item_id"]] > r["capacity"])
    assert all(v <= c for (c, _), v in by.items())
    assert Counter((r["capacity"], r["item_id"]) for r in rows)[10, 3] == 3 and sum(r["size"] for r in rows if r["capacity"] == 20) == 80
    assert {r["container"] for r in rows if r["item_id"] == 4} == {None}
    assert K.packed(sizes.limit(0), [10]).count() == 0 and K.packed(sizes, []).count() == 0


def test_hot_size(spark):
    sizes = spark.range(3000).selectExpr("id as item_id", "cast(if(id % 3 = 0, 7, id % 50 + 1) as long) as size")
    rows = K.packed(sizes, [64]).collect()
    assert len(rows) == 3000 and len({(r["item_id"], r["piece"]) for r in rows}) == 3000
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["size"]
    assert max(fill.values()) <= 64 and sum(fill.values()) / (64 * len(fill)) > 0.99


def test_documents(spark, small):
    docs, budgets = table(spark, small, "documents"), table(spark, small, "context_budgets")
    packing = K.pack_documents(docs, budgets).cache()
    assert packing.select("budget_id", "doc_id").distinct().count() == docs.count() * budgets.count()
    over = packing.groupBy("budget_id", "container").agg({"tokens": "sum"}).join(budgets, "budget_id").where("container is not null and `sum(tokens)` > capacity_tokens")
    assert over.count() == 0
    assert all(r["n_containers"] <= 1.03 * -(-r["tokens"] // r["capacity_tokens"]) + 1 for r in K.container_fill(packing, budgets).collect())


def test_sizes_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (4, "<|endoftext|>", 5), (5, "a" * 5000, 5)], "doc_id long, text string, size int")
    got = {r["item_id"]: r["size"] for r in K.token_sizes(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1 and got[5] > 100
