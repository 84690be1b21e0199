import random

from tidemark.llm import leakage as L
from tidemark.llm.words import words_of

VOCAB = [f"v{i}" for i in range(300)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "zz" + str(rng.randrange(9999))
    return out


def longest_run(a, b):
    best, row = 0, {}
    where = {}
    for j, x in enumerate(a):
        where.setdefault(x, []).append(j)
    for x in b:
        row = {j: row.get(j - 1, 0) + 1 for j in where.get(x, [])}
        best = max(best, *row.values(), 0) if row else best
    return best


def fewest_changes(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_against_brute_force(spark):
    rng = random.Random(6)
    items = {i: [rng.choice(VOCAB) for _ in range(rng.randrange(8, 120))] for i in range(25)}
    docs = {}
    for d in range(150):
        parts = [rng.choice(VOCAB) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.8:
            item = items[rng.randrange(25)]
            kind = rng.randrange(4)
            if kind == 0:
                quote = changed(rng, item, rng.randrange(0, len(item) // 7 + 1))
            elif kind == 1:
                a = rng.randrange(max(1, len(item) - 10))
                quote = item[a : a + rng.randrange(14, 26)]
            elif kind == 2:
                quote = [w for w in item if rng.random() > 0.08]
            else:
                quote = item
            parts = parts + quote + [rng.choice(VOCAB) for _ in range(rng.randrange(0, 40))]
        docs[d] = parts
    df = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs.items()], "doc_id long, text string, term string")
    it = spark.createDataFrame([(i, " ".join(w), "y") for i, w in items.items()], "item_id long, text string, pos string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_items(df, it).collect()}
    want = {(d, i) for d, w in docs.items() for i, a in items.items() if longest_run(a, w) >= L.RUN or fewest_changes(a, w) <= len(a) // L.CHANGED}
    assert got == want and len(want) > 40


def test_markup_and_case_do_not_count(spark):
    words = [f"Word{i}" for i in range(40)]
    text = " ".join(words)
    marked = "<p>" + "</b> <b>".join(words[:20]) + "</p>\n> " + "\n>  ".join(w.upper() + "," for w in words[20:])
    df = spark.createDataFrame([(1, marked), (2, None), (3, ""), (4, " ".join(words[:19])), (5, text * 400)], "doc_id long, text string")
    it = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    assert sorted(map(tuple, L.leaked_items(df, it).collect())) == [(1, 1), (5, 1)]
    assert L.leaked_items(df.limit(0), it).count() == 0 and L.leaked_items(df, it.limit(0)).count() == 0


def test_words(spark):
    from pyspark.sql import functions as F

    rows = [("Same-store sales, 1,101 &amp; “up” – 3.5%\n> all/any",), (None,), ("...",), ("हिंदी मांग!",)]
    got = [r["w"] for r in spark.createDataFrame(rows, "t string").select(words_of(F.col("t")).alias("w")).collect()]
    assert got == [["samestore", "sales", "1101", "up", "35", "all", "any"], [], [], ["हिंदी", "मांग"]]


def test_index_is_kept_for_other_items(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    docs = [(k, text(120)) for k in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = L.CorpusIndex(spark, f"file://{tmp_path}/index")
    index.add(df.where("doc_id < 20"), name="a")
    index.add(df.where("doc_id < 20"), name="a")
    index.add(df.where("doc_id >= 20"), name="b")
    # Every position of every pair of words is there, whatever items come later.
    every = index.rows(spark.read.parquet(f"{tmp_path}/index/a", f"{tmp_path}/index/b"))
    assert every.selectExpr("sum(size(positions)) as n").first()["n"] == 40 * 119
    for first in (3, 25):
        items = spark.createDataFrame([(first, " ".join(docs[first][1].split()[30:60])), (99, text(40))], "item_id long, text string")
        again = L.CorpusIndex(spark, f"file://{tmp_path}/index")
        assert L.leaked_items(df, items, index=again).collect() == L.leaked_items(df, items).collect() != []
