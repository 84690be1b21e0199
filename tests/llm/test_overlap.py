import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import overlap as O

SCHEMA = "cand_id long, case_id string, split string, source string, prompt string, codes string"
VOCAB = [f"w{i}" for i in range(400)]


def story(rng, n=90):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def prompt(text):
    return f"SYMBOL: X\nBEFORE T: y\nARTICLE:\n{text}\nTASK: vote"


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "new" + str(rng.randrange(999))
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "ins" + str(rng.randrange(999)))
    return " ".join(words)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_equals_full_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        d = levenshtein(a, b)
        for most in (0, 3, 8, 30):
            assert O.edits_within(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), most) == (d if d <= most else None)


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for s in range(40):
        base = story(rng, rng.randrange(12, 160))
        for _ in range(rng.randrange(1, 5)):
            i += 1
            text = edited(rng, base, rng.randrange(0, max(1, len(base.split()) // 6)))
            rows.append((i, f"c{rng.randrange(60)}", rng.choice(["train", "train", "validation", "test", None]), "s", prompt(text), "z"))
    got = {(r["cand_id_a"], r["cand_id_b"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    words = {r[0]: r[4].split("ARTICLE:\n")[1].split("\nTASK")[0].split() for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == "train" and b[2] in ("validation", "test"):
                n = max(len(words[a[0]]), len(words[b[0]]))
                if a[1] == b[1] or levenshtein(words[a[0]], words[b[0]]) <= n // 10:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert want <= got
    # beyond those, only pairs whose ends differ by a remark
    for a, b in got - want:
        assert levenshtein(words[a], words[b]) <= max(len(words[a]), len(words[b])) // 10 + O.REMARK


def test_what_does_not_count(spark):
    rng = random.Random(3)
    base = story(rng, 80).replace("w1 ", "1,297 ").replace("w2 ", "two-wheelers ") + " rose 3.0 percent."
    same = [base.upper(), base.replace("1,297", "1297").replace("3.0 percent", "3.0%").replace("two-wheelers", "two - wheelers"), "Corrected - " + base, "(Updates headline) " + base + " More follows.", base.replace(" ", "  ").replace(".", ";")]
    rows = [(1, "a", "train", "s", prompt(base), None)] + [(k + 2, f"b{k}", "test", "s", prompt(t), None) for k, t in enumerate(same)]
    rows += [(90, None, "train", None, None, None), (91, None, "test", None, None, None), (92, " ", "train", "s", "", None), (93, "", "test", "s", "", None), (94, "x", "test", "s", prompt(story(rng, 80)), None)]
    got = {(r["cand_id_a"], r["cand_id_b"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, k + 2) for k in range(len(same))}


def test_unmarked_remark_of_four_words_besides_a_tenth_of_changed_words(spark):
    base = [f"w{k}" for k in range(50)]
    changed = [f"new{k}" if k % 10 == 5 else w for k, w in enumerate(base)]
    dropped = [w for k, w in enumerate(base) if k % 10 != 5]
    remark = ["seen", "by", "our", "desk"]
    texts = [remark + changed, changed + remark, remark[:2] + changed + remark[2:], remark + dropped]
    no = [remark + ["today"] + changed, remark + ["new15" if w == "w12" else w for w in changed]]
    rows = [(1, "a", "train", "s", prompt(" ".join(base)), None)] + [(k + 2, f"b{k}", "test", "s", prompt(" ".join(t)), None) for k, t in enumerate(texts + no)]
    # And the other way round: the remark in the training text.
    rows += [(90, "c", "test", "s", prompt(" ".join(base)).replace("w", "v"), None), (91, "d", "train", "s", prompt(" ".join(remark + changed)).replace("w", "v"), None)]
    got = {(r["cand_id_a"], r["cand_id_b"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, k + 2) for k in range(len(texts))} | {(90, 91)}


def test_empty_table_and_report(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert O.cross_split_pairs(df).count() == 0 and O.overlap_report(df).count() == 0
    rows = [(k, "c", "train" if k % 2 else "test", "s", prompt("one two three"), None) for k in range(8)]
    r = O.overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(r) == 1 and r[0]["n_pairs"] == 16 and r[0]["n_by_case"] == r[0]["n_by_text"] == 16


def test_article_of(spark):
    texts = [prompt("hello there"), "SYMBOL: X\nVOR T: y\nARTIKEL:\nGuten Tag\nAUFGABE: los", "no lines at all", None, "ARTICLE:\n\nTASK: x"]
    rows = O.with_article(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a").collect()
    assert [r["a"] for r in rows] == ["hello there", "Guten Tag", "no lines at all", None, ""]


def test_a_phrase_that_many_share_pairs_nobody(spark, monkeypatch):
    """A third of all texts open with the same words; their pairs must not reach the comparison."""
    rng = random.Random(8)
    phrase = " ".join(f"p{k}" for k in range(12))
    rows = []
    for i in range(1, 901):
        text = story(rng, 110)
        rows.append((i, f"c{i}", "train" if i % 2 else "test", "s", prompt(f"{phrase} {text}" if i % 3 == 0 else text), None))
    rows.append((1001, "x", "test", "s", rows[2][4], None))  # row 3 again
    seen = {}
    keep = O.materialize

    def watched(df, label, partition_by=None):
        out = keep(df, label, partition_by)
        if label == "overlap-pairs":
            seen["n"] = out.count()
        return out

    monkeypatch.setattr(O, "materialize", watched)
    got = {(r["cand_id_a"], r["cand_id_b"]) for r in O.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, 1001)} and seen["n"] < 200
