import random

import numpy as np

from tidemark.llm import truncation as R
from tidemark.sources.tables import table


def test_cut_inside():
    t = "One two three. Four 0.43 five. So the vote is UP."
    assert R.cut_inside(t, 14) is None and R.cut_inside(t, 15) is None and R.cut_inside(t, len(t) - 1) is None
    assert R.cut_inside(t, 6) == "One tw" and R.cut_inside(t, t.index("43")) is not None
    assert R.cut_inside("Ends", 4) is None and R.cut_inside("", 0) is None


def test_held_out_accuracy(spark, medium):
    """Fitted on half of the intact values, judged on cut and whole versions of the others."""
    rows = [r["thinking"] for r in table(spark, medium, "harness_results").where("thinking is not null").orderBy("msg_id").collect()]
    good = [t for t in dict.fromkeys(rows) if t.strip() and (R.ends_sentence(t) or t.split()[-1] in ("UP", "DOWN", "FLAT"))]
    random.Random(1).shuffle(good)
    fit, held = good[: len(good) // 2], good[len(good) // 2 :]
    w = R.fit_cut_model(fit, {400, 512})
    cut = R.made_examples(held, {400, 512}, seed=99)
    hit = (w[R.hashed([R.features(t, {400, 512}) for t in cut])].sum(axis=1) > 0).mean()
    false = (w[R.hashed([R.features(t, {400, 512}) for t in held])].sum(axis=1) > 0).mean()
    assert hit > 0.97 and false < 0.01


def test_closings_are_learnt_from_the_data():
    """Proper ends without full stop are told by the values alone: another field, whose values close with a grade, or a quarter of them cut."""
    rng = random.Random(3)
    nouns, verbs = ["ledger", "harbour", "engine", "river", "window", "garden", "market", "letter"], ["holds", "opens", "carries", "follows", "reaches", "leaves"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} near the old {rng.choice(nouns)}."
    whole = [" ".join(sentence() for _ in range(rng.randrange(2, 6))) + rng.choice(["", f" Grade {rng.choice('ABC')}{rng.randrange(1, 5)}", " -> pass", " -> fail"]) for _ in range(3000)]
    cut = R.made_examples(whole[:400], set(), seed=5, per_text=2)
    w = R.fit_cut_model(whole[:2000] + cut, set())
    held = whole[2000:]
    judged = lambda texts: w[R.hashed([R.features(t, set()) for t in texts])].sum(axis=1) > 0
    assert judged(held).mean() < 0.01 and judged(R.made_examples(held, set(), seed=9)).mean() > 0.97


def test_scores_and_rates(spark, medium):
    h = table(spark, medium, "harness_results")
    s = R.truncation_scores(h, "msg_id", "thinking").cache()
    assert s.count() == h.where("trim(regexp_replace(thinking, '\\\\s+', ' ')) <> ''").count()
    rates = R.truncation_rates(h, s, "msg_id", "source").collect()
    assert sum(r["n_values"] for r in rates) == s.count() and sum(r["n_cut"] for r in rates) == s.where("cut").count() > 0
    texts = {r["row_id"]: r["text"] for r in h.selectExpr("msg_id as row_id", "thinking as text").collect()}
    for r in s.where("cut").collect():
        body, marked = R.without_mark(texts[r["row_id"]])
        assert marked or not R.ends_sentence(body) or body[-2].isdigit()


def test_defined_results(spark):
    schema = "msg_id long, thinking string, cut string"
    assert R.truncation_scores(spark.createDataFrame([], schema), "msg_id", "thinking").count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, " \n", "x"), (3, "All fine here.", "x"), (3, "All fine here.", "x"), (4, "word " * 20000 + "end.", "x")], schema)
    got = R.truncation_scores(df, "msg_id", "thinking").collect()
    assert sorted(r["row_id"] for r in got) == [3, 3, 4] and not any(r["cut"] for r in got)
    assert R.fit_cut_model([], set()).sum() == 0 and np.isfinite(R.fit_cut_model(["x"], set())).all()
