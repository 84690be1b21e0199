from pyspark.sql import functions as F

from tidemark.operators.baseline import fit_baseline, score
from tidemark.operators.quality import scores


def test_baseline_learns_and_scores(spark):
    rows = spark.range(900).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("actual"), F.when(F.col("id") % 11 > 0, (F.col("id") % 3) * 2.0 + F.rand(3)).alias("x"), F.when(F.col("id") % 3 == 1, 1.0).otherwise(F.rand(4)).alias("y"), F.lit(None).cast("double").alias("empty")
    )
    model = fit_baseline(rows, ["x", "y", "empty"])
    out = score(model, rows)
    assert scores(out).first()["accuracy"] > 0.8
    bad = out.where((F.abs(F.col("p_down") + F.col("p_flat") + F.col("p_up") - 1) > 1e-9) | (F.col("margin") < 0) | (F.col("max_p") > 1))
    assert bad.count() == 0 and set(rows.columns) <= set(out.columns)
