"""A linear baseline that scores panels: median fill, standard scale, balanced multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import class_weights


def fit_baseline(rows: DataFrame, features: list[str], label: str = "actual", reg: float = 0.01) -> PipelineModel:
    """The fitted pipeline; classes weigh the same. Features without any value are left out."""
    seen = rows.agg(*[F.count(c).alias(c) for c in features]).first().asDict()
    used = [c for c in features if seen[c]]
    weighted = rows.where(F.col(label).isNotNull()).join(class_weights(rows, label).select(label, "weight"), label)
    filled = [f"{c}__filled" for c in used]
    stages = [
        Imputer(strategy="median", inputCols=used, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__features", labelCol=label, weightCol="weight", regParam=reg, family="multinomial", probabilityCol="__p", rawPredictionCol="__margins", predictionCol="__class"),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with p_down, p_flat, p_up, predicted, max_p and margin, the distance of the two largest."""
    out = model.transform(rows).withColumn("__a", vector_to_array("__p"))
    names = ["p_down", "p_flat", "p_up"]
    out = out.withColumns({n: F.coalesce(F.try_element_at("__a", F.lit(k + 1)), F.lit(0.0)) for k, n in enumerate(names)})
    ordered = F.sort_array(F.array(*names), asc=False)
    out = out.withColumns({"predicted": F.array_position(F.array(*names), ordered[0]).cast("int") - 1, "max_p": ordered[0], "margin": ordered[0] - ordered[1]})
    return out.drop(*[c for c in out.columns if c.startswith("__") or c.endswith("__filled")])
