"""Binary classifiers on MLlib, scoring, importances and linear attributions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.numbers import finite_sql, sql_name

# Model settings. MLlib names; MLlib caps tree depth at 30.
MODEL_DEFAULTS: dict[str, dict[str, Any]] = {
    "lr": {"maxIter": 1000, "C": 1.0, "class_weight": "balanced"},
    "rf": {
        "numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt",
        "class_weight": "balanced", "seed": 42,
    },
    "gbt": {
        "maxIter": 1500, "maxDepth": 10, "stepSize": 0.01, "minInstancesPerNode": 290,
        "subsamplingRate": 0.55, "class_weight": "balanced", "seed": 42,
    },
}
WEIGHT = "_weight"


def assemble(df: DataFrame, features: Sequence[str], *keep: str | Column) -> DataFrame:
    """Kept columns and one ``features`` vector. Names are replaced by positions, so any name works."""
    numbered = df.select(*keep, *[F.expr(f"CAST({sql_name(c)} AS DOUBLE) AS _x{i}") for i, c in enumerate(features)])
    names = [f"_x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(numbered).drop(*names)


def balanced_weight(df: DataFrame, label: str) -> tuple[Column, int]:
    """Weight ``n / (2 * rows of the class)`` per row, and n."""
    counts = {int(r[label]): r["rows"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"both classes are needed for training, got {sorted(counts)}")
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, F.lit(n / (2 * counts[1]))).otherwise(F.lit(n / (2 * counts[0])))
    return weight, n


@dataclass
class ScoreModel:
    """A fitted classifier with its feature order."""

    kind: str
    features: list[str]
    model: Any
    settings: dict[str, Any] = field(default_factory=dict)

    def score(self, df: DataFrame, *keep: str, column: str = "score") -> DataFrame:
        """Kept columns and the positive-class probability."""
        scored = self.model.transform(assemble(df, self.features, *keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias(column))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), largest first: tree importances or absolute coefficients."""
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        elif hasattr(self.model, "coefficients"):
            values = abs(self.model.coefficients.toArray())
        else:
            values = [0.0] * len(self.features)
        return importance_frame(spark, self.features, values)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        meta = json.dumps({"kind": self.kind, "features": self.features, "settings": self.settings}, sort_keys=True)
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> ScoreModel:
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
        loader = {
            "lr": LogisticRegressionModel, "rf": RandomForestClassificationModel, "gbt": GBTClassificationModel
        }[about["kind"]]
        return cls(about["kind"], about["features"], loader.load(f"{path}/model"), about["settings"])


def importance_frame(spark: SparkSession, features: Sequence[str], values) -> DataFrame:
    if len(features) != len(values):
        raise ValueError(f"{len(values)} importances for {len(features)} features")
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def fit_model(
    kind: str, df: DataFrame, features: Sequence[str], label: str, settings: Mapping[str, Any] | None = None
) -> ScoreModel:
    """Fit ``lr``, ``rf`` or ``gbt`` on prepared columns; ``settings`` override the defaults.

    The assembled vectors are kept in memory with spill to disk for the iterations. Validation rows are
    never passed in.
    """
    if kind not in MODEL_DEFAULTS:
        raise ValueError(f"unknown model {kind!r}: use one of {sorted(MODEL_DEFAULTS)}")
    options = MODEL_DEFAULTS[kind] | dict(settings or {})
    balanced = options.pop("class_weight", None) == "balanced"
    weight, n = balanced_weight(df, label)
    kept = (weight if balanced else F.lit(1.0)).alias(WEIGHT)
    training = assemble(df, features, F.col(label).cast("double").alias("label"), kept).persist()
    try:
        if kind == "lr":
            # Penalty 1/C on the summed loss is 1/(C * sum of weights) on MLlib's mean loss.
            strength = 1.0 / (options.pop("C") * n)
            learner = LogisticRegression(weightCol=WEIGHT, regParam=strength, standardization=False, **options)
        elif kind == "rf":
            learner = RandomForestClassifier(weightCol=WEIGHT, **options)
        else:
            learner = GBTClassifier(weightCol=WEIGHT, **options)
        fitted = learner.fit(training)
    finally:
        training.unpersist()
    return ScoreModel(kind, list(features), fitted, dict(options))


def linear_attribution(df: DataFrame, weights: Mapping[str, float], background: Mapping[str, float] | None = None) -> DataFrame:
    """Mean absolute linear attribution per feature: ``avg(|w * (x - mean of x)|)``, missing read as 0."""
    names = list(weights)
    cleaned = df.select(*[F.expr(f"coalesce({finite_sql(c)}, 0.0D) AS x{i}") for i, c in enumerate(names)])
    if background is None:
        means = cleaned.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()
        background = {c: means[f"x{i}"] or 0.0 for i, c in enumerate(names)}
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.abs(F.lit(float(weights[c])) * (F.col(f"x{i}") - F.lit(float(background[c]))))).alias("mean_abs_shap"),
        )
        for i, c in enumerate(names)
    ]
    return (
        cleaned.agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("cell"))
        .select("cell.*")
        .orderBy(F.col("mean_abs_shap").desc(), "feature")
    )


def model_attribution(model: ScoreModel, df: DataFrame) -> DataFrame:
    """Linear attribution of a logistic model; tree models have importances instead."""
    if model.kind != "lr":
        raise ValueError("attributions are for the linear model; use importance() for trees")
    return linear_attribution(df, dict(zip(model.features, model.model.coefficients.toArray())))
