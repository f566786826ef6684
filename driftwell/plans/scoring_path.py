"""A finished run's way from raw rows to scores: saved in one folder, loaded anywhere, applied to new rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.models import ScoreModel
from driftwell.operators.preprocess import Preprocessor
from driftwell.operators.scoring import flag_at
from driftwell.operators.selection import PcaSelector, Selector


@dataclass
class ScoringPath:
    """Preprocessing with its dictionary of levels, components if any, the model and its threshold."""

    preprocessor: Preprocessor
    components: PcaSelector | None
    model: ScoreModel
    threshold: float

    @classmethod
    def of(cls, preprocessor: Preprocessor, selector: Selector | None, model: ScoreModel, threshold: float) -> ScoringPath:
        """Selectors that only keep columns leave nothing to save: the model names its columns."""
        if selector is not None and selector.stage != "before" and not isinstance(selector, PcaSelector):
            if type(selector).transform is not Selector.transform:
                raise ValueError(f"{type(selector).__name__} makes columns of its own, which cannot be saved")
        return cls(preprocessor, selector if isinstance(selector, PcaSelector) else None, model, threshold)

    def prepare(self, df: DataFrame, *keep: str) -> DataFrame:
        prepared = self.preprocessor.transform(df, *keep)
        return self.components.transform(prepared, *keep) if self.components is not None else prepared

    def score(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep``, ``score`` and ``flag`` for rows with the raw columns; a label is not needed."""
        return self.model.score(self.prepare(df, *keep), *keep).withColumn("flag", flag_at(F.col("score"), self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(path)
        self.preprocessor.save(spark, f"{path}/preprocessor")
        if self.components is not None:
            rows = [
                (i, c, float(m), [float(v) for v in row])
                for i, (c, m, row) in enumerate(zip(self.components.features, self.components.centre, self.components.loadings))
            ]
            table = spark.createDataFrame(rows, "place int, feature string, centre double, loadings array<double>")
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
        about = {"threshold": None if self.threshold is None else repr(float(self.threshold)), "components": self.components is not None}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scoring")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringPath:
        about = json.loads(spark.read.text(f"{path}/scoring").first()[0])
        components = None
        if about["components"]:
            rows = spark.read.parquet(f"{path}/components").orderBy("place").collect()
            loadings = np.array([r["loadings"] for r in rows])
            components = PcaSelector(
                loadings.shape[1], [r["feature"] for r in rows], [f"PC{i + 1}" for i in range(loadings.shape[1])],
                centre=np.array([r["centre"] for r in rows]), loadings=loadings,
            )
        threshold = None if about["threshold"] is None else float(about["threshold"])
        return cls(Preprocessor.load(spark, f"{path}/preprocessor"), components, ScoreModel.load(path), threshold)
