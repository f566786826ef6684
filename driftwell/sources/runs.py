"""Run artifacts: one Parquet dataset per artifact, partitioned by run, plus readers for run folders."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.numbers import quoted

# Artifact names, and which ones a finished run must have.
REQUIRED_ARTIFACTS = [
    "run_manifest", "leakage_report", "data_split_manifest", "final_selected_features", "fold_selected_features",
    "selection_frequency", "feature_stability_metrics", "model_metadata", "experiment_summary", "cv_results",
    "oot_test_results", "oot_predictions", "selected_feature_psi", "model_score_psi", "credit_risk_utility",
    "runtime_summary",
]
RANKED_ARTIFACTS = ["llm_rankings_summary"]
HYBRID_ARTIFACTS = ["llm_hybrid_trace"]
MANIFEST_SCHEMA = """
    run_id string, status string, model string, selector string, experiment_type string, timestamp string,
    feature_budget int, llm_ranking_budget int, llm_shared_ranking_enabled boolean, config_hash string,
    data_version struct<path: string, file_count: int, files: array<struct<name: string, size_bytes: long, modified_utc: string>>>,
    random_seed long, output_folder string, error string, failed_at string,
    llm_calls_actually_made long, llm_cache_hits long, llm_cache_key string, llm_metadata_signatures array<string>,
    llm_prompt_tokens long, llm_completion_tokens long, llm_total_tokens long, _corrupt_record string
"""


@dataclass
class RunStore:
    """Artifacts under one root. Writing a run replaces only that run's partition."""

    root: str

    def path(self, artifact: str) -> str:
        return f"{self.root}/{artifact}"

    def write(self, artifact: str, df: DataFrame, run_id: str, mode: str = "overwrite") -> None:
        """``overwrite`` replaces the run's rows, ``append`` adds to them."""
        (
            df.withColumn("run_id", F.lit(run_id))
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(self.path(artifact))
        )

    def write_csv(self, artifact: str, df: DataFrame, run_id: str) -> None:
        """The same artifact as CSV beside the datasets, for people."""
        df.write.mode("overwrite").option("header", True).csv(f"{self.root}/csv/{artifact}/{run_id}")

    def read(self, spark: SparkSession, artifact: str, runs: Sequence[str] | None = None) -> DataFrame | None:
        """Rows of an artifact, None when no run wrote it. A run list prunes partitions."""
        try:
            df = spark.read.option("mergeSchema", True).parquet(self.path(artifact))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        df = df.withColumn("run_id", F.col("run_id").cast("string"))
        return df if runs is None else df.where(F.col("run_id").isin(list(runs)))

    def runs_with(self, spark: SparkSession, artifact: str) -> DataFrame:
        """Runs that wrote an artifact; only partition names are looked at."""
        df = self.read(spark, artifact)
        return spark.createDataFrame([], "run_id string") if df is None else df.select("run_id").distinct()

    def missing_artifacts(self, spark: SparkSession, runs: DataFrame) -> DataFrame:
        """(run_id, artifact) still to be written; ``runs`` has (run_id, experiment_type)."""
        names = [*REQUIRED_ARTIFACTS, *RANKED_ARTIFACTS, *HYBRID_ARTIFACTS]
        present = None
        for name in names:
            part = self.runs_with(spark, name).withColumn("artifact", F.lit(name))
            present = part if present is None else present.unionByName(part)
        return missing_pairs(runs, present)


def missing_pairs(runs: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (run_id, artifact) pairs that are not present."""
    kind = F.col("experiment_type")
    array = lambda names: F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    wanted = F.concat(
        array(REQUIRED_ARTIFACTS),
        F.when(kind.isin("llm", "hybrid"), array(RANKED_ARTIFACTS)).otherwise(none),
        F.when(kind == "hybrid", array(HYBRID_ARTIFACTS)).otherwise(none),
    )
    expected = runs.select("run_id", F.explode(wanted).alias("artifact"))
    return expected.join(present.select("run_id", "artifact").distinct(), ["run_id", "artifact"], "left_anti")


def completed_runs(runs: DataFrame, present: DataFrame) -> DataFrame:
    """Runs with every expected artifact."""
    return runs.join(missing_pairs(runs, present).select("run_id").distinct(), "run_id", "left_anti")


# ---- Run folders ----

def run_folder(path: Column, depth: int) -> Column:
    """Folder ``depth`` levels above a file."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - depth), "/")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every ``run_manifest.json`` below the root but not in it; unreadable ones are left out."""
    raw = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "run_manifest.json")
        .json(root)
        .select("*", run_folder(F.col("_metadata.file_path"), 1).alias("run_folder"))
    )
    base = "/" + root.split(":", 1)[-1].strip("/")
    inside = ~F.rtrim(F.col("run_folder"), F.lit("/")).endswith(base)
    return raw.where(F.col("_corrupt_record").isNull() & inside).drop("_corrupt_record")


def read_run_csv(spark: SparkSession, root: str, file_name: str, schema: str | None = None) -> DataFrame | None:
    """One CSV per run folder (``<run>/<kind>/<file>``) as one table with ``run_folder``; None when absent."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        df = reader.csv(root)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df.select("*", run_folder(F.col("_metadata.file_path"), 2).alias("run_folder"))


def allowed_runs(manifests: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Only runs whose folder is listed; no list allows all."""
    if listed is None:
        return manifests
    return manifests.join(listed.select("output_folder").distinct(), "output_folder", "left_semi")


def read_fold_features(spark: SparkSession, folder: str) -> DataFrame:
    """(fold_id, feature_name, rank, score, semantic_group) of one run, from the combined file if present.

    Otherwise ``fold_*/selected_features.csv`` is read and the fold taken from the folder's name.
    """
    columns = ["fold_id", "feature_name", "rank", "score", "semantic_group"]

    def tidy(df: DataFrame) -> DataFrame:
        names = [quoted(c).cast("string") for c in ("feature_name", "feature") if c in df.columns]
        filled = df.withColumn("feature_name", F.coalesce(*names))
        for c in columns:
            if c not in filled.columns:
                filled = filled.withColumn(c, F.lit(None))
        return filled.select(
            F.col("fold_id").cast("string").try_cast("double").cast("int").alias("fold_id"),
            "feature_name",
            F.col("rank").cast("string").try_cast("double").alias("rank"),
            F.col("score").cast("string").try_cast("double").alias("score"),
            F.col("semantic_group").cast("string").alias("semantic_group"),
        ).where(F.col("fold_id").isNotNull())

    combined = _csv_or_none(spark, f"{folder}/fold_selected_features.csv")
    if combined is not None and "fold_id" in combined.columns:
        found = tidy(combined)
        if not found.isEmpty():
            return found
    parts = _csv_or_none(spark, f"{folder}/fold_*/selected_features.csv")
    if parts is None:
        return spark.createDataFrame([], "fold_id int, feature_name string, rank double, score double, semantic_group string")
    named = F.regexp_extract(F.col("_metadata.file_path"), r"fold_([^/]*)/selected_features\.csv", 1)
    return tidy(parts.withColumn("fold_id", F.coalesce(*[
        *([F.col("fold_id").cast("string")] if "fold_id" in parts.columns else []), F.element_at(F.split(named, "_"), -1)
    ])))


def _csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# ---- Identity ----

def canonical_json(payload: Mapping[str, Any]) -> str:
    return json.dumps(payload, sort_keys=True, ensure_ascii=True, default=str)


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[ /\\]", "_")


def run_identity(model: Column, kind: Column, selector: Column, config_hash: Column) -> Column:
    """Stable run id: what was run and the first 12 characters of the settings' hash."""
    return F.concat_ws("_", model, kind, safe_label(selector), F.substring(config_hash, 1, 12))
