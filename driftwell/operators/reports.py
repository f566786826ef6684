"""Cross-run tables: summaries, paired deltas, the run comparison table, call and failure summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.labels import help_label, window_label
from driftwell.functions.numbers import share
from driftwell.operators.scoring import NORMAL_95, fold_rows
from driftwell.operators.stability import fold_overlap
from driftwell.session import single_row

# ---- Fixed values: metric names and table columns, in order. ----
FOLD_METRICS = [
    "auc", "gini", "ks", "precision", "recall", "f1", "accuracy", "selected_features", "psi_feature_mean",
    "psi_feature_max", "psi_model", "jaccard_similarity", "fold_time_sec",
]
OOT_METRICS = [
    "auc", "gini", "ks", "log_loss", "brier", "precision", "recall", "f1", "accuracy", "decision_threshold",
    "selected_feature_count", "total_candidate_feature_count", "feature_budget", "feature_reduction_ratio",
    "gini_per_feature", "auc_per_feature", "ks_per_feature", "selected_feature_psi_mean",
    "selected_feature_psi_max", "selected_feature_psi_median", "selected_feature_psi_high_drift_ratio",
    "selected_feature_psi_moderate_or_high_drift_ratio", "model_score_psi", "lift_at_10",
    "bad_rate_capture_at_10", "lift_at_20", "bad_rate_capture_at_20",
]
COMPARED_METRICS = [
    "cv_auc_mean", "cv_gini_mean", "cv_ks_mean", "cv_precision_mean", "cv_recall_mean", "cv_f1_mean",
    "cv_accuracy_mean", "cv_selected_features_mean", "cv_psi_feature_mean_mean", "cv_psi_feature_max_mean",
    "cv_psi_model_mean", "cv_jaccard_similarity_mean", "oot_auc", "oot_gini", "oot_ks", "oot_precision",
    "oot_recall", "oot_f1", "oot_accuracy",
]
FINAL_COLUMNS = [
    "model", "selector", "experiment_type", "feature_budget", "llm_shared_ranking_enabled", "llm_ranking_budget",
    "oot_auc", "oot_gini", "oot_ks", "oot_log_loss", "oot_brier", "nogueira_stability", "kuncheva_stability",
    "mean_pairwise_jaccard", "semantic_group_jaccard", "stable_feature_count_80", "stable_feature_ratio_80",
    "stable_semantic_group_count_80", "semantic_group_stable_ratio_80", "spearman_rank_stability_mean",
    "kendall_rank_stability_mean", "rbo_rank_stability_mean", "selected_feature_psi_mean",
    "selected_feature_psi_max", "selected_feature_psi_median", "selected_feature_psi_high_drift_ratio",
    "selected_feature_psi_moderate_or_high_drift_ratio", "model_score_psi", "selected_feature_count",
    "total_candidate_feature_count", "feature_reduction_ratio", "oot_gini_per_feature", "oot_auc_per_feature",
    "oot_ks_per_feature", "lift_at_10", "bad_rate_capture_at_10", "lift_at_20", "bad_rate_capture_at_20",
    "config_hash", "data_fingerprint", "run_id", "output_folder", "runtime_seconds",
]
TEXT_COLUMNS = {"model", "selector", "experiment_type", "config_hash", "data_fingerprint", "run_id", "output_folder"}
CALL_COLUMNS = [
    "run_id", "model", "selector", "experiment_type", "status", "llm_shared_ranking_enabled",
    "llm_ranking_budget", "llm_calls_actually_made", "llm_cache_hits", "llm_cache_key",
    "llm_metadata_signatures", "llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens",
    "runs_sharing_metadata_signatures", "output_folder",
]
FAILED_COLUMNS = [
    "run_id", "model", "selector", "experiment_type", "status", "error", "failed_at", "output_folder",
]
STABILITY_TABLE = [
    "model", "selector", "experiment_type", "nogueira_stability", "kuncheva_stability",
    "mean_pairwise_jaccard", "stable_feature_count_80", "stable_feature_ratio_80",
]
TEMPORAL_METRICS = ["auc", "gini", "ks", "psi_feature_mean", "psi_model", "jaccard_similarity", "lift_at_10", "bad_rate_capture_at_10"]
# Plain summary names of metrics the run table takes from the out-of-time part.
RUN_TABLE_SOURCES = {c: f"oot_{c}" for c in FINAL_COLUMNS if c in OOT_METRICS}
# ---- End of fixed values. ----


def efficiency_columns(features: str = "selected_feature_count", candidates: str = "total_candidate_feature_count") -> dict[str, Column]:
    """Reduction ratio and metric per selected feature."""
    n = F.col(features)
    return {"feature_reduction_ratio": 1 - share(n, F.col(candidates))} | {
        f"{m}_per_feature": share(F.col(m), n) for m in ("gini", "auc", "ks")
    }


def _number(name: str) -> Column:
    value = F.col(name).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def fold_summary(cv: DataFrame, key: str = "run_id") -> DataFrame:
    """``cv_<metric>_mean`` and ``cv_<metric>_std`` over the number folds of each run."""
    folds = fold_rows(cv)
    present = [m for m in FOLD_METRICS if m in cv.columns]
    aggregates = [F.count(F.lit(1)).alias("cv_fold_count")]
    for m in present:
        aggregates += [F.avg(_number(m)).alias(f"cv_{m}_mean"), F.stddev_samp(_number(m)).alias(f"cv_{m}_std")]
    return folds.groupBy(key).agg(*aggregates)


def experiment_summary(
    runs: DataFrame, cv: DataFrame, oot: DataFrame | None = None, stability: DataFrame | None = None,
    final_features: DataFrame | None = None, key: str = "run_id",
) -> DataFrame:
    """One wide row per run: fold means and deviations, out-of-time metrics, stability, feature count.

    All inputs are run-sized or run x fold-sized; absent artifacts leave NULLs.
    """
    summary = runs.join(fold_summary(cv, key), key, "left")
    if oot is not None:
        present = [m for m in OOT_METRICS if m in oot.columns]
        summary = summary.join(oot.groupBy(key).agg(*[F.avg(_number(m)).alias(f"oot_{m}") for m in present]), key, "left")
    if stability is not None:
        summary = summary.join(stability.dropDuplicates([key]), key, "left")
    if final_features is not None:
        counted = final_features.groupBy(key).agg(F.count_distinct("feature").alias("final_selected_feature_count"))
        summary = summary.join(counted, key, "left")
    return summary


def runtime_seconds(runs: DataFrame, runtime: DataFrame | None, cv: DataFrame | None, summary: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """Run time by order of trust: runtime table, summary, sum of the folds, mean of the folds."""
    choices: list[Column] = []
    joined = runs.select(key)
    if runtime is not None:
        joined = joined.join(runtime.groupBy(key).agg(F.first("total_runtime_seconds", ignorenulls=True).alias("_r")), key, "left")
        choices.append(F.col("_r"))
    if summary is not None and "runtime_seconds" in summary.columns:
        joined = joined.join(summary.select(key, F.col("runtime_seconds").alias("_s")), key, "left")
        choices.append(F.col("_s"))
    if cv is not None and "fold_time_sec" in cv.columns:
        folds = fold_rows(cv).groupBy(key).agg(F.sum(_number("fold_time_sec")).alias("_f"))
        joined = joined.join(folds, key, "left")
        choices.append(F.col("_f"))
    if summary is not None and "cv_fold_time_sec_mean" in summary.columns:
        joined = joined.join(summary.select(key, F.col("cv_fold_time_sec_mean").alias("_m")), key, "left")
        choices.append(F.col("_m"))
    value = F.coalesce(*choices) if choices else F.lit(None).cast("double")
    return joined.select(key, value.cast("double").alias("runtime_seconds"))


def run_table(manifests: DataFrame, summary: DataFrame, runtime: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """Completed runs, one wide row each, in the fixed column order.

    A manifest value wins over the summary's; the selected count falls back to the final feature list.
    Bootstrap intervals, when given, follow the fixed columns.
    """
    done = manifests.where(F.col("status") == "completed")
    joined = done.alias("m").join(summary.alias("s"), "run_id")
    if runtime is not None:
        joined = joined.join(runtime.withColumnRenamed("runtime_seconds", "_runtime"), "run_id", "left")

    def pick(*names: str) -> Column:
        """First side that has the column; absent ones are NULL numbers, or NULL text for text columns."""
        found = []
        for name in names:
            side, column = name.split(".", 1)
            frame = done if side == "m" else summary
            if column in frame.columns:
                found.append(F.col(f"{side}.{column}"))
        kind = "string" if names[0].split(".", 1)[1] in TEXT_COLUMNS else "double"
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    sources: dict[str, Column] = {"run_id": F.col("run_id")}
    for name in FINAL_COLUMNS[1:] + FINAL_COLUMNS[:1]:
        if name in sources:
            continue
        sources[name] = pick(f"m.{name}", f"s.{RUN_TABLE_SOURCES.get(name, name)}")
    sources["model"] = pick("m.model", "s.model_name")
    sources["selector"] = pick("m.selector", "s.selector_name")
    sources["feature_budget"] = pick("m.feature_budget", "s.oot_feature_budget")
    sources["selected_feature_count"] = pick("s.oot_selected_feature_count", "s.final_selected_feature_count")
    sources["mean_pairwise_jaccard"] = pick("s.mean_pairwise_jaccard", "s.cv_jaccard_similarity_mean")
    if "data_version" in done.columns:
        sources["data_fingerprint"] = F.to_json("m.data_version")
    if "run_folder" in done.columns:
        sources["output_folder"] = F.col("m.run_folder")
    sources["runtime_seconds"] = F.col("_runtime") if runtime is not None else pick("s.runtime_seconds")
    table = joined.select(*[sources[c].alias(c) for c in FINAL_COLUMNS])
    if intervals is not None:
        table = table.join(intervals, "run_id", "left").select(*FINAL_COLUMNS, *[c for c in intervals.columns if c != "run_id"])
    return table.orderBy("model", F.col("oot_gini").desc_nulls_last(), F.col("oot_ks").desc_nulls_last(), "run_id")


def paired_fold_deltas(cv: DataFrame, runs: DataFrame, metrics: Sequence[str] = ("auc", "gini")) -> DataFrame:
    """Mean fold-by-fold difference to each model's baseline run, with a normal 95 % interval.

    The baseline is the model's first statistical mRMR run. ``runs`` has (run_id, model, selector,
    experiment_type).
    """
    is_baseline = (F.col("experiment_type") == "statistical") & (F.col("selector") == "mrmr")
    baselines = runs.where(is_baseline).groupBy("model").agg(F.min("run_id").alias("baseline_run_id"))
    folds = fold_rows(cv).select("run_id", "fold", *[_number(m).alias(m) for m in metrics])
    base = folds.select(F.col("run_id").alias("baseline_run_id"), "fold", *[F.col(m).alias(f"{m}_baseline") for m in metrics])
    candidates = (
        runs.join(baselines, "model").where(F.col("run_id") != F.col("baseline_run_id"))
        .join(folds, "run_id")
        .join(base, ["baseline_run_id", "fold"])
    )
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(m) - F.col(f"{m}_baseline")).alias("delta")) for m in metrics
    ])
    long = candidates.select(
        "model", "baseline_run_id", F.col("run_id").alias("candidate_run_id"),
        F.col("selector").alias("candidate_selector"), F.col("experiment_type").alias("candidate_experiment_type"),
        F.explode(cells).alias("cell"),
    ).select("*", "cell.metric", "cell.delta").drop("cell")
    keys = [c for c in long.columns if c != "delta"]
    margin = NORMAL_95 * F.coalesce(F.stddev_samp("delta"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg("delta").alias("mean_delta_candidate_minus_baseline"),
        (F.avg("delta") - margin).alias("ci95_lower"),
        (F.avg("delta") + margin).alias("ci95_upper"),
    )


def compare_pair(
    summary: DataFrame, log: DataFrame, left_run: str, right_run: str, final_log: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(one comparison row, overlap rows) of two runs: both values and right minus left for each metric."""
    def rows(frame: DataFrame, run: str) -> DataFrame:
        return frame.where(F.col("run_id") == run).drop("run_id")

    overlap = fold_overlap(rows(log, left_run), rows(log, right_run)).select(
        F.lit("fold").alias("stage"), F.col("fold_id").cast("int").alias("fold"), "left_feature_count", "right_feature_count",
        "intersection_count", "union_count", "jaccard_similarity",
    )
    if final_log is not None:
        lone = lambda run: rows(final_log, run).select(F.lit(0).alias("fold_id"), "feature_name")
        final = fold_overlap(lone(left_run), lone(right_run)).where("left_feature_count > 0 and right_feature_count > 0")
        overlap = overlap.unionByName(
            final.select(F.lit("final").alias("stage"), F.lit(None).cast("int").alias("fold"), *overlap.columns[2:])
        )
    side = lambda frame, name: frame.select(*[
        (F.col(m) if m in summary.columns else F.lit(None).cast("double")).alias(f"{name}_{m}") for m in COMPARED_METRICS
    ])
    in_fold, in_final = F.col("stage") == "fold", F.col("stage") == "final"
    shared = overlap.agg(
        F.count_if(in_fold).alias("feature_overlap_fold_count"),
        F.avg(F.when(in_fold, F.col("jaccard_similarity"))).alias("feature_overlap_fold_jaccard_mean"),
        F.stddev_samp(F.when(in_fold, F.col("jaccard_similarity"))).alias("feature_overlap_fold_jaccard_std"),
        F.max(F.when(in_final, F.col("jaccard_similarity"))).alias("feature_overlap_final_jaccard"),
        F.max(F.when(in_final, F.col("intersection_count"))).alias("feature_overlap_final_intersection_count"),
    )
    joined = single_row(side(rows(summary, left_run), "left"), side(rows(summary, right_run), "right"), shared)
    deltas = {
        f"delta_{m}_right_minus_left": F.round(F.col(f"right_{m}") - F.col(f"left_{m}"), 12) for m in COMPARED_METRICS
    }
    return joined.withColumns(deltas), overlap


def help_summary(comparisons: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Label each comparison by whether both AUCs moved the same way, best out-of-time gain first."""
    cv, oot = F.col("delta_cv_auc_mean_right_minus_left"), F.col("delta_oot_auc_right_minus_left")
    return comparisons.withColumn("helped", help_label(cv, oot, tolerance)).orderBy(oot.desc_nulls_last())


# ---- Ranking calls ----

def ranking_call_stats(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Calls, cache hits and tokens per run; a call is one (scope, fold, signature), tokens count once."""
    # The rows of one call repeat its cache flag and token counts.
    number = lambda c: F.max(F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))).alias(c)
    calls = log.groupBy(*keys, "scope", "fold_id", "metadata_signature").agg(
        F.max(F.lower(F.col("cache_hit").cast("string")).isin("true", "1")).alias("hit"),
        *[number(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )
    hit = F.coalesce(F.col("hit"), F.lit(False))
    tokens = lambda c: F.sum(F.when(~hit, F.col(c)).otherwise(0.0)).cast("long")
    return calls.groupBy(*keys).agg(
        F.array_sort(F.collect_set("metadata_signature")).alias("llm_metadata_signatures"),
        F.count_if(~hit).alias("llm_calls_actually_made"),
        F.count_if(hit).alias("llm_cache_hits"),
        tokens("prompt_tokens").alias("llm_prompt_tokens"),
        tokens("completion_tokens").alias("llm_completion_tokens"),
        tokens("total_tokens").alias("llm_total_tokens"),
    )


def sharing_classes(df: DataFrame, key: str = "run_id", signatures: str = "signatures", separator: str = ";") -> tuple[DataFrame, DataFrame]:
    """(key, class_id) of every run, and (class_id, signatures, runs, sharing) of every distinct set of signatures.

    ``runs`` are the runs with that set, ``sharing`` the classes that share any signature with it, itself included. Runs are
    listed once, in their class, and classes are joined instead of runs: with one signature for all runs there is one class.
    Runs without a signature are in no class.
    """
    parts = F.filter(F.array_distinct(F.split(signatures, separator)), lambda s: s != "")
    held = df.select(key, parts.alias("_parts"))
    sets = held.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_parts")))).alias("signatures")).where(F.size("signatures") > 0)
    members = sets.select(key, "signatures", F.sha2(F.array_join("signatures", "\n"), 256).alias("class_id"))
    classes = members.groupBy("class_id").agg(F.first("signatures").alias("signatures"), F.array_sort(F.collect_set(key)).alias("runs"))
    by_signature = classes.select("class_id", F.explode("signatures").alias("signature"))
    holders = by_signature.groupBy("signature").agg(F.collect_set("class_id").alias("holders"))
    sharing = by_signature.join(holders, "signature").groupBy("class_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("sharing")
    )
    return members.select(key, "class_id"), classes.join(sharing, "class_id")


def runs_sharing(df: DataFrame, key: str = "run_id", signatures: str = "signatures", separator: str = ";") -> DataFrame:
    """All runs that share any signature with a run, itself included, sorted and joined.

    The list is made once per class of runs with equal signatures (see ``sharing_classes``) and looked up by each run.
    """
    members, classes = sharing_classes(df, key, signatures, separator)
    neighbours = classes.select("class_id", F.explode("sharing").alias("_other"))
    runs = classes.select(F.col("class_id").alias("_other"), "runs")
    listed = neighbours.join(runs, "_other").groupBy("class_id").agg(
        F.array_join(F.array_sort(F.flatten(F.collect_list("runs"))), separator).alias("_all")
    )
    found = members.join(listed, "class_id")
    return df.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("_all", F.lit("")).alias("runs_sharing_metadata_signatures")
    )


def call_summary(manifests: DataFrame) -> DataFrame:
    """Calls and tokens per run from the manifests, with the runs that share a ranking."""
    listed = manifests.withColumn(
        "llm_metadata_signatures", F.coalesce(F.array_join("llm_metadata_signatures", ";"), F.lit(""))
    )
    counts = ["llm_calls_actually_made", "llm_cache_hits", "llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens"]
    filled = listed.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    sharing = runs_sharing(filled, "run_id", "llm_metadata_signatures")
    folder = F.col("run_folder") if "run_folder" in manifests.columns else F.col("output_folder")
    return filled.withColumn("output_folder", folder).join(sharing, "run_id", "left").select(*CALL_COLUMNS)


def failed_runs(manifests: DataFrame) -> DataFrame:
    return manifests.where(F.col("status") == "failed").select(*FAILED_COLUMNS)


# ---- Report tables ----

def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean of a metric by two labels; the column labels are given, so no extra job finds them."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def temporal_table(folds: DataFrame, label: str = "label") -> DataFrame:
    """Fold metrics with the calendar label of each validation window."""
    present = [m for m in TEMPORAL_METRICS if m in folds.columns]
    return fold_rows(folds).select(
        label, "fold", window_label(F.col("val_time_start"), F.col("val_time_end")).alias("month_label"),
        "val_time_start", "val_time_end", *[_number(m).alias(m) for m in present],
    )


def temporal_table_name(table: DataFrame) -> str:
    """Monthly once at least two different windows are covered."""
    distinct = table.select("month_label").distinct().limit(2).count()
    return "monthly_metric_table" if distinct >= 2 else "temporal_metric_table"


def attach_time_info(folds: DataFrame, info: DataFrame) -> DataFrame:
    """Fold metrics with separately stored window bounds."""
    extra = [c for c in info.columns if c not in folds.columns or c == "fold"]
    return folds.join(info.select(*extra), "fold", "left")


def oot_table(oot: DataFrame, label: str = "label") -> DataFrame:
    """One out-of-time row per run, metrics prefixed."""
    present = [m for m in OOT_METRICS if m in oot.columns]
    return oot.select(label, *[F.col(m).alias(f"oot_{m}") for m in present])


def stability_table(runs: DataFrame) -> DataFrame:
    return runs.select(*[(F.col(c) if c in runs.columns else F.lit(None).cast("string" if c in TEXT_COLUMNS else "double")).alias(c) for c in STABILITY_TABLE])


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Best out-of-time AUC first, then best fold AUC."""
    return runs.orderBy(F.col("oot_auc").desc_nulls_last(), F.col("cv_auc_mean").desc_nulls_last())


