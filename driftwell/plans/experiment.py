"""A whole run: cross-validation in DEV, a final fit on all of DEV, measurement out of time, artifacts."""

from __future__ import annotations

import hashlib
import json
import time as clock
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.drift import psi_summary, score_psi, selected_feature_psi
from driftwell.operators.reports import experiment_summary, ranking_call_stats
from driftwell.operators.scoring import evaluate, flag_at, lift_and_capture
from driftwell.operators.selection import hybrid_trace, selection_rows
from driftwell.operators.stability import group_frequency, selection_frequency, stability_bundle
from driftwell.operators.timeline import EXCLUDED_FEATURES, leakage_report, split_manifest
from driftwell.plans.folds import CrossValidation, Fit, ModelSpec, fit_training, metrics_frame, run_folds
from driftwell.plans.prepare import Prepared
from driftwell.session import written_table
from driftwell.sources.runs import RunStore, canonical_json


# Fixed value: the seed of models that do not name one.
DEFAULT_SEED = 42


@dataclass
class ExperimentResult:
    run_id: str
    cross_validation: CrossValidation
    final: Fit
    oot_metrics: dict[str, Any]
    predictions: DataFrame
    drift: DataFrame
    stability: DataFrame
    summary: DataFrame
    timings: dict[str, float] = field(default_factory=dict)


def run_experiment(
    prepared: Prepared, spec: ModelSpec, run_id: str, n_splits: int = 5, gap: int = 1, feature_budget: int = 20,
    experiment_type: str = "statistical", excluded: tuple[str, ...] = EXCLUDED_FEATURES, store: RunStore | None = None,
    fingerprint: str | None = None,
) -> ExperimentResult:
    """OOT rows are used once, to measure the final model; nothing is fitted or chosen on them.

    ``fingerprint`` names the version of the data (see ``data_fingerprint``). A run that stops leaves a manifest with its
    error in the store.
    """
    try:
        return _run(prepared, spec, run_id, n_splits, gap, feature_budget, experiment_type, excluded, store, fingerprint)
    except Exception as error:
        if store is not None:
            spark = prepared.data.sparkSession
            facts = [(
                "failed", spec.model, spec.selector_name, experiment_type, feature_budget, f"{type(error).__name__}: {error}"[:2_000], _now(),
                fingerprint or "",
            )]
            kinds = "status string, model string, selector string, experiment_type string, feature_budget long, error string, failed_at string, data_fingerprint string"
            store.write("run_manifest", spark.createDataFrame(facts, kinds), run_id)
        raise


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _run(
    prepared: Prepared, spec: ModelSpec, run_id: str, n_splits: int, gap: int, feature_budget: int, experiment_type: str,
    excluded: tuple[str, ...], store: RunStore | None, fingerprint: str | None,
) -> ExperimentResult:
    start = clock.time()
    spark = prepared.data.sparkSession
    key, label = prepared.key, prepared.target
    report = leakage_report(prepared.data, prepared.features, prepared.time, label, excluded)
    dev, oot = prepared.dev, prepared.oot
    cv = run_folds(dev, key, label, prepared.time, prepared.features, spec, n_splits, gap)

    fit = fit_training(dev, key, label, prepared.features, spec)
    measured = clock.time()
    oot_ready = fit.prepare(oot, key, label)
    scores = written_table(fit.model.score(oot_ready, key, label))
    predictions = scores.select(
        key, F.col(label).alias("y_true"), F.col("score").alias("y_pred_proba"),
        flag_at(F.col("score"), fit.threshold).alias("y_pred"),
    )
    # Feature-sized: kept as rows, since it is summarised, joined and stored.
    drift = selected_feature_psi(fit.train_ready, oot_ready, fit.model.features)
    drift = spark.createDataFrame(drift.collect(), drift.schema)
    utility = lift_and_capture(scores, label, "score", key, (0.1, 0.2)).first().asDict()
    model_psi = score_psi(fit.train_scores, scores, "score")
    metrics = evaluate(scores, label, "score", threshold=fit.threshold).first().asDict()
    fit.release()
    n, candidates = len(fit.selected), len(prepared.features)
    metrics |= {
        "selected_feature_count": n,
        "total_candidate_feature_count": candidates,
        "feature_budget": feature_budget,
        "feature_reduction_ratio": 1.0 - n / candidates if candidates else None,
    }
    metrics |= {f"{m}_per_feature": (metrics[m] / n if n and metrics[m] is not None else None) for m in ("gini", "auc", "ks")}
    metrics |= psi_summary(drift).first().asDict() | {"model_score_psi": model_psi} | utility

    stability = stability_bundle(cv.selection, candidates, cv.rankings)
    stability = spark.createDataFrame(stability.collect(), stability.schema)
    timings = {f"final_{name}_time_sec": seconds for name, seconds in fit.timings.items()}
    timings |= {
        "final_evaluation_time_sec": clock.time() - measured,
        "cv_runtime_seconds": cv.runtime_seconds,
        "total_runtime_seconds": clock.time() - start,
    }
    final_log = selection_rows(dev, fit.selected, fit.selector.scores if fit.selector else {}, spec.selector_name, None)
    run = spark.createDataFrame(
        [(run_id, spec.model, spec.selector_name, experiment_type, timings["total_runtime_seconds"])],
        "run_id string, model_name string, selector_name string, experiment_type string, runtime_seconds double",
    )
    oot_row = metrics_frame(spark, [metrics])
    with_run = lambda df: df.withColumn("run_id", F.lit(run_id))
    summary = experiment_summary(run, with_run(cv.results), with_run(oot_row), with_run(stability), with_run(final_log))
    result = ExperimentResult(run_id, cv, fit, metrics, predictions, drift, stability, summary, timings)
    if store is not None:
        _store(store, result, prepared, spec, report, final_log, oot_row, utility, model_psi, experiment_type, feature_budget, fingerprint)
    return result


def _store(
    store: RunStore, result: ExperimentResult, prepared: Prepared, spec: ModelSpec, report: DataFrame,
    final_log: DataFrame, oot_row: DataFrame, utility: dict, model_psi: float | None, experiment_type: str, budget: int,
    fingerprint: str | None = None,
) -> None:
    """Write every artifact of a finished run."""
    spark, run_id, cv = prepared.data.sparkSession, result.run_id, result.cross_validation
    settings = {
        "model": spec.model, "settings": dict(spec.settings), "preprocessing": dict(spec.preprocessing),
        "selector": spec.selector_name, "feature_budget": budget, "windows": vars(prepared.windows),
    }
    digest = hashlib.sha256(canonical_json(settings).encode()).hexdigest()
    row = lambda values: spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) or v is None else 'string'}"
        for k, v in values.items()
    ))
    audit = row({k: int(v) for k, v in prepared.audit.items()}).first().asDict()
    artifacts = {
        "leakage_report": report,
        "data_split_manifest": split_manifest(prepared.data, prepared.time, prepared.target).withColumns(
            {k: F.lit(v) for k, v in audit.items()}
        ),
        "cv_results": cv.results,
        "fold_selected_features": cv.selection,
        "out_of_fold_scores": cv.out_of_fold,
        "selection_frequency": selection_frequency(cv.selection),
        "semantic_group_stability": group_frequency(cv.selection),
        "feature_stability_metrics": result.stability,
        "final_selected_features": final_log,
        "oot_test_results": oot_row,
        "oot_predictions": result.predictions,
        "selected_feature_psi": result.drift,
        "model_score_psi": row({"model_score_psi": model_psi}),
        "credit_risk_utility": row(utility),
        "runtime_summary": row(result.timings),
        "experiment_summary": result.summary.drop("run_id"),
        "model_metadata": row({
            "model": spec.model, "selector": spec.selector_name, "experiment_type": experiment_type,
            "feature_order": json.dumps(result.final.model.features),
            "preprocessor": json.dumps(result.final.preprocessor.settings(), sort_keys=True),
            "training_scope": "full_DEV", "target_column": prepared.target, "config_hash": digest,
        }),
    }
    traces = [
        hybrid_trace(_ranks(spark, fold.ranked), _ranks(spark, fold.selected)).withColumns(
            {"scope": F.lit("fold"), "fold_id": F.lit(fold.fold).cast("int")}
        )
        for fold in cv.fold_results if fold.ranked
    ]
    if result.final.ranked:
        traces.append(
            hybrid_trace(_ranks(spark, result.final.ranked), _ranks(spark, result.final.selected)).withColumns(
                {"scope": F.lit("final_dev"), "fold_id": F.lit(None).cast("int")}
            )
        )
    for name, df in artifacts.items():
        store.write(name, df, run_id)
    if cv.rankings is not None:
        rankings = cv.rankings.unionByName(result.final.selector.log(spark))
        store.write("llm_rankings_summary", rankings, run_id)
    if traces:
        # Written at once, so that a second run of one id replaces the first.
        store.write("llm_hybrid_trace", reduce(DataFrame.unionByName, traces), run_id)
    result.final.scoring_path().save(spark, f"{store.root}/models/{run_id}")
    # The manifest is written last: a run with a manifest is a finished run.
    calls = ranking_call_stats(rankings, keys=()).first().asDict() if cv.rankings is not None else {}
    signatures = calls.pop("llm_metadata_signatures", None)
    manifest = row({
        "status": "completed", "model": spec.model, "selector": spec.selector_name,
        "experiment_type": experiment_type, "feature_budget": budget, "config_hash": digest,
        "timestamp": _now(), "preprocessing_hash": hashlib.sha256(canonical_json(dict(spec.preprocessing)).encode()).hexdigest(),
        "random_seed": int(spec.settings.get("seed", DEFAULT_SEED)), "n_training_rows": int(audit.get("dev_rows", 0)),
        "total_candidate_feature_count": len(prepared.features), "data_fingerprint": fingerprint or "",
        "runtime_seconds": float(result.timings["total_runtime_seconds"]), "error": "", **{k: int(v or 0) for k, v in calls.items()},
    })
    listed = F.array(*[F.lit(s) for s in signatures or []]).cast("array<string>")
    store.write("run_manifest", manifest.withColumn("llm_metadata_signatures", listed), run_id)


def _ranks(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(names)], "feature string, rank int")
