"""One train/validation fit and the cross-validation over time folds."""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.drift import feature_psi, score_psi
from driftwell.operators.models import ScoreModel, fit_model
from driftwell.operators.preprocess import Preprocessor
from driftwell.operators.scoring import decision_threshold, evaluate, flag_at, lift_and_capture, with_summary_rows
from driftwell.operators.selection import RankedThenStatistical, Selector, StableCoreFill, selection_rows
from driftwell.operators.stability import jaccard_with_previous
from driftwell.operators.timeline import TimeFold, fold_info, grouped_time_folds, last_fold_scores
from driftwell.operators.wrappers import BorutaRfeSelector
from driftwell.plans.scoring_path import ScoringPath
from driftwell.session import written_table


# Folds that run beside each other.
FOLDS_AT_ONCE = 3


@dataclass
class ModelSpec:
    """What to fit: model kind and settings, preprocessing, and a maker of fresh selectors."""

    model: str = "lr"
    settings: Mapping[str, Any] = field(default_factory=dict)
    preprocessing: Mapping[str, Any] = field(default_factory=dict)
    selector: Callable[[], Selector] | None = None
    selector_name: str = "none"


@dataclass
class Fit:
    """Everything learned on training rows."""

    preprocessor: Preprocessor
    selector: Selector | None
    model: ScoreModel
    selected: list[str]
    ranked: list[str]
    threshold: float
    train_ready: DataFrame
    train_scores: DataFrame
    timings: dict[str, float]
    held: DataFrame | None = None

    def prepare(self, df: DataFrame, key: str, label: str) -> DataFrame:
        prepared = self.preprocessor.transform(df, key, label)
        if self.selector is not None and self.selector.stage != "before":
            return self.selector.transform(prepared, key, label)
        return prepared

    def score(self, df: DataFrame, key: str, label: str) -> DataFrame:
        return self.model.score(self.prepare(df, key, label), key, label)

    def scoring_path(self) -> ScoringPath:
        """What it takes to score new rows, for saving."""
        return ScoringPath.of(self.preprocessor, self.selector, self.model, self.threshold)

    def release(self) -> None:
        """Give back the memory of the prepared training rows."""
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def fit_training(
    train: DataFrame, key: str, label: str, features: Sequence[str], spec: ModelSpec,
    scope: str = "final_dev", fold: int | None = None,
) -> Fit:
    """Select, prepare and train; selectors run on raw columns, on prepared columns, or on both.

    Only ``train`` is ever looked at. The threshold comes from the training scores, which are written once:
    ranking metrics and drift read them several times, and the model should not run again for each.
    """
    timings = dict.fromkeys(("preprocessing", "feature_selection", "training"), 0.0)

    def timed(name: str, work: Callable[[], Any]) -> Any:
        start = clock.time()
        result = work()
        timings[name] += clock.time() - start
        return result

    selector = spec.selector() if spec.selector else None
    stage = selector.stage if selector else None
    if hasattr(selector, "set_context"):
        selector.set_context(scope, fold)
    raw, ranked = list(features), []
    if stage in ("before", "both"):
        timed("feature_selection", lambda: selector.fit(train, label, features))
        raw = list(selector.selected)
        if isinstance(selector, (RankedThenStatistical, StableCoreFill)):
            ranked = list(selector.candidates)
    preprocessor = Preprocessor(**spec.preprocessing)
    timed("preprocessing", lambda: preprocessor.fit(train, raw))
    prepared = preprocessor.transform(train, key, label)
    # What a selector reads once is not worth keeping: the few columns it selects are kept instead.
    narrowed = stage == "after" and selector.reads_once
    if not narrowed:
        prepared.persist()
    columns = preprocessor.output_columns()
    if stage == "after":
        timed("feature_selection", lambda: selector.fit(prepared, label, columns))
    elif stage == "both":
        timed("feature_selection", lambda: selector.refine(prepared, label, columns))
    model_columns = list(selector.selected) if stage in ("after", "both") else columns
    if stage in ("after", "both"):
        ready = selector.transform(prepared, key, label)
    else:
        ready = prepared
    held = ready.persist() if narrowed else prepared
    model = timed("training", lambda: fit_model(spec.model, ready, model_columns, label, spec.settings))
    scores = written_table(model.score(ready, key, label))
    threshold = decision_threshold(scores, label, "score")
    selected = list(selector.selected) if selector else model_columns
    return Fit(preprocessor, selector, model, selected, ranked, threshold, ready, scores, timings, held)


@dataclass
class FoldResult:
    fold: int
    metrics: dict[str, Any]
    selection: DataFrame
    scores: DataFrame
    ranked: list[str]
    selected: list[str]
    ranking_log: DataFrame | None = None


def process_fold(
    fold: int, train: DataFrame, validation: DataFrame, key: str, label: str, features: Sequence[str], spec: ModelSpec
) -> FoldResult:
    """Fit on the training rows, measure on the validation rows."""
    start = clock.time()
    fit = fit_training(train, key, label, features, spec, "fold", fold)
    measured = clock.time()
    val_ready = fit.prepare(validation, key, label)
    drift = feature_psi(fit.train_ready, val_ready, fit.model.features).agg(
        F.avg("psi").alias("psi_feature_mean"), F.max("psi").alias("psi_feature_max")
    ).first().asDict()
    scores = written_table(fit.model.score(val_ready, key, label))
    metrics = {"fold": fold} | evaluate(scores, label, "score", threshold=fit.threshold).first().asDict()
    metrics |= lift_and_capture(scores, label, "score", key, (0.1,)).first().asDict()
    metrics |= drift
    metrics["psi_model"] = score_psi(fit.train_scores, scores, "score")
    metrics["selected_features"] = len(fit.selected)
    if isinstance(fit.selector, BorutaRfeSelector):
        metrics["boruta_selected_features"] = len(fit.selector.boruta.selected)
        metrics["rfe_selected_features"] = len(fit.selector.rfe.selected) if fit.selector.rfe else None
    metrics |= {f"{name}_time_sec": seconds for name, seconds in fit.timings.items()}
    metrics["evaluation_time_sec"] = clock.time() - measured
    metrics["fold_time_sec"] = clock.time() - start
    fit.release()
    flagged = scores.withColumns({"flag": flag_at(F.col("score"), fit.threshold), "fold": F.lit(fold)})
    log = selection_rows(train, fit.selected, fit.selector.scores if fit.selector else {}, spec.selector_name, fold)
    rankings = fit.selector.log(train.sparkSession) if hasattr(fit.selector, "log") else None
    return FoldResult(fold, metrics, log, flagged, fit.ranked, fit.selected, rankings)


@dataclass
class CrossValidation:
    """Fold-sized tables, and the out-of-fold scores of the validated rows."""

    folds: DataFrame
    results: DataFrame
    selection: DataFrame
    out_of_fold: DataFrame
    runtime_seconds: float
    fold_results: list[FoldResult]
    rankings: DataFrame | None = None

    def out_of_fold_metrics(self, label: str) -> DataFrame:
        """Metrics of the out-of-fold scores, each row flagged at its own fold's threshold."""
        return evaluate(self.out_of_fold, label, "score", flag="flag")


def metrics_frame(spark, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Fold rows as a DataFrame; whole numbers become doubles except counts of the fold itself."""
    names = list(rows[0])
    whole = ("fold", "tn", "fp", "fn", "tp", "selected_features")
    schema = ", ".join(f"{n} {'long' if n in whole else 'double'}" for n in names)
    cells = [tuple(None if r[n] is None else (int(r[n]) if n in whole else float(r[n])) for n in names) for r in rows]
    return spark.createDataFrame(cells, schema)


def run_folds(
    dev: DataFrame, key: str, label: str, time: str, features: Sequence[str], spec: ModelSpec,
    n_splits: int = 5, gap: int = 1, folds: Sequence[TimeFold] | None = None, at_once: int = FOLDS_AT_ONCE,
) -> CrossValidation:
    """Expanding, group-safe folds over DEV. Each fold is a filter on time; rows are never copied.

    ``at_once`` folds run beside each other, each as jobs of a thread and a pool of its own, so that the small jobs of
    one fill what another leaves idle. Every one holds its prepared training rows in memory, with spill to disk.
    """
    start = clock.time()
    folds = list(grouped_time_folds(dev, time, n_splits, gap) if folds is None else folds)
    spark = dev.sparkSession

    def one(f: TimeFold) -> FoldResult:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{f.fold}")
        return process_fold(f.fold, dev.where(f.train(F.col(time))), dev.where(f.validation(F.col(time))), key, label, features, spec)

    with ThreadPoolExecutor(max(1, min(at_once, len(folds)))) as pool:
        # The threads see the session's own settings; results keep the order of the folds.
        done = list(pool.map(inheritable_thread_target(spark)(one), folds))
    stacked = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    selection, scored = stacked([r.selection for r in done]), stacked([r.scores for r in done])
    logs = [r.ranking_log for r in done if r.ranking_log is not None]
    agreement = jaccard_with_previous(selection).select(F.col("fold_id").cast("long").alias("fold"), "jaccard_similarity")
    table = (
        metrics_frame(spark, [r.metrics for r in done])
        .join(agreement, "fold", "left")
        .join(fold_info(dev, time, folds), "fold", "left")
    )
    numbers = [c for c in table.columns if c != "fold"]
    # Fold-sized: kept as rows, so that the model runs behind it are not repeated.
    table = spark.createDataFrame(table.orderBy("fold").collect(), table.schema)
    return CrossValidation(
        table, with_summary_rows(table, numbers), selection, last_fold_scores(scored, key), clock.time() - start, done,
        stacked(logs) if logs else None,
    )
