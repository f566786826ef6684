import pytest
from pyspark.sql import functions as F

from driftwell.operators.reports import ranking_call_stats
from driftwell.operators.selection import MrmrSelector, PcaSelector, RankedThenStatistical, RankingSelector, Selector
from driftwell.operators.timeline import Windows
from driftwell.plans.experiment import run_experiment
from driftwell.plans.folds import ModelSpec, fit_training
from driftwell.plans.prepare import Prepared, prepare
from driftwell.plans.scoring_path import ScoringPath
from driftwell.sources.runs import RunStore
from driftwell.operators.models import ScoreModel


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.range(400).select(F.col("id").alias("SK_ID_CURR"), (F.rand(1) < 0.4).cast("int").alias("TARGET"), F.rand(2).alias("noise"),
                                     F.when(F.rand(3) < 0.5, "a").otherwise("b").alias("kind")).persist()
    previous = people.select("SK_ID_CURR", "TARGET", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select(
        "SK_ID_CURR",
        (F.rand(4) + F.col("TARGET") * 0.4).alias("AMT_APPLICATION"), (F.rand(5) + 1).alias("AMT_CREDIT"), (F.rand(6) + 1).alias("AMT_ANNUITY"),
        F.lit(12).alias("CNT_PAYMENT"), (-F.floor(F.rand(7) * 700)).cast("long").alias("DAYS_DECISION"),
    ).persist()
    return {"application_train": people, "previous_application": previous}


WINDOWS = Windows(-600, -100, 0)


@pytest.fixture(scope="module")
def prepared(tables):
    return prepare(tables, windows=WINDOWS)


def test_prepare(tables, prepared):
    assert prepared.time == "recent_decision"
    assert not {"TARGET", "recent_decision", "PREV_recent_decision_MAX", "application_time_proxy", "SK_ID_CURR", "split"} & set(prepared.features)
    assert prepared.dev.count() == prepared.audit["dev_rows"] and prepared.oot.count() == prepared.audit["oot_rows"]
    newest = tables["previous_application"].groupBy("SK_ID_CURR").agg(F.max("DAYS_DECISION").alias("d"))
    assert newest.where("d >= -600 and d < -100").count() == prepared.audit["dev_rows"]
    with pytest.raises(ValueError):
        prepare({"previous_application": tables["previous_application"]})


def test_experiment_writes_every_artifact(spark, prepared, tmp_path):
    store = RunStore(str(tmp_path / "runs"))
    spec = ModelSpec("lr", {"maxIter": 30}, {"min_frequency": 1}, lambda: MrmrSelector(4, trees=8), "mrmr")
    result = run_experiment(prepared, spec, "run1", n_splits=2, gap=0, feature_budget=4, store=store)
    listed = spark.createDataFrame([("run1", "statistical")], "run_id string, experiment_type string")
    assert store.missing_artifacts(spark, listed).isEmpty()
    assert result.predictions.count() == prepared.audit["oot_rows"]
    assert result.cross_validation.folds.count() == 2 and result.cross_validation.results.count() == 4
    assert result.oot_metrics["auc"] > 0.5 and len(result.final.selected) == 4
    validated = prepared.dev.where(F.col("recent_decision") >= min(r["val_time_start"] for r in result.cross_validation.folds.collect()))
    assert result.cross_validation.out_of_fold.count() == validated.count()
    row = result.summary.first()
    assert row["cv_fold_count"] == 2 and row["oot_selected_feature_count"] == 4 and row["nogueira_stability"] is not None
    model = ScoreModel.load(f"{store.root}/models/run1")
    assert model.features == result.final.model.features
    manifest = store.read(spark, "data_split_manifest").collect()
    assert {r["split"]: r["row_count"] for r in manifest}["dev"] == prepared.audit["dev_rows"]


class Spy(Selector):
    """Records what it was shown."""

    stage = "before"
    seen: list[int] = []
    scores: dict[str, float] = {}

    def fit(self, df, label, features):
        Spy.seen.append(df.count())
        self.selected = list(features)[:3]
        return self


def test_selection_never_sees_out_of_time_rows(prepared):
    spec = ModelSpec("lr", {"maxIter": 5}, {"min_frequency": 1}, Spy, "spy")
    one = run_experiment(prepared, spec, "spy", n_splits=2, gap=0)
    assert max(Spy.seen) == prepared.audit["dev_rows"]
    changed = prepared.data.withColumns({
        c: F.when(F.col("split") == "oot", F.lit(1e9)).otherwise(F.col(c)) for c in prepared.features if c not in ("kind",)
    })
    other = Prepared(changed, prepared.features, prepared.key, prepared.target, prepared.time, WINDOWS, prepared.audit)
    two = fit_training(other.dev, other.key, other.target, other.features, spec)
    assert two.selected == one.final.selected and abs(two.threshold - one.final.threshold) < 1e-12


def test_hybrid_run_leaves_a_trace(spark, prepared, tmp_path):
    def ranker(cards, signature):
        return cards.select("feature", (F.col("position") + 1).alias("rank"))

    maker = lambda: RankedThenStatistical(RankingSelector(ranker, 10, 8), MrmrSelector(3, trees=8), 4)
    store = RunStore(str(tmp_path / "runs"))
    result = run_experiment(prepared, ModelSpec("lr", {"maxIter": 10}, {"min_frequency": 1}, maker, "hybrid"), "h", n_splits=2, gap=0, experiment_type="hybrid", store=store)
    trace = store.read(spark, "llm_hybrid_trace")
    assert trace.where("scope = 'final_dev'").count() == 8 and trace.where("survived_hybrid").count() > 0
    assert len(result.final.selected) == 4
    row = store.read(spark, "run_manifest", ["h"]).first()
    assert (row.status, row.random_seed, row.llm_calls_actually_made, row.n_training_rows) == ("completed", 42, 3, prepared.audit["dev_rows"])
    assert len(row.preprocessing_hash) == 64 and row.runtime_seconds > 0 and len(row.llm_metadata_signatures) > 0
    listed = spark.createDataFrame([("h", "hybrid")], "run_id string, experiment_type string")
    assert store.missing_artifacts(spark, listed).isEmpty()
    stats = ranking_call_stats(store.read(spark, "llm_rankings_summary")).first()
    # Two folds and the final fit; the ranker is asked once for each.
    assert (stats["llm_calls_actually_made"], stats["llm_cache_hits"]) == (3, 0)
    assert result.stability.first()["spearman_rank_stability_mean"] is not None
    oof = result.cross_validation.out_of_fold_metrics(prepared.target).first()
    assert 0 <= oof["auc"] <= 1 and oof["decision_threshold"] is None


def test_leaking_feature_stops_the_run(prepared):
    with pytest.raises(ValueError):
        run_experiment(Prepared(prepared.data, [*prepared.features, "recent_decision"], prepared.key, prepared.target, prepared.time, WINDOWS), ModelSpec(), "x")


def test_folds_overlap_and_agree(spark, prepared):
    from driftwell.plans.folds import run_folds

    spec = ModelSpec("lr", {"maxIter": 10}, {"min_frequency": 1})
    args = (prepared.dev, prepared.key, prepared.target, prepared.time, prepared.features, spec, 2, 0)
    together, alone = run_folds(*args, at_once=2), run_folds(*args, at_once=1)
    spent = [r.metrics["fold_time_sec"] for r in together.fold_results]
    assert sum(spent) > 1.2 * together.runtime_seconds
    names = ["fold", "auc", "gini", "ks", "psi_model", "selected_features", "jaccard_similarity"]
    for a, b in zip(together.folds.select(names).collect(), alone.folds.select(names).collect(), strict=True):
        assert [None if v is None else round(v, 9) for v in a] == [None if v is None else round(v, 9) for v in b]
    assert [r.selected for r in together.fold_results] == [r.selected for r in alone.fold_results]


@pytest.mark.parametrize("maker", [None, lambda: MrmrSelector(3, trees=8), lambda: PcaSelector(3)])
def test_loaded_runs_score_like_the_run(spark, prepared, tmp_path, maker):
    spec = ModelSpec("lr", {"maxIter": 10}, {"min_frequency": 1}, maker, "x")
    fit = fit_training(prepared.dev, prepared.key, prepared.target, prepared.features, spec)
    fit.scoring_path().save(spark, str(tmp_path / "m"))
    again = ScoringPath.load(spark, str(tmp_path / "m"))
    want = {r[0]: r[2] for r in fit.score(prepared.data, prepared.key, prepared.target).collect()}
    got = again.score(prepared.data.drop(prepared.target), prepared.key).collect()
    assert {r[0]: r.score for r in got} == want
    assert all(r.flag == (r.score >= fit.threshold) for r in got)


def test_makers_of_columns_are_not_saved_silently(prepared):
    class Odd(Selector):
        def fit(self, df, label, features):
            self.selected, self.scores = ["z"], {}
            return self

        def transform(self, df, *keep):
            return df.select(*keep, F.lit(1.0).alias("z"))

    fit = fit_training(prepared.dev, prepared.key, prepared.target, prepared.features, ModelSpec("lr", {"maxIter": 5}, {"min_frequency": 1}, Odd, "odd"))
    with pytest.raises(ValueError):
        fit.scoring_path()


def test_failures_are_noted(spark, prepared, tmp_path):
    store = RunStore(str(tmp_path / "runs"))
    leaking = Prepared(prepared.data, [*prepared.features, "recent_decision"], prepared.key, prepared.target, prepared.time, WINDOWS)
    with pytest.raises(ValueError):
        run_experiment(leaking, ModelSpec(), "bad", store=store)
    failed = store.read(spark, "run_manifest", ["bad"]).first()
    assert failed.status == "failed" and failed.error.startswith("ValueError") and failed.failed_at


def test_only_selected_columns_are_kept(prepared):
    spec = ModelSpec("lr", {"maxIter": 5}, {"min_frequency": 1}, lambda: MrmrSelector(3, trees=4), "mrmr")
    fit = fit_training(prepared.dev, prepared.key, prepared.target, prepared.features, spec)
    assert fit.held.columns == [prepared.key, prepared.target, *fit.selected] and fit.held.storageLevel.useMemory
    fit.release()
    assert fit.held is None and not fit.train_ready.storageLevel.useMemory


def test_histories_are_read_once(spark, tables):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    previous = tables["previous_application"]
    counted = previous.mapInArrow(passed, previous.schema)
    made = prepare(tables | {"previous_application": counted}, windows=WINDOWS)
    read = seen.value
    made.data.select("application_time_proxy").count()
    assert read == seen.value
    assert read == previous.count()
