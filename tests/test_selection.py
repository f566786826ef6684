import math
import time
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import models, selection, wrappers


@pytest.fixture(scope="module")
def signal(spark):
    """y depends on a and b; c copies a; the others are noise."""
    generator = np.random.default_rng(0)
    a, b = generator.normal(size=(2, 600))
    y = (a + 0.7 * b + generator.normal(0, 0.4, 600) > 0).astype(int)
    noise = generator.normal(size=(4, 600))
    rows = [(i, int(y[i]), *map(float, (a[i], b[i], a[i] + 0.01 * noise[0, i], noise[1, i], noise[2, i], noise[3, i]))) for i in range(600)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, n1 double, n2 double, n3 double").persist()


FEATURES = ["a", "b", "c", "n1", "n2", "n3"]


def ranking(spark, names):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank int")


def naive_mrmr(scores, features, matrix, k):
    order = sorted(scores, key=lambda c: (-scores[c], c))
    picked = [order[0]]
    while len(picked) < k:
        best, value = None, -1.0
        for c in order:
            if c in picked:
                continue
            mean = np.mean([abs(matrix[features.index(c), features.index(p)]) for p in picked])
            v = scores[c] / max(mean, 0.05)
            if not np.isnan(v) and v > value:
                best, value = c, v
        picked.append(best or next(c for c in order if c not in picked))
    return picked


def test_greedy_mrmr_against_its_definition():
    generator = np.random.default_rng(2)
    data = generator.normal(size=(50, 8))
    data[:, 3] = data[:, 0] + 0.1 * data[:, 1]
    matrix = np.corrcoef(data.T)
    matrix[5, :] = matrix[:, 5] = np.nan
    names = [f"f{i}" for i in range(8)]
    scores = {n: float(v) for n, v in zip(names, generator.random(8))}
    scores["f5"] = 0.0
    for k in range(1, 9):
        assert selection.greedy_mrmr(scores, names, matrix, k) == naive_mrmr(scores, names, matrix, k)


def test_mrmr_avoids_the_copy(spark, signal):
    picked = selection.MrmrSelector(2, trees=24).fit(signal, "y", FEATURES)
    assert "b" in picked.selected and len(set(picked.selected) & {"a", "c"}) == 1
    top = selection.MrmrSelector(3, method="rf", trees=24).fit(signal, "y", FEATURES)
    assert set(top.selected) == {"a", "b", "c"}
    assert selection.MrmrSelector(9).fit(signal, "y", FEATURES).selected == FEATURES
    with pytest.raises(ValueError):
        selection.MrmrSelector(2, method="other").fit(signal, "y", FEATURES)


def test_components_against_numpy(spark, signal):
    made = selection.PcaSelector(2).fit(signal, "y", FEATURES)
    out = made.transform(signal, "id").orderBy("id").toPandas()
    matrix = signal.orderBy("id").select(*FEATURES).toPandas().to_numpy()
    centred = matrix - matrix.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    for i, name in enumerate(["PC1", "PC2"]):
        vector = vectors[:, -1 - i]
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        assert np.allclose(out[name], centred @ vector, atol=1e-8)
        assert abs(made.scores[name] - values[-1 - i] / values.sum()) < 1e-9
    shares = selection.PcaSelector(0.5).fit(signal, "y", FEATURES)
    assert 0 < len(shares.selected) < 6 and sum(shares.scores[n] for n in shares.selected) >= 0.5
    tiny = spark.createDataFrame([(1.0, 3.0, 0), (2.0, 2.0, 1), (3.0, 1.0, 0)], "f1 double, f2 double, y int")
    assert selection.PcaSelector(1).fit(tiny, "y", ["f1", "f2"]).transform(tiny).columns == ["PC1"]


def test_shadows_keep_values_and_lose_links(spark, signal):
    vectors, rows = wrappers.numbered_vectors(signal, "y", FEATURES, 1)
    out = wrappers.with_shadows(vectors, rows, range(6), 1).collect()
    matrix = np.array([r["features"].toArray() for r in out])
    assert matrix.shape == (600, 12)
    for j in range(6):
        assert np.array_equal(np.sort(matrix[:, j]), np.sort(matrix[:, 6 + j]))
    assert abs(np.corrcoef(matrix[:, 0], matrix[:, 6])[0, 1]) < 0.2
    assert abs(np.corrcoef(matrix[:, 6], matrix[:, 8])[0, 1]) < 0.2
    assert abs(np.corrcoef(matrix[:, 6], [r["label"] for r in out])[0, 1]) < 0.2


def test_permutations_are_one_to_one():
    draw = np.random.default_rng(1)
    for rows in (1, 2, 3, 10, 97, 600, 1 << 20):
        a, b = wrappers.permutation(rows, draw)
        assert math.gcd(a, rows) == 1 and a * rows < 1 << 63
        if rows < 1_000:
            assert sorted((a * r + b) % rows for r in range(rows)) == list(range(rows))


def test_shadows_do_not_depend_on_partitions_or_batches(spark, signal):
    """The same rows in the same parts and order, however the input was dealt: the forests are the same too."""
    def made(df, batch):
        kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            vectors, rows = wrappers.numbered_vectors(df, "y", FEATURES, 5)
            out = wrappers.with_shadows(vectors, rows, [0, 2, 5], 9).withColumn("part", F.spark_partition_id())
            return [(r.part, r.label, tuple(r.features.toArray())) for r in out.collect()]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)

    one, two = made(signal.repartition(1), 7), made(signal.repartition(9), 10_000)
    assert one == two and len(one) == 600
    first = wrappers.BorutaSelector(2, trees=6).fit(signal.repartition(2), "y", FEATURES)
    second = wrappers.BorutaSelector(2, trees=6).fit(signal.repartition(5), "y", FEATURES)
    assert first.scores == second.scores and first.ranking == second.ranking and first.tentative == second.tentative


def test_planted_signal_is_confirmed_and_noise_rejected(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] + x[:, 1] + 0.2 * rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "s1 double, s2 double, n1 double, n2 double, n3 double, y int")
    report = {r.feature: r for r in wrappers.BorutaSelector(9, trees=20).fit(df, "y", ["s1", "s2", "n1", "n2", "n3"]).report(df).collect()}
    assert [report[c].support for c in ("s1", "s2")] == [1, 1]
    assert [(report[c].support, report[c].weak_support) for c in ("n1", "n2", "n3")] == [(0, 0)] * 3


def test_trials_beside_each_other_give_what_they_give_in_a_row(spark, signal, monkeypatch):
    # No trial before the 8th can settle anything at alpha 0.05; later ones depend on the hits.
    assert wrappers.next_decision(0, 10, {"a": 0, "b": 0}, {"a", "b"}, 0.05) == 8
    assert wrappers.next_decision(8, 10, {"a": 8, "b": 4}, {"b"}, 0.05) == 10 and wrappers.next_decision(8, 10, {"b": 8}, {"b"}, 0.05) == 9
    for most in (1, 3, 12, 40):
        for hits in range(most):
            last = wrappers.next_decision(most - 1, most + 5, {"a": hits}, {"a"}, 0.05)
            for t in range(most, last):
                for more in range(t - most + 2):
                    p = {"a": wrappers.binomial_tail(hits + more, t)}, {"a": wrappers.binomial_tail(t - hits - more, t)}
                    assert not wrappers._significant(p[0], 0.05, t) and not wrappers._significant(p[1], 0.05, t)
    running, most, plain = [0], [0], wrappers.with_shadows

    def counted(*given):
        running[0] += 1
        most[0] = max(most[0], running[0])
        try:
            time.sleep(0.2)
            return plain(*given)
        finally:
            running[0] -= 1

    monkeypatch.setattr(wrappers, "with_shadows", counted)
    together = wrappers.BorutaSelector(4, trees=6, at_once=4).fit(signal, "y", FEATURES)
    assert most[0] > 1
    alone = wrappers.BorutaSelector(4, trees=6, at_once=1).fit(signal, "y", FEATURES)
    assert together.scores == alone.scores and together.ranking == alone.ranking


def test_boruta_and_elimination(spark, signal):
    chosen = wrappers.BorutaRfeSelector(wrappers.BorutaSelector(8, trees=24), n_features=3).fit(signal, "y", FEATURES)
    assert {"a", "c"} <= set(chosen.boruta.confirmed | chosen.boruta.tentative)
    assert set(chosen.selected) == {"a", "b", "c"}
    assert chosen.boruta.ranking["n1"] > 2
    kept = wrappers.RfeSelector(2, 2, trees=8, depth=3).fit(signal, "y", FEATURES)
    assert len(kept.selected) == 2 and set(kept.selected) <= {"a", "b", "c"}
    assert set(chosen.stages(signal).toPandas()["stage"]) <= {"boruta", "rfe"}
    assert abs(wrappers.binomial_tail(8, 10) - 56 / 1024) < 1e-12


def ranker_of(spark, names):
    seen = []

    def rank(cards, signature):
        seen.append((sorted(cards.columns), signature))
        return ranking(spark, names)

    return rank, seen


def test_outside_ranking_is_checked_and_filled(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0), (2.0, 1.0, 5.0, 1)], "f1 double, f2 double, f3 double, y int")
    rank, seen = ranker_of(spark, ["missing_a", "f2", "missing_b"])
    made = selection.RankingSelector(rank, ranking_budget=3).fit(df, "y", ["f1", "f2", "f3"])
    assert made.selected == ["f2", "f1", "f3"] and made.invalid == ["missing_a", "missing_b"]
    assert seen[0][0] == ["card", "feature", "position"] and len(seen[0][1]) == 64
    more = df.unionByName(df.limit(1).withColumn("f1", F.lit(99.0)))
    other = selection.RankingSelector(rank, 3).fit(more, "y", ["f1", "f2", "f3"])
    assert other.signature != made.signature
    empty = df.withColumn("f1", F.lit(None).cast("double")).select("f1", "y")
    with pytest.raises(ValueError):
        selection.RankingSelector(rank, 3).fit(empty, "y", ["f1"])


def test_stored_rankings_are_asked_once_per_key(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1)], "f1 double, f2 double, y int")
    rank, seen = ranker_of(spark, ["f2", "f1"])
    stored = selection.StoredRankings(str(tmp_path / "rankings"), rank)
    logs = []
    for repeat in range(2):
        for scope, fold in [("fold", 1), ("fold", 2), ("final_dev", None)]:
            made = selection.RankingSelector(stored, 2, prompt_version="v1")
            made.set_context(scope, fold)
            assert made.fit(df, "y", ["f1", "f2"]).selected == ["f2", "f1"]
            logs.append(made.log(spark))
    assert len(seen) == 3 and len({key for _, key in seen}) == 3
    assert [log.first()["cache_hit"] for log in logs] == [False] * 3 + [True] * 3
    merged = selection.merge_ranking_log(logs[0], logs[3])
    assert merged.count() == 2 and merged.where("cache_hit").count() == 2
    other = selection.RankingSelector(stored, 2, prompt_version="v2").fit(df, "y", ["f1", "f2"])
    assert len(seen) == 4 and other.log(spark).columns[:2] == ["feature_name", "rank"]


def test_wide_ranking_budgets(spark):
    names = [f"f{i}" for i in range(120)]
    df = spark.range(3).select(*[(F.col("id") * (i + 1.0)).alias(n) for i, n in enumerate(names)], (F.col("id") % 2).cast("int").alias("y"))
    rank, _ = ranker_of(spark, names[::-1])
    made = selection.RankingSelector(rank, 100, 20).fit(df, "y", names)
    assert len(made.ranked) == 100 and made.selected == names[::-1][:20]


@pytest.fixture()
def hybrid_data(spark):
    generator = np.random.default_rng(4)
    names = [f"f{i}" for i in range(12)]
    x = generator.normal(size=(80, 12))
    rows = [(int(r[11] + 0.3 * r[0] > 0), *map(float, r)) for r in x]
    return spark.createDataFrame(rows, "y int, " + ", ".join(f"{n} double" for n in names)).persist(), names


def test_ranking_then_statistics(spark, hybrid_data):
    df, names = hybrid_data
    rank, _ = ranker_of(spark, names[::-1])
    made = selection.RankedThenStatistical(selection.RankingSelector(rank, 12, 6), selection.MrmrSelector(3, trees=8), 5)
    made.fit(df, "y", names)
    assert made.selected == names[::-1][:6]
    made.refine(df, "y", made.selected)
    assert len(made.selected) == 5 and made.selected[:3] == made.statistical.selected
    assert made.selected[3:] == [c for c in names[::-1][:6] if c not in made.selected[:3]][:2]
    with pytest.raises(ValueError):
        made.fit(df, None, names)


def test_stable_core(spark, hybrid_data):
    df, names = hybrid_data
    rank, _ = ranker_of(spark, names)
    made = selection.StableCoreFill(selection.RankingSelector(rank, 12), 5, bootstraps=3, trees=8)
    made.fit(df, "y", names).refine(df, "y", names)
    assert len(made.selected) == 5 and made.selected[: len(made.core)] == made.core and "f11" in made.core
    frequency = made.frequency.collect()
    assert all(0 < r["selection_frequency"] <= 1 for r in frequency)


def test_fill_to_budget_and_last_rows(spark):
    filled = selection.fill_to_budget([ranking(spark, ["b", "a"]), ranking(spark, ["c", "a", "d"])], 3)
    assert [(r["feature"], r["rank"]) for r in filled.orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    columns = "scope string, fold_id int, feature_name string, metadata_signature string, prompt_hash string, rank int"
    old = spark.createDataFrame([("final", None, "a", "s", "p", 1), ("fold", 1, "a", "s", "p", 4)], columns)
    new = spark.createDataFrame([("final", None, "a", "s", "p", 9)], columns)
    found = selection.merge_ranking_log(old, new).collect()
    assert sorted((r["scope"], r["rank"]) for r in found) == [("final", 9), ("fold", 4)]


def test_models_score_save_and_load(spark, signal, tmp_path):
    for kind, settings in (("lr", {"maxIter": 50}), ("rf", {"numTrees": 10, "maxDepth": 5}), ("gbt", {"maxIter": 5, "maxDepth": 3, "minInstancesPerNode": 5})):
        model = models.fit_model(kind, signal, FEATURES, "y", settings)
        scores = model.score(signal, "id", "y").persist()
        assert scores.where("score < 0 or score > 1").isEmpty()
        from driftwell.operators.scoring import roc_metrics
        assert roc_metrics(scores, "y", "score").first()["auc"] > 0.85
        importance = model.importance(spark)
        assert importance.columns == ["feature", "importance"] and importance.where("importance < 0").isEmpty()
        assert importance.first()["feature"] in ("a", "b", "c")
        model.save(str(tmp_path / kind))
        again = models.ScoreModel.load(str(tmp_path / kind))
        assert again.features == FEATURES
        joined = again.score(signal, "id").join(scores.withColumnRenamed("score", "old"), "id")
        assert joined.where("abs(score - old) > 1e-12").isEmpty()
    with pytest.raises(ValueError):
        models.fit_model("svm", signal, FEATURES, "y")
    with pytest.raises(ValueError):
        models.fit_model("lr", signal.where("y = 1"), FEATURES, "y")


def test_linear_attribution(spark, signal):
    model = models.fit_model("lr", signal, FEATURES, "y", {"maxIter": 50})
    found = {r["feature"]: r["mean_abs_shap"] for r in models.model_attribution(model, signal).collect()}
    matrix = signal.select(*FEATURES).toPandas().to_numpy()
    weights = model.model.coefficients.toArray()
    expected = np.abs(weights * (matrix - matrix.mean(axis=0))).mean(axis=0)
    assert np.allclose([found[f] for f in FEATURES], expected)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    weight, n = models.balanced_weight(df, "y")
    assert n == 4 and sorted(r[0] for r in df.select(weight).collect()) == [2 / 3, 2 / 3, 2 / 3, 2.0]


def test_logistic_penalty(spark, signal):
    """The fitted coefficients zero the gradient of the penalised, class-balanced loss."""
    model = models.fit_model("lr", signal, FEATURES, "y", {"maxIter": 200, "tol": 1e-10})
    pdf = signal.select("y", *FEATURES).toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    w, b = model.model.coefficients.toArray(), model.model.intercept
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    residual = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(x.T @ residual + w).max() < 1e-2 and abs(residual.sum()) < 1e-2
