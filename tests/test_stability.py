import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import stability


def log_of(spark, sets):
    rows = [(i, f, r) for i, s in enumerate(sets, 1) for r, f in enumerate(s, 1)]
    return spark.createDataFrame(rows, "fold_id int, feature_name string, rank int")


@pytest.mark.parametrize("sets,total,nogueira,kuncheva", [
    ([["a", "b"]] * 3, 5, 1.0, 1.0),
    ([["a", "b"], ["a", "c"]], 4, 0.0, 0.0),
    ([["a", "b"], ["c", "d"], ["e", "f"]], 6, -0.5, -0.5),
    ([["a", "b"]], 5, None, None),
    ([["a", "b"], ["a", "b"]], 2, 1.0, None),
    ([["a"], ["a", "b"]], 5, 1 - (2 * 0.25 / 5) / (0.3 * 0.7), None),
])
def test_set_stability(spark, sets, total, nogueira, kuncheva):
    log = log_of(spark, sets)
    found = stability.nogueira(log, total).first()[0]
    assert found == nogueira or abs(found - nogueira) < 1e-12
    other = stability.set_stability(log, total).first()["kuncheva_stability"]
    assert other == kuncheva or abs(other - kuncheva) < 1e-12


def test_equal_sizes_agree(spark):
    log = log_of(spark, [["a", "b"], ["a", "c"], ["a", "d"]])
    assert abs(stability.nogueira(log, 4).first()[0] - stability.set_stability(log, 4).first()["kuncheva_stability"]) < 1e-12


def test_jaccard(spark):
    found = stability.set_stability(log_of(spark, [["a", "b"], ["a", "c"]]), 4).first()
    assert abs(found["mean_pairwise_jaccard"] - 1 / 3) < 1e-12
    empty = spark.createDataFrame([(1, None, 1), (2, None, 1)], "fold_id int, feature_name string, rank int")
    assert stability.set_stability(empty, 4).first()["mean_pairwise_jaccard"] == 1.0


def test_selection_frequency(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "c", 1)], "fold_id int, feature_name string, rank int")
    found = {r["feature_name"]: r for r in stability.selection_frequency(log).collect()}
    assert (found["a"]["selection_count"], found["a"]["selection_frequency"], found["a"]["mean_rank_if_available"]) == (2, 1.0, 1.5)
    assert stability.most_frequent_first(stability.selection_frequency(log)).first()["feature_name"] == "a"


def test_bundle_with_groups(spark):
    log = spark.createDataFrame(
        [(1, "f1", "g1", 1), (1, "f2", "g2", 2), (2, "f1", "g1", 1), (2, "f3", "g3", 2)],
        "fold_id int, feature_name string, semantic_group string, rank int",
    )
    found = stability.stability_bundle(log, 10).first()
    assert abs(found["semantic_group_jaccard"] - 1 / 3) < 1e-12
    assert found["stable_semantic_group_count_80"] == 1 and found["semantic_group_stable_ratio_80"] == 0.5
    assert found["stable_feature_count_80"] == 1 and found["rbo_rank_stability_mean"] is None


def test_rank_agreement_against_brute_force(spark):
    generator = np.random.default_rng(3)
    names = [f"f{i}" for i in range(12)]
    folds = [list(generator.permutation(names)[: 6 + i]) for i in range(3)]
    found = {r["metric"]: r for r in stability.rank_stability(log_of(spark, folds)).collect()}
    spearman, kendall = [], []
    for left, right in itertools.combinations(folds, 2):
        union = sorted(set(left) | set(right))
        x = np.array([left.index(f) + 1 if f in left else len(left) + 1 for f in union], float)
        y = np.array([right.index(f) + 1 if f in right else len(right) + 1 for f in union], float)
        spearman.append(np.corrcoef(x, y)[0, 1])
        signs = [np.sign((x[i] - x[j]) * (y[i] - y[j])) for i, j in itertools.combinations(range(len(union)), 2)]
        kendall.append(sum(signs) / sum(abs(s) for s in signs))
    for metric, values in (("spearman", spearman), ("kendall_tau", kendall)):
        assert abs(found[metric]["mean_value"] - np.mean(values)) < 1e-12
        assert abs(found[metric]["std_value"] - np.std(values, ddof=1)) < 1e-12
        assert found[metric]["n_pairs"] == 3


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_kendall_by_inversions_against_brute_force(spark, rows_per_bucket):
    """Ties on either side, groups of very different size, several buckets."""
    generator = np.random.default_rng(5)
    rows = [(g, float(x), float(y)) for g, n in ((1, 90), (2, 2), (3, 1), (4, 25)) for x, y in generator.integers(0, 12 if g != 4 else 1_000, (n, 2)) / 2]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    found = {r.g: r.kendall_tau for r in stability.kendall_by_inversions(df, ["g"], rows_per_bucket).collect()}
    for g in (1, 2, 3, 4):
        mine = [r[1:] for r in rows if r[0] == g]
        signs = [np.sign((a[0] - b[0]) * (a[1] - b[1])) for a, b in itertools.combinations(mine, 2)]
        total = sum(map(abs, signs))
        assert found[g] is None if not total else abs(found[g] - sum(signs) / total) < 1e-12


def test_rank_stability_of_many_features(spark):
    """20 000 features in three folds: 200 million pairs of features for each pair of folds, none of them made."""
    log = spark.range(20_000).select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("fold_id"), F.col("id").cast("string").alias("feature_name"), "id").select(
        "fold_id", "feature_name", F.when(F.col("fold_id") == 1, F.col("id") + 1).when(F.col("fold_id") == 2, 20_000 - F.col("id")).otherwise(F.col("id") + 1).alias("rank")
    )
    found = {r.metric: r for r in stability.rank_stability(log, rows_per_bucket=5_000).collect()}
    for metric in ("spearman", "kendall_tau"):
        assert found[metric].n_pairs == 3 and abs(found[metric].mean_value + 1 / 3) < 1e-9


def test_rank_stability_of_one_fold_and_nothing(spark):
    one = log_of(spark, [["a", "b"]]).withColumn("run_id", F.lit("x"))
    assert [(r.metric, r.mean_value, r.n_pairs) for r in stability.rank_stability(one, ["run_id"]).collect()] == [("spearman", None, 0), ("kendall_tau", None, 0)]
    assert stability.rank_stability(one.limit(0), ["run_id"]).count() == 0 and stability.rank_stability(one.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 10])
def test_average_rank_of_a_hot_key_and_value(spark, rows_per_bucket):
    import pandas as pd

    rows = [("hot", float(i % 50)) for i in range(300)] + [("hot", 7.5)] * 300 + [(f"k{i % 9}", float(i % 4)) for i in range(200)] + [("hot", None), (None, 1.0), ("k1", -0.0), ("k1", 0.0)]
    df = spark.createDataFrame(rows, "key string, score double").repartition(4)
    want = pd.DataFrame(rows, columns=["key", "score"])
    want["rank"] = want.groupby("key")["score"].rank(ascending=False)
    got = stability.average_rank(df, "score", ["key"], rows_per_bucket=rows_per_bucket).where("key is not null").toPandas()
    order = ["key", "score", "rank"]
    assert got.sort_values(order).to_numpy().tolist().__repr__().replace("-0.0", "0.0") == want.dropna(subset=["key"]).sort_values(order)[order].to_numpy().tolist().__repr__().replace("-0.0", "0.0")


def test_rows_of_a_hot_key_are_dealt_over_all_tasks(spark):
    from driftwell.operators import joins

    left = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    right = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v")).where("k != '4'")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = joins.spread_join(left, right.repartition(4), ["k"], "n")
        assert out.columns == ["k", "id", "v"] and out.count() == 9_000
        wrong = out.where("NOT (v <=> CASE WHEN k = 'hot' THEN 8997 WHEN k != '4' THEN id END)")
        assert wrong.isEmpty()
        joins_, joins.small_side = joins.small_side, lambda df: df
        dealt = [r["count"] for r in joins.spread_join(left, right, ["k"], "n").groupBy(F.spark_partition_id()).count().collect()]
        joins.small_side = joins_
        assert max(dealt) < 3_000
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 7.0), (1, "c", 5.0), (1, "d", None)], "fold_id int, feature_name string, score double")
    found = {r["feature_name"]: r["rank"] for r in stability.average_rank(df, "score", ["fold_id"]).collect()}
    assert found == {"b": 1.0, "a": 2.5, "c": 2.5, "d": None}


def test_overlap_and_previous(spark):
    left, right = log_of(spark, [["a", "b"], ["a"]]), log_of(spark, [["a", "c"]])
    found = stability.fold_overlap(left, right).collect()
    assert [tuple(r) for r in found] == [(1, 2, 2, 1, 3, 1 / 3)]
    chain = stability.jaccard_with_previous(log_of(spark, [["a", "b"], ["a", "c"], ["a", "c"]])).orderBy("fold_id").collect()
    assert [r["jaccard_similarity"] for r in chain] == [None, 1 / 3, 1.0]


def test_runs_are_kept_apart(spark):
    log = log_of(spark, [["a", "b"], ["a", "c"]]).withColumn("run_id", F.lit("x")).unionByName(
        log_of(spark, [["a", "b"], ["a", "b"]]).withColumn("run_id", F.lit("y"))
    )
    found = {r["run_id"]: r[1] for r in stability.nogueira(log, 4, ["run_id"]).collect()}
    assert abs(found["x"]) < 1e-12 and found["y"] == 1.0
