import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions.labels import drift_level, help_label, psi_flag
from driftwell.operators import drift, evidence, resample, scoring


def scored(spark, labels, scores):
    return spark.createDataFrame(
        [(i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))], "id long, y int, p double"
    )


def plain_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def plain_ks(y, s):
    y, s = np.asarray(y), np.asarray(s)
    gaps = [((s[y == 1] >= t).mean() - (s[y == 0] >= t).mean(), t) for t in sorted(set(s), reverse=True)]
    best = max(g for g, _ in gaps)
    return max(best, 0.0), next((t for g, t in gaps if g == best), math.inf) if best > 0 else math.inf


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_roc_against_brute_force(spark, rows_per_bucket):
    generator = np.random.default_rng(0)
    s = np.round(generator.random(400), 2)
    s[:140] = 0.5
    y = (generator.random(400) < 0.2 + 0.5 * s).astype(int)
    df = scored(spark, y, s)
    found = scoring.roc_summary(scoring.roc_table(df, "y", "p", rows_per_bucket=rows_per_bucket)).first()
    assert abs(found["auc"] - plain_auc(y, s)) < 1e-12
    ks, threshold = plain_ks(y, s)
    assert abs(found["ks"] - ks) < 1e-12 and found["ks_threshold"] == threshold
    flipped = scoring.roc_metrics(df.withColumn("p", 1 - F.col("p")), "y", "p").first()
    assert abs(flipped["auc"] - (1 - found["auc"])) < 1e-12


def test_no_separation_flags_nobody(spark):
    found = scoring.evaluate(scored(spark, [1, 0, 1, 0], [0.5] * 4), "y", "p").first()
    assert found["ks"] == 0.0 and found["ks_threshold"] == math.inf
    assert found["tp"] == 0 and found["fp"] == 0 and found["auc"] == 0.5


def test_single_class_has_no_auc(spark):
    found = scoring.roc_metrics(scored(spark, [1, 1], [0.1, 0.2]), "y", "p").first()
    assert found["auc"] is None and found["ks"] is None


def test_training_threshold_is_used(spark):
    train = scored(spark, [0, 0, 1, 1], [0.1, 0.3, 0.8, 0.9])
    limit = scoring.decision_threshold(train, "y", "p")
    found = scoring.evaluate(scored(spark, [0, 1, 1, 0], [0.2, 0.82, 0.9, 0.81]), "y", "p", threshold=limit).first()
    assert abs(found["precision"] - 2 / 3) < 1e-12 and found["recall"] == 1.0 and abs(found["f1"] - 0.8) < 1e-12
    with pytest.raises(ValueError):
        scoring.decision_threshold(train, "y", "p", strategy="other")


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 3])
def test_lift_and_capture(spark, rows_per_bucket):
    df = scored(spark, [1, 1] + [0] * 8, [0.99] + [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0])
    found = scoring.lift_and_capture(df, "y", "p", "id", rows_per_bucket=rows_per_bucket).first()
    assert found["lift_at_10"] == 5.0 and found["bad_rate_capture_at_10"] == 0.5
    assert found["lift_at_20"] == 5.0 and found["bad_rate_capture_at_20"] == 1.0
    tied = scoring.lift_and_capture(df.withColumn("p", F.lit(0.3)), "y", "p", "id", (0.3,), rows_per_bucket=rows_per_bucket).first()
    assert abs(tied["lift_at_30"] - (2 / 3) / 0.2) < 1e-12
    assert "lift_at_28" in scoring.lift_and_capture(df, "y", "p", "id", (0.29,)).columns


def test_rows_may_come_in_any_order(spark):
    generator = np.random.default_rng(5)
    y, s = generator.integers(0, 2, 300), np.round(generator.random(300), 2)
    df = scored(spark, y, s)
    one = scoring.evaluate(df, "y", "p").first()
    two = scoring.evaluate(df.orderBy(F.rand(1)).repartition(9), "y", "p").first()
    assert all(abs((one[c] or 0) - (two[c] or 0)) < 1e-12 for c in one.asDict())


@pytest.mark.parametrize("rows_per_task", [20_000, 60])
def test_bootstrap_agrees_with_resampling_rows(spark, rows_per_task):
    generator = np.random.default_rng(7)
    s = np.round(generator.random(300), 2)
    y = (generator.random(300) < s).astype(int)
    found = resample.bootstrap_interval(scored(spark, y, s), "y", "p", replicates=400, rows_per_bucket=rows_per_task).first()
    values = []
    for _ in range(400):
        pick = generator.integers(0, 300, 300)
        values.append((2 * plain_auc(y[pick], s[pick]) - 1, plain_ks(y[pick], s[pick])[0]))
    gini, ks = zip(*values)
    expected = [np.percentile(v, q) for v in (gini, ks) for q in (2.5, 97.5)]
    ours = [found[f"oot_{m}_ci_{side}"] for m in ("gini", "ks") for side in ("lower", "upper")]
    assert np.allclose(ours, expected, atol=0.05)


def test_bootstrap_totals_do_not_depend_on_partitions(spark):
    df = scored(spark, [0, 1] * 100, [i % 17 / 17 for i in range(200)])
    one = resample.bootstrap_interval(df.repartition(2), "y", "p", replicates=50, rows_per_bucket=40).first()
    two = resample.bootstrap_interval(df.repartition(5), "y", "p", replicates=50, rows_per_bucket=40).first()
    assert np.allclose(list(one), list(two), atol=1e-12)


# ---- Drift ----

def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def plain_psi(expected, actual):
    breaks = np.unique(np.percentile(expected, range(0, 101, 10)))
    inner = breaks[1:-1]
    place = lambda v: np.bincount(np.searchsorted(inner, v, side="left"), minlength=len(inner) + 1) / len(v)
    e, a = place(np.asarray(expected, float)), place(np.asarray(actual, float))
    return float(((e - a) * np.log((e + 1e-6) / (a + 1e-6))).sum())


def test_psi(spark):
    psi = lambda a, b: drift.score_psi(column(spark, a), column(spark, b), "x")
    same = psi(range(100), range(100))
    assert abs(same) < 1e-9
    assert psi(range(100), range(100, 200)) > same
    assert psi(range(10), range(100, 110)) > 0.1
    generator = np.random.default_rng(2)
    a, b = generator.normal(0, 1, 500).round(1), generator.normal(0.4, 1.2, 300).round(1)
    assert abs(psi(a, b) - plain_psi(a, b)) < 1e-9
    assert psi([0] * 99 + [1], [1] * 10) == 0.0  # two break points make a single bin
    assert psi([5.0] * 10, [1.0]) is None
    assert psi([None], [1.0]) is None
    assert psi([1.0, 2.0, 3.0], [None, math.inf]) is None


def test_psi_of_many_columns_at_once(spark):
    df = spark.range(400).select(*[(F.rand(i) * (i + 1)).alias(f"c.{i}") for i in range(120)], "id")
    columns = [c for c in df.columns if c != "id"]
    df = df.persist()
    found = drift.feature_psi(df.where("id < 200"), df.where("id >= 200"), columns).collect()
    values = {r["feature"]: r["psi"] for r in found}
    assert len(values) == 120
    pdf = df.toPandas()
    for c in ("c.0", "c.57", "c.119"):
        assert abs(values[c] - plain_psi(pdf[c][pdf.id < 200], pdf[c][pdf.id >= 200])) < 1e-9


def test_drift_labels_differ_at_the_cuts(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.05,), (0.3,), (None,)], "psi double")
    found = df.select(drift_level(F.col("psi")), psi_flag(F.col("psi"))).collect()
    assert [tuple(r) for r in found] == [
        ("moderate", "stable"), ("high", "moderate"), ("low", "stable"), ("high", "unstable"), ("unknown", None)
    ]
    summary = drift.psi_summary(df).first()
    assert summary["selected_feature_psi_high_drift_ratio"] == 2 / 5
    assert abs(summary["selected_feature_psi_median"] - 0.175) < 1e-12


def test_help_label(spark):
    df = spark.createDataFrame([(0.1, 0.1), (-0.1, -0.1), (0.1, -0.1), (None, 0.1)], "a double, b double")
    assert [r[0] for r in df.select(help_label(F.col("a"), F.col("b"), 1e-4)).collect()] == ["yes", "no", "mixed", "mixed"]


# ---- Information value ----

def test_information_value(spark):
    df = spark.createDataFrame(
        [(i, float(i), "a" if i < 50 else "b", float(i % 2), int(i >= 50 or i % 10 == 0)) for i in range(100)],
        "id long, x double, c string, noise double, y int",
    )
    fitted = evidence.InformationValue(bins=5).fit(df, "y", ["x", "c", "noise"])
    table = {r["feature"]: r for r in fitted.table.collect()}
    assert table["x"]["leakage_flag"] and table["c"]["high_iv"] and not table["noise"]["high_iv"]
    assert table["noise"]["bins"] == 1 and "noise" not in fitted.selected
    good, bad = 45 / 45, 5 / 55
    first = (good - bad) * math.log(good / bad)
    second = (0.5 / 45 - 50 / 55 - 0.5 / 55) * math.log((0.5 / 45) / (50.5 / 55))
    assert abs(table["c"]["iv"] - (first + second)) < 1e-9
    encoded = fitted.encode(df.unionByName(df.limit(1).withColumn("c", F.lit("new"))), ["x", "c"], "id")
    assert encoded.where("c = 0.0").count() == 1


def test_fold_tables(spark):
    folds = spark.createDataFrame([(1, 0.7, 0.4), (2, 0.74, None)], "fold long, auc double, gini double")
    found = {r["fold"]: r for r in scoring.with_summary_rows(folds, ["auc", "gini"]).collect()}
    assert abs(found["mean"]["auc"] - 0.72) < 1e-12 and found["std"]["gini"] is None
    assert scoring.fold_rows(scoring.with_summary_rows(folds, ["auc"])).count() == 2
    intervals = {r["metric"]: r for r in scoring.interval_summary(folds.withColumn("ks", F.lit(None).cast("double"))).collect()}
    assert set(intervals) == {"gini"} and intervals["gini"]["ci95_lower"] == intervals["gini"]["ci95_upper"] == 0.4
