import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import ordering, quantiles, timeline
from driftwell.operators.timeline import Windows


def timed(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t long")


def positional_folds(times, k, gap):
    """Fold sizes straight from the definition over sorted rows."""
    times = np.sort(np.asarray(times))
    unique, n = np.unique(times), len(times)
    size, made = n // (k + 1), []
    for i in range(k):
        first = n - (k - i) * size
        start, end = times[first], times[first + size - 1]
        keep = max(int(np.searchsorted(unique, start)) - gap, 0)
        train = np.isin(times, unique[:keep])
        if train.any():
            made.append((int(train.sum()), int(((times >= start) & (times <= end)).sum())))
    return made


@pytest.mark.parametrize("k,gap", [(2, 0), (3, 1), (5, 1), (4, 3)])
def test_folds_match_the_positional_definition(spark, k, gap):
    values = np.random.default_rng(k).integers(-60, 0, 400).tolist()
    df = timed(spark, values)
    found = timeline.fold_info(df, "t", timeline.grouped_time_folds(df, "t", k, gap)).orderBy("fold").collect()
    assert [(r["train_size"], r["val_size"]) for r in found] == positional_folds(values, k, gap)
    assert all(r["train_time_end"] < r["val_time_start"] for r in found)


def test_groups_stay_together(spark):
    df = timed(spark, [-4, -4, -3, -3, -2, -2, -1, -1])
    for fold in timeline.grouped_time_folds(df, "t", 2, 0):
        assert fold.train_end < fold.val_start


def test_fold_errors(spark):
    with pytest.raises(ValueError):
        timeline.grouped_time_folds(timed(spark, [1, 1, 2, 2]), "t", 2)
    with pytest.raises(ValueError):
        timeline.grouped_time_folds(timed(spark, [1, None, 2, 3]), "t", 2)


def test_bucketed_totals_equal_plain_ones(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("k"), F.round(F.rand(3) * 900, 1).alias("x"))
    # A third of all rows share one value.
    hot = df.withColumn("x", F.when(F.col("k") == 0, F.lit(55.5)).otherwise(F.col("x")))
    counted = hot.groupBy("k", "x").agg(F.count(F.lit(1)).alias("rows")).persist()
    edges = ordering.bucket_edges(hot, ["x"], rows_per_bucket=300)["x"]
    assert len(edges) > 5
    for descending in (False, True):
        plain = ordering.running_totals(counted, ["k"], "x", ["rows"], [], descending)
        cut = ordering.running_totals(counted, ["k"], "x", ["rows"], edges, descending).select(plain.columns)
        assert plain.exceptAll(cut).isEmpty() and plain.count() == cut.count()


def test_sampled_edges_leave_totals_exact(spark, monkeypatch):
    monkeypatch.setattr(ordering, "EDGE_SAMPLE", 500)
    df = spark.range(6_000).select(F.round(F.rand(5) * 1_000, 1).alias("x"))
    edges = ordering.bucket_edges(df, ["x"], rows_per_bucket=400)["x"]
    assert 5 < len(edges) < 20
    counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).persist()
    plain = ordering.running_totals(counted, [], "x", ["rows"])
    cut = ordering.running_totals(counted, [], "x", ["rows"], edges).select(plain.columns)
    assert plain.exceptAll(cut).isEmpty() and cut.count() == plain.count()


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_values_at_positions(spark, rows_per_bucket):
    generator = np.random.default_rng(1)
    times = np.where(generator.random(1_200) < 0.4, -7, generator.integers(-50, 0, 1_200))
    df = timed(spark, times.tolist())
    order = sorted((int(t), i) for i, t in enumerate(times))
    asked = [1, 2, 300, 601, 1_199, 1_200]
    assert timeline.values_at(df, "t", "id", asked, rows_per_bucket) == {p: order[p - 1] for p in asked}


def test_sliding_and_ratio_positions(spark):
    assert [vars(f) for f in timeline.sliding_positions(10, 4)][0] == {
        "fold": 1, "train_start": 0, "train_end": 2, "test_start": 2, "test_end": 4
    }
    assert len(timeline.sliding_positions(10, 4, gap=1)) == 3
    with pytest.raises(ValueError):
        timeline.sliding_positions(3, 2, window=3, test=2)
    df = timed(spark, [5, 3, 1, 2, 4, 0, 6, 7])
    folds = timeline.sliding_positions(8, 3)
    found = timeline.sliding_split(df, "t", "id", folds).groupBy("fold", "role").agg(F.sort_array(F.collect_list("t")).alias("t")).collect()
    assert {(r["fold"], r["role"]): r["t"] for r in found}[(2, "test")] == [4, 5]


def test_out_of_time_split(spark):
    df = timed(spark, [9, 1, 1, 1, None, 5])
    found = timeline.out_of_time_split(df, "t", "id", 0.4).groupBy("role").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r["role"]: r["ids"] for r in found} == {"train": [1, 2, 3], "test": [0, 5]}
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            timeline.out_of_time_split(df, "t", "id", bad)
    with pytest.raises(ValueError):
        timeline.out_of_time_split(df, "t", "id", 0.4, min_train=4)


def test_windows_and_leakage(spark):
    df = timed(spark, [-700, -600, -241, -240, 0, 1, None]).withColumn("TARGET", F.lit(1))
    audit = timeline.check_windows(df, "t")
    assert audit == {"source_rows": 7, "dropped_missing_time": 1, "dropped_older": 1, "dev_rows": 2, "oot_rows": 2}
    cut = timeline.cut_windows(df, "t")
    assert cut.count() == 4
    assert timeline.leakage_report(cut, ["f"], "t", "TARGET").first()["temporal_split_disjoint"]
    with pytest.raises(ValueError):
        timeline.leakage_report(cut, ["f", "recent_decision"], "t", "TARGET")
    with pytest.raises(ValueError):
        timeline.leakage_report(cut.withColumn("split", F.when(F.col("id") % 2 == 1, "dev").otherwise("oot")), ["f"], "t", "TARGET")
    with pytest.raises(ValueError):
        timeline.check_windows(df, "t", Windows(-5000, -4000, -3000))
    wide = spark.createDataFrame([(1.0, 0, 1, 2)], "f1 double, TARGET int, recent_decision int, DAYS_DECISION int")
    assert timeline.model_columns(wide, "recent_decision", "TARGET") == ["f1"]


def test_fill_missing_time(spark):
    found = timeline.fill_missing_time(timed(spark, [-10, None, -5]), "t").orderBy("id").collect()
    assert [r["t"] for r in found] == [-10.0, -40.0, -5.0]
    with pytest.raises(ValueError):
        timeline.fill_missing_time(timed(spark, [None]), "t")


def test_last_fold_counts(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.3)], "id long, fold int, score double")
    assert sorted(tuple(r) for r in timeline.last_fold_scores(df, "id").collect()) == [(1, 2, 0.2), (2, 1, 0.3)]


@pytest.mark.parametrize("accuracy,rows_per_part", [(10_000, 10**8), (30, 10**8), (30, 300), (10_000, 50)])
def test_exact_quantiles_whatever_the_sketch(spark, monkeypatch, accuracy, rows_per_part):
    monkeypatch.setattr(quantiles, "ROWS_PER_PART", rows_per_part)
    generator = np.random.default_rng(4)
    x = np.where(generator.random(3_000) < 0.35, 12.5, generator.normal(0, 10, 3_000))
    pdf = [(float(v), float(v) ** 2, None, float(i % 2)) for i, v in enumerate(x)]
    df = spark.createDataFrame(pdf, "a double, `b.c` double, none double, flag double").repartition(7)
    points = [i / 10 for i in range(11)] + [0.05, 0.95]
    found = quantiles.exact_quantiles(df, df.columns, points, accuracy)
    assert found["none"] is None
    assert np.allclose(found["a"], np.quantile(x, points), rtol=0, atol=1e-12)
    assert np.allclose(found["b.c"], np.quantile(x ** 2, points), rtol=1e-12)
    assert found["flag"][0] == 0.0 and found["flag"][10] == 1.0


def test_last_fold_ties_go_by_the_other_columns(spark):
    rows = [(1, 2, 0.2, "b"), (1, 2, 0.7, "a"), (1, 1, 0.9, "z"), (2, 1, None, "c"), (2, 1, 0.1, "c"), (3, None, 0.4, "d")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "id long, fold int, score double, name string").coalesce(1)
        got = sorted(tuple(r) for r in timeline.last_fold_scores(df, "id").collect())
        assert got == [(1, 2, 0.7, "a"), (2, 1, 0.1, "c"), (3, None, 0.4, "d")]
