import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import labels
from driftwell.operators import preprocess, profile


def test_profile_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 10.0, 20.0, 30.0, 40.0)], "AMT_CREDIT double")
    descriptions = spark.createDataFrame([("AMT_CREDIT", "Credit amount", "application_train")], "feature string, description string, table string")
    found = profile.feature_metadata(df, ["AMT_CREDIT"], descriptions).first()
    assert [found[p] for p in profile.PERCENTILES] == [2.0, 10.0, 20.0, 30.0, 38.0]
    assert found["description"] == "Credit amount" and found["table"] == "application_train"
    assert found["semantic_group"] == "application_amounts" and found["var"] == 250.0


def test_profile_of_text_infinity_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("a", math.inf, None), ("b", 1.0, None), (None, 3.0, None)], "c string, x double, empty double"
    )
    found = {r["feature"]: r for r in profile.feature_metadata(df, df.columns).collect()}
    assert found["c"]["unique_count"] == 2 and abs(found["c"]["missing_rate"] - 0.3333) < 1e-9
    assert found["x"]["max"] == 3.0 and found["x"]["mean"] == 2.0 and found["x"]["non_null_count"] == 3
    assert found["empty"]["missing_rate"] == 1.0 and found["empty"]["mean"] is None and found["empty"]["p50"] is None


def test_missing_filter(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "a int, b string, c double")
    fitted = profile.MissingRateFilter(0.5).fit(df)
    assert fitted.selected == ["a", "c"] and fitted.transform(df).columns == ["a", "c"]
    assert [tuple(r) for r in profile.missing_rates(df).collect()] == [("b", 1.0), ("c", 0.5), ("a", 0.0)]
    with pytest.raises(ValueError):
        profile.MissingRateFilter(1.5)


def test_correlation_of_pairwise_complete_rows(spark):
    generator = np.random.default_rng(0)
    x = generator.normal(1e6, 1, 200)
    y = x * 2 + generator.normal(0, 1, 200)
    rows = [(float(a), None if i % 7 == 0 else float(b), 0.1, float(i)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, constant double, i double")
    found = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df).collect()}
    keep = np.arange(200) % 7 != 0
    assert abs(found["x", "y"] - np.corrcoef(x[keep], y[keep])[0, 1]) < 1e-9
    assert found["x", "constant"] is None and abs(found["x", "x"] - 1) < 1e-9
    assert profile.correlation_matrix(df, ["x"]).isEmpty()


def test_names_are_read_back(spark):
    df = spark.createDataFrame([(n,) for n in ("BURO_AMT_CREDIT_MAX", "CC_X", "DAYS_BIRTH", "AVERAGE_X")], "n string")
    n = F.col("n")
    found = df.select(labels.engineered_description(n), labels.engineered_table(n), labels.semantic_group(n)).collect()
    assert [tuple(r) for r in found] == [
        ("maximum of amt credit from bureau", "bureau", "bureau_credit_history"),
        ("cc x", "credit_card_balance", "credit_card_utilization"),
        ("days birth", "", "demographic_time_variables"),
        ("average x", "", "demographic_time_variables"),
    ]


def test_month_labels(spark):
    df = spark.createDataFrame([(-45.0,), (-75.0,), (-31.0,)], "d double")
    found = df.select(labels.month_bucket(F.col("d")), labels.month_floor(F.col("d")), labels.month_ceil(F.col("d"))).collect()
    assert [tuple(r) for r in found] == [("M-2", -2, -1), ("M-2", -3, -2), ("M-1", -2, -1)]


def test_cards_and_signature(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, c string")
    cards = profile.feature_cards(profile.feature_metadata(df, ["x", "c"]))
    lines = [r["card"] for r in cards.orderBy("position").collect()]
    assert lines[0].startswith("- x | semantic_group=other | table=application_train | dtype=double | missing_rate=0.0% | non_null_count=2 | desc=x | mean=1.5 | min=1.0")
    assert lines[1].endswith("missing_rate=50.0% | non_null_count=1 | desc=c | unique_count=1")
    signature = profile.cards_signature(cards.repartition(3), 0.5, "f").first()["metadata_signature"]
    assert signature == hashlib.sha256("\n".join([*lines, "0.500000", "f"]).encode()).hexdigest()


# ---- Preprocessing ----

def test_scaling_is_finite_and_uses_training_rows(spark):
    train = spark.createDataFrame([(1.0, "Cash"), (math.inf, "Cash"), (3.0, "Revolving")], "AMT_CREDIT double, KIND string")
    fitted = preprocess.Preprocessor(min_frequency=1).fit(train)
    out = fitted.transform(train).toPandas()
    assert np.isfinite(out.to_numpy()).all()
    assert np.allclose(out["AMT_CREDIT"], [-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    new = fitted.transform(spark.createDataFrame([(None, "Other")], "AMT_CREDIT double, KIND string")).first()
    assert new["AMT_CREDIT"] == 0.0 and new["KIND_Cash"] == 0.0 and new["KIND_Revolving"] == 0.0
    again = preprocess.Preprocessor.from_settings(fitted.settings())
    assert again.transform(train).exceptAll(fitted.transform(train)).isEmpty()


@pytest.mark.parametrize("strategy,scaler", [("mean", "standard"), ("median", "standard"), ("zero", "minmax"), ("mean", None)])
def test_scaler_against_numpy(spark, strategy, scaler):
    generator = np.random.default_rng(1)
    x = np.where(generator.random(300) < 0.2, np.nan, generator.normal(50, 9, 300))
    df = spark.createDataFrame([(None if np.isnan(v) else float(v), 0.1, None) for v in x], "x double, constant double, empty double").repartition(5)
    made = preprocess.NumberScaler(strategy, scaler).fit(df)
    fill = {"mean": np.nanmean(x), "median": np.nanmedian(x), "zero": 0.0}[strategy]
    filled = np.where(np.isnan(x), fill, x)
    if scaler == "standard":
        expected = (filled - filled.mean()) / filled.std()
    elif scaler == "minmax":
        expected = (filled - filled.min()) / (filled.max() - filled.min())
    else:
        expected = filled
    out = df.select(*made.expressions()).toPandas()
    assert np.allclose(np.sort(out["x"]), np.sort(expected))
    assert (out["empty"] == 0).all() and out["constant"].nunique() == 1
    with pytest.raises(ValueError):
        preprocess.NumberScaler("mode").fit(df)


def test_rare_levels_are_pooled(spark):
    rows = [("a",)] * 12 + [("b",)] * 11 + [("c",)] * 2 + [(None,)] * 3
    df = spark.createDataFrame(rows, "t string")
    made = preprocess.LevelEncoder().fit(df)
    out = made.attach(df).select(*made.expressions())
    assert out.columns == ["t_a", "t_b", "t_infrequent_sklearn"]
    assert out.agg(F.sum("t_infrequent_sklearn")).first()[0] == 5.0
    # Too many levels to spell out: looked up, with the same result.
    many = preprocess.LevelEncoder(spelled_out=2)
    wide = df.unionByName(spark.range(50).select(F.concat(F.lit("r"), F.col("id")).alias("t")))
    many.fit(wide)
    assert many.sizes == {"t": (2, 52)} and not many._whole("t")
    unseen = wide.unionByName(spark.createDataFrame([("new",)], "t string"))
    assert many.attach(unseen).select(*many.expressions()).agg(F.sum("t_infrequent_sklearn")).first()[0] == 55.0
    every = preprocess.LevelEncoder(min_frequency=1, spelled_out=2).fit(wide)
    out = every.attach(wide).select(*every.expressions())
    assert len(out.columns) == 54 and out.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in out.columns]).first().asDict() == {
        f"t_{v}": float(n) for v, n in wide.fillna("Missing").groupBy("t").count().collect()
    }


def level_rows(spark, n=12_000):
    """A third of the rows with one level, NULLs, and ``n`` levels of one row each."""
    hot = spark.range(n // 2).select(F.lit("hot").alias("t"), F.lit(1.5).alias("x"))
    return hot.unionByName(spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("t"), (F.col("id") % 7).cast("double").alias("x"))).unionByName(
        spark.range(40).select(F.lit(None).cast("string").alias("t"), F.lit(None).cast("double").alias("x"))
    )


@pytest.mark.parametrize("least,frequent", [(10, 2), (1, 12_002)])
def test_dictionary_of_many_levels_survives_a_reload(spark, tmp_path, least, frequent):
    df = level_rows(spark)
    fitted = preprocess.Preprocessor(min_frequency=least).fit(df)
    assert fitted.levels.sizes == {"t": (frequent, 12_002 - frequent)} and set(fitted.levels.spelled["t"]) == {"hot"}
    fitted.save(spark, str(tmp_path / "p"))
    again = preprocess.Preprocessor.load(spark, str(tmp_path / "p"))
    new = df.unionByName(spark.createDataFrame([("new", 1.0)], "t string, x double"))
    rows = again.transform_sparse(new, "t").collect()
    assert sorted(map(str, rows)) == sorted(map(str, fitted.transform_sparse(new, "t").collect()))
    names = again.output_columns()
    assert len(names) == 1 + frequent + (least > 1)
    for r in rows:
        ones = [names[i] for i, v in zip(r.indices, r.values) if i]
        level = "Missing" if r.t is None else r.t
        assert ones == ([] if level == "new" else [f"t_{level}" if f"t_{level}" in (names if frequent < 9 else ones) else "t_infrequent_sklearn"])
    with pytest.raises(ValueError):
        preprocess.Preprocessor.from_settings(fitted.settings()).transform_sparse(new)


def test_hot_level_does_not_travel(spark):
    """A third of the rows hold one level: the join deals them over all partitions."""
    made = preprocess.LevelEncoder().fit(level_rows(spark), ["t"])
    made._lookups["t"] = made.table.select(F.concat(F.lit("l"), F.col("level")).alias("_key"), F.col("code").alias("_found"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = made.attach(level_rows(spark))
        dealt = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(dealt) == 18_040 and max(dealt) < 6_000
        assert out.where("t = 'hot'").select("_code0").distinct().count() == 1
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_levels_of_nothing(spark):
    empty = spark.createDataFrame([], "t string, x double")
    made = preprocess.Preprocessor().fit(empty)
    assert made.output_columns() == ["x"] and made.transform(empty).count() == 0 and made.transform_sparse(empty).count() == 0
    no_text = spark.createDataFrame([(1.0,)], "x double")
    assert preprocess.Preprocessor().fit(no_text).transform_sparse(no_text).collect()[0].indices == []


@pytest.mark.parametrize("side", [3, 256])
def test_products_in_blocks(spark, monkeypatch, side):
    from driftwell.operators import gram

    monkeypatch.setattr(gram, "SIDE", side)
    x = np.random.default_rng(side).integers(-9, 9, (200, 8)).astype(float)
    df = spark.createDataFrame([(r.tolist(), [i for i, v in enumerate(r) if v], [v for v in r.tolist() if v]) for r in x], "d array<double>, i array<int>, v array<double>").repartition(7)
    for cells in (gram.gram_cells(df, 8, F.col("d")), gram.gram_cells(df, 8, F.col("v"), F.col("i"))):
        found = {(r.i, r.j): r.value for r in cells.collect()}
        assert found == {(i, j): (x.T @ x)[i, j] for i in range(8) for j in range(i, 8)}
    assert gram.gram_cells(df.limit(0), 8, F.col("d")).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20])
def test_rank_correlation_of_gappy_columns(spark, rows_per_bucket):
    import pandas as pd

    rng = np.random.default_rng(8)
    n = 400
    data = {c: np.round(rng.normal(size=n), 1) for c in "abcdef"}
    data["a"][rng.random(n) < 0.4] = 0.0
    gone = rng.random(n) < 0.3
    data["c"][gone] = data["d"][gone] = np.nan
    data["e"][rng.random(n) < 0.5] = np.nan
    data["f"][~gone] = np.nan
    data["g"] = np.where(np.isnan(data["c"]), np.nan, 3.0)
    want = pd.DataFrame(data).corr("spearman")
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    found = profile.rank_correlation(df, list(data), rows_per_bucket).collect()
    assert len(found) == len(data) ** 2
    for r in found:
        expected = want.loc[r.feature_a, r.feature_b]
        assert r.correlation is None if math.isnan(expected) else abs(r.correlation - expected) < 1e-12, r
    numbered = df.withColumn("row", F.monotonically_increasing_id())
    assert profile.presence_classes(numbered, "row", list(data)) == [0, 0, 1, 1, 2, 3, 1]
    assert profile.rank_correlation(df.limit(0), ["a", "b"]).where("correlation is not null").isEmpty()


def test_rank_correlation_jobs_do_not_depend_on_columns(spark):
    def jobs(p):
        df = spark.range(60).select(*[F.when(F.col("id") % (i + 3) != 0, (F.col("id") * (i + 7)) % 31).cast("double").alias(f"c{i}") for i in range(p)])
        group = f"rank{p}"
        spark.sparkContext.setJobGroup(group, group)
        profile.rank_correlation(df, df.columns).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(9)


def test_rank_correlation_by_pairs(spark):
    import pandas as pd

    data = {
        "a": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "b": [2.0, 1.0, 4.0, 3.0, 6.0, 5.0],
        "c": [None, 9.0, 1.0, None, 4.0, 2.0], "same": [7.0] * 6, "none": [None] * 6,
    }
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data))
    want = pd.DataFrame(data, dtype=float).corr("spearman")
    for r in profile.rank_correlation(df, list(data)).collect():
        expected = want.loc[r.feature_a, r.feature_b]
        assert r.correlation is None if math.isnan(expected) else abs(r.correlation - expected) < 1e-12
