import math

import pytest
from pyspark.sql import functions as F

from driftwell.functions.numbers import finite, latest, nan_to_null, safe_ratio
from driftwell.operators import history, timeline
from driftwell.sources.tables import null_day_sentinel, sentinel_counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sentinel_only_in_day_columns(spark):
    df = spark.createDataFrame([(-100.0, 365243.0), (365243.0, 1.0)], "DAYS_EMPLOYED double, OTHER_VALUE double")
    assert rows(null_day_sentinel(df), "OTHER_VALUE") == [(None, 1.0), (-100.0, 365243.0)]
    assert rows(sentinel_counts(df), "column") == [("DAYS_EMPLOYED", 1)]


def test_proxy_covers_all_sources(spark):
    previous = spark.createDataFrame([(1, -15.0)], "SK_ID_CURR long, DAYS_DECISION double")
    bureau = spark.createDataFrame([(2, -30.0), (None, -1.0), (2, None)], "SK_ID_CURR long, DAYS_CREDIT double")
    found = timeline.time_proxy({"previous_application": previous, "bureau": bureau})
    assert rows(found, "SK_ID_CURR") == [(1, -15.0), (2, -30.0)]
    assert timeline.time_proxy({"other": previous}) is None


def test_latest_skips_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(latest(F.col("a"), F.col("b"))).collect()] == [1.0, 2.0, None]


def test_safe_ratio_and_finite(spark):
    df = spark.createDataFrame([(1.0, -1e-6), (2.0, 4.0), (math.inf, 1.0)], "a double, b double")
    found = df.select(safe_ratio(F.col("a"), F.col("b")).alias("r"), finite(F.col("a")).alias("f")).collect()
    assert found[0]["r"] is None and abs(found[1]["r"] - 0.5) < 1e-6
    assert [r["f"] for r in found] == [1.0, 2.0, None]


def test_statistics_depend_on_distinct_values(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0, None, "x"), (1, 1, 2.0, None, "y"), (2, 0, 4.0, None, None), (None, 1, 9.0, None, "x"), (3, None, None, None, "x")],
        "k long, flag int, x double, empty double, c string",
    )
    found = history.mass_aggregate(df, "k", "P")
    assert found.columns == [
        "k", "P_flag_MEAN", "P_flag_SUM", "P_x_MIN", "P_x_MAX", "P_x_MEAN", "P_x_SUM", "P_x_VAR", "P_empty_MEAN", "P_empty_SUM",
    ]
    assert rows(found, "k") == [
        (1, 0.5, 1, 1.0, 2.0, 1.5, 3.0, 0.5, None, 0.0),
        (2, 0.0, 0, 4.0, 4.0, 4.0, 4.0, None, None, 0.0),
        (3, None, 0, None, None, None, 0.0, None, None, 0.0),
    ]
    encoded = history.mass_aggregate(df, "k", "P", categorical="onehot")
    assert {"P_c_x_MEAN", "P_c_y_SUM", "P_c_nan_MEAN"} <= set(encoded.columns)
    assert encoded.where("k = 2").first()["P_c_nan_MEAN"] == 1.0
    with pytest.raises(ValueError):
        history.mass_aggregate(df, "k", "P", categorical="other")


def test_one_pass_agrees_with_the_plan(spark):
    """Whole numbers near and far from zero, doubles that rounding leaves open, NULL keys, hot key."""
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 11).alias("k"),
        (F.col("id") % 2).alias("two"), F.when(F.col("id") == 2_999, 2).otherwise(F.col("id") % 2).alias("three"), F.lit(5).alias("one"),
        (F.col("id") % 2 + 10**9).alias("far_two"), F.when(F.col("id") == 0, 10**9 + 2).otherwise(F.col("id") % 2 + 10**9).alias("far_three"),
        F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.3).alias("x_two"),
        F.when(F.col("id") == 7, 0.1 + 1e-12).when(F.col("id") % 2 == 0, 0.1).otherwise(0.3).alias("x_three"),
        F.when(F.col("id") % 2 == 0, 1e200).otherwise(3e200).alias("huge"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") == 3, float("inf")).otherwise(F.col("id") % 2).alias("infinite"), (F.col("id") % 2).cast("float").alias("f"),
        (F.col("id") % 3).cast("decimal(9,2)").alias("d"), F.when(F.col("id") % 5 > 0, F.col("id") % 4).cast("string").alias("c"),
    ).repartition(7)
    for categorical in ("ignore", "onehot"):
        plan = history.profile_for_aggregation(df, "k", categorical)
        assert plan.two_valued == ("two", "one", "far_two", "x_two", "huge", "empty", "infinite", "f")
        planned, found = history.mass_aggregate(df, "k", "P", plan=plan), history.mass_aggregate(df, "k", "P", categorical)
        assert planned.columns == found.columns
        for a, b in zip(rows(planned, "k"), rows(found, "k"), strict=True):
            numbers = [[float("nan") if v is None else float(v) for v in r] for r in (a, b)]
            assert numbers[0] == pytest.approx(numbers[1], rel=1e-5, nan_ok=True)


def test_levels_without_a_bound(spark):
    """1 500 levels: the map agrees with the one-hot columns of some of them, and with the counted rows."""
    df = spark.range(6_000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 4).alias("k"), F.lit(1).alias("n"),
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 3_001)).alias("c"),
    )
    out = history.mass_aggregate(df, "k", "P", categorical="map").collect()
    want = {}
    for r in df.where("k is not null").collect():
        want.setdefault(r.k, []).append(r.c)
    assert {r.k for r in out} == set(want)
    for r in out:
        levels = [c for c in want[r.k] if c is not None]
        assert r.P_ROWS == r.P_n_SUM == len(want[r.k]) and r.P_c_MISSING == len(want[r.k]) - len(levels)
        assert r.P_c_LEVELS == {c: levels.count(c) for c in set(levels)}
    assert max(len(r.P_c_LEVELS) for r in out) > 300
    long = history.level_counts(df, "k", ["c"]).where("level is null").collect()
    assert {r.k: r.rows for r in long} == {r.k: r.P_c_MISSING for r in out if r.P_c_MISSING}
    empty = history.mass_aggregate(df.limit(0), "k", "P", categorical="map")
    assert empty.count() == 0 and "P_c_LEVELS" in empty.columns


def test_no_numbers_gives_distinct_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "a")], "k long, c string")
    assert rows(history.mass_aggregate(df, "k", "P"), "k") == [(1,), (2,)]


def test_profile_is_exact_for_many_partitions(spark):
    df = spark.range(10_000).select(
        (F.col("id") % 7).alias("k"),
        (F.col("id") % 2).alias("two"),
        F.when(F.col("id") == 9_999, 2).otherwise(F.col("id") % 2).alias("three"),
        F.lit(5).alias("one"),
    ).repartition(16)
    plan = history.profile_for_aggregation(df, "k")
    assert set(plan.two_valued) == {"two", "one"} and plan.many_valued == ("three",)


def test_profile_settles_rounding(spark):
    """Bins of equal fractions may differ in the last bit; the exact count decides."""
    df = spark.range(4_000).select(
        (F.col("id") % 5).alias("k"),
        F.when(F.rand(1) < 0.37, 0.1).otherwise(0.7).alias("two"),
        F.when(F.rand(2) < 0.5, 0.1).when(F.rand(3) < 0.5, 0.1 + 1e-12).otherwise(0.7).alias("close"),
    ).repartition(13)
    plan = history.profile_for_aggregation(df, "k")
    assert plan.two_valued == ("two",) and plan.many_valued == ("close",)


def test_two_level_rollup_by_hand(spark):
    bureau = spark.createDataFrame(
        [(1, 10, 100.0, 50.0, -30.0, 0.0), (1, 11, 200.0, 300.0, -20.0, 10.0), (2, 12, 0.0, None, -10.0, None)],
        "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, DAYS_CREDIT double, DAYS_CREDIT_ENDDATE double",
    )
    balance = spark.createDataFrame([(10, -1), (10, -2), (10, -3), (11, -5)], "SK_ID_BUREAU long, MONTHS_BALANCE long")
    found = {r["SK_ID_CURR"]: r.asDict() for r in history.bureau_features(bureau, balance).collect()}
    assert found[1]["BURO_BB_MONTHS_BALANCE_MIN_MEAN"] == -4.0
    assert found[1]["BURO_DEBT_CREDIT_DIFF_SUM"] == -50.0
    assert abs(found[1]["BURO_DEBT_RATIO_MEAN"] - 1.0) < 1e-6
    assert found[1]["BURO_CREDIT_DURATION_MEAN"] == 30.0
    assert found[2]["BURO_BB_MONTHS_BALANCE_MIN_MEAN"] is None
    assert not any(c.startswith("BURO_SK_ID") for c in found[1])


def test_latest_row_and_joins(spark):
    df = spark.createDataFrame([(1, -5, 1, "a"), (1, -2, 2, "b"), (1, -2, 3, "c"), (2, -9, 4, "d")], "k long, day int, id long, v string")
    assert rows(history.latest_per_key(df, "k", "day", "id"), "k") == [(1, -2, 3, "c"), (2, -9, 4, "d")]
    base = spark.createDataFrame([(1, 0), (3, 1)], "SK_ID_CURR long, TARGET int")
    feature = spark.createDataFrame([(1, 7.0)], "SK_ID_CURR long, f double")
    features, labels, merged = history.prepare_dataset(base, [feature])
    assert features.columns == ["f"] and labels.columns == ["SK_ID_CURR", "TARGET"]
    assert rows(merged, "SK_ID_CURR") == [(1, 0, 7.0), (3, 1, None)]


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y int"))
    assert rows(df, "y") == [(None, 1)]


def test_three_medians_read_their_table_twice(spark):
    df = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"), (F.col("id") % 101).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 7).cast("double").alias("y"), F.lit(None).cast("double").alias("z"),
    )
    spec = {"mx": ("x", "median"), "my": ("y", "median"), "mz": ("z", "median"), "again": ("x", "median"), "n": ("x", "count")}
    plain = df.groupBy("k").agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.median("z").alias("mz"), F.median("x").alias("again"), F.count("x").alias("n"))
    for rows_per_bucket in (1_000_000, 50):
        made = history.grouped_medians(df, "k", {"mx": "x", "my": "y"}, rows_per_bucket)
        assert rows(made, "k") == rows(plain.select("k", "mx", "my"), "k")
    found = history.named_aggregate(df, "k", spec)
    assert rows(found, "k") == rows(plain, "k")
    # The values are written once; what is returned reads the table for the other aggregates alone.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 2000") == 1


def test_medians_of_hot_keys(spark):
    df = spark.range(3_001).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11 + 2).alias("k"), F.round(F.rand(1) * 50, 1).alias("x")
    )
    plain = df.groupBy("k").agg(F.median("x").alias("m"))
    for rows_per_bucket in (1_000_000, 100):
        ranked = history.grouped_median(df, "k", "x", "m", rows_per_bucket)
        joined = ranked.join(plain.withColumnRenamed("m", "p"), "k")
        assert joined.count() == plain.count() and joined.where("abs(m - p) > 1e-12").isEmpty()
    with pytest.raises(ValueError):
        history.named_aggregate(df, "k", {"a": ("x", "mode")})


def test_kept_plans_give_the_same_features(spark):
    bureau = spark.createDataFrame(
        [(1, 10, 100.0, 50.0, -30.0, 0.0), (1, 11, 200.0, 300.0, -20.0, 10.0), (2, 12, 7.0, None, -10.0, None)],
        "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, DAYS_CREDIT double, DAYS_CREDIT_ENDDATE double",
    )
    balance = spark.createDataFrame([(10, -1, "x"), (10, -2, "y"), (11, -5, "x")], "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string")
    pos = spark.createDataFrame([(1, -1, 0, 10.0, 5.0), (2, -2, 3, 10.0, None)], "SK_ID_CURR long, MONTHS_BALANCE long, SK_DPD long, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double")
    tables = {"bureau": bureau, "bureau_balance": balance, "POS_CASH_balance": pos}
    plans = {k: history.AggregationPlan.from_json(p.to_json()) for k, p in history.profile_histories(tables, "onehot").items()}
    assert set(plans) == {"BB", "BURO", "POS"} and plans["BB"].levels == (("STATUS", ("x", "y", None)),)
    for kept, fresh in zip(history.all_history_features(tables, plans, categorical="onehot"), history.all_history_features(tables, categorical="onehot")):
        assert kept.columns == fresh.columns and kept.exceptAll(fresh).isEmpty() and kept.count() == fresh.count()


def test_infinities_are_missing_in_mass_aggregation(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, math.inf), (2, math.nan), (2, 1.0)], "k int, v double")
    found = history.mass_aggregate(df, "k", "P")
    assert [c for c in found.columns if c != "k"] == ["P_v_MEAN", "P_v_SUM"]
    assert rows(found.select("k", "P_v_MEAN", "P_v_SUM"), "k") == [(1, 0.5, 1.0), (2, 1.0, 1.0)]


def test_rows_meet_by_key_before_they_are_aggregated(spark):
    """Every key is in every partition; a task that aggregated those would hold all groups."""
    cells = [(i % 50 if i % 51 else None, float(i % 7), i) for i in range(2_000)]
    df = spark.createDataFrame(cells, "SK_ID_CURR long, x double, n long").repartition(8)
    dealt = history.gathered(df, "SK_ID_CURR")
    assert dealt.columns == df.columns and sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    places = dealt.withColumn("at", F.spark_partition_id()).groupBy("SK_ID_CURR").agg(F.count_distinct("at").alias("n"))
    assert {r["n"] for r in places.collect()} == {1}
    plan = history.AggregationPlan(("n",), ("x",))
    made = history.mass_aggregate(df, "SK_ID_CURR", "P", plan=plan)
    assert "RebalancePartitions" in made._jdf.queryExecution().optimizedPlan().toString()
    whole = history.mass_aggregate(df, "SK_ID_CURR", "P")
    for table in (made, whole):
        got = {r["SK_ID_CURR"]: (r["P_x_MIN"], r["P_x_MAX"], r["P_x_SUM"], r["P_n_SUM"]) for r in table.collect()}
        assert len(got) == 50
        for key, values in got.items():
            own = [r for r in cells if r[0] == key]
            assert values == (min(r[1] for r in own), max(r[1] for r in own), sum(r[1] for r in own), sum(r[2] for r in own))


def test_proxy_from_the_newest_values_reads_one_row_per_key(spark):
    pos = spark.createDataFrame([(1, -3), (1, -1), (2, -9), (3, None), (None, 0)], "SK_ID_CURR long, MONTHS_BALANCE long")
    paid = spark.createDataFrame(
        [(1, -50.0, -60.0), (1, -70.0, -20.0), (4, None, -5.0), (4, -8.0, float("nan")), (5, None, None)],
        "SK_ID_CURR long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double",
    ).withColumns({"AMT_INSTALMENT": F.lit(1.0), "AMT_PAYMENT": F.lit(2.0)})
    # Two days only: the feature table has no maximum, so the history itself is read.
    previous = spark.createDataFrame([(6, -4), (6, -2), (7, -4)], "SK_ID_CURR long, DAYS_DECISION long")
    tables = {"POS_CASH_balance": pos, "installments_payments": paid, "previous_application": previous}
    made = [
        history.mass_aggregate(pos, "SK_ID_CURR", "POS"), history.mass_aggregate(previous, "SK_ID_CURR", "PREV"),
        history.mass_aggregate(paid, "SK_ID_CURR", "INSTAL"),
    ]
    cut = timeline.newest_only(tables, made)
    assert cut["previous_application"] is previous
    assert cut["installments_payments"].count() == 3 and cut["POS_CASH_balance"].count() == 3
    found = rows(timeline.time_proxy(cut), "SK_ID_CURR")
    assert found == rows(timeline.time_proxy(tables), "SK_ID_CURR") == [(1, -20.0), (2, -270.0), (4, -5.0), (6, -2.0), (7, -4.0)]


def test_wide_tables_are_joined_as_one_value(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, name string")
    wide = spark.createDataFrame([(1, 7), (3, 8)], "k long, x long").select("k", *[(F.col("x") + i).alias(f"w.{i}") for i in range(12)])
    slim = spark.createDataFrame([(2, 1.5)], "k long, y double")
    made = history.merge_features(base, [wide, slim], "k")
    plain = base.join(wide, "k", "left").join(slim, "k", "left")
    assert made.schema == plain.schema and rows(made, "name") == rows(plain, "name")
    assert "_packed0" in made._jdf.queryExecution().optimizedPlan().toString()
    # Names that come twice stay as they are in plain joins.
    twice = history.merge_features(base, [wide, wide.select("k", "`w.0`")], "k")
    assert twice.columns == base.join(wide, "k", "left").join(wide.select("k", "`w.0`"), "k", "left").columns


def test_three_values_in_the_first_groups_settle_a_column(spark, monkeypatch):
    df = spark.range(60).select(
        (F.col("id") % 20).alias("k"), F.col("id").alias("many"), (F.col("id") % 2).alias("two"),
        F.when(F.col("id") == 59, 5).otherwise(F.col("id") % 2).alias("late"), F.lit(3).alias("one"),
    )
    whole = history.mass_aggregate(df, "k", "T")
    proven = history._proven(whole.select("k", *[F.lit(v).alias(f"T_{c}_{s}") for c, v in (("many", 1), ("two", 1)) for s in ("MIN", "MAX")]), "T", ["many", "two"])
    assert proven == set()
    assert {"T_many_VAR", "T_late_VAR"} <= set(whole.columns) and not {"T_two_VAR", "T_one_VAR"} & set(whole.columns)
    monkeypatch.setattr(history, "FIRST_GROUPS", 1)
    again = history.mass_aggregate(df, "k", "T")
    assert again.columns == whole.columns and rows(again, "k") == rows(whole, "k")
