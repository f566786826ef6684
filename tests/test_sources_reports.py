import json

import pytest
from pyspark.sql import functions as F

from driftwell.operators import reports
from driftwell.sources import runs, tables


def test_load_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SK_ID_CURR,DAYS_X,NAME\n1,365243,é\n2,-5,b\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("K,NAME\n1,caf\xe9\n".encode("latin1"))
    found = tables.load_tables(spark, str(tmp_path))
    assert sorted(found) == ["a", "b"] and found.get("absent") is None
    assert [r["DAYS_X"] for r in found["a"].orderBy("SK_ID_CURR").collect()] == [None, -5]
    assert found["a"].orderBy("SK_ID_CURR").first()["NAME"] == "é" and found["b"].first()["NAME"] == "café"
    typed = tables.load_tables(spark, str(tmp_path), {"b": "K long, NAME string"})
    assert dict(typed["b"].dtypes) == {"K": "bigint", "NAME": "string"}
    version = tables.data_version(spark, str(tmp_path)).collect()
    assert [r["name"] for r in version] == ["a.csv", "b.csv"] and version[0]["modified_utc"].endswith("+00:00")
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        tables.load_tables(spark, str(tmp_path / "empty"))


def test_load_tables_that_are_folders(spark, tmp_path, monkeypatch):
    # As Spark writes tables: folders of files, plain or split by a column, beside single files and other folders.
    top = tmp_path / "in" / "in"
    spark.range(100).repartition(3).write.parquet(str(top / "many.parquet"))
    spark.range(10).selectExpr("id", "id % 2 AS half").write.partitionBy("half").parquet(str(top / "split.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(top / "more" / "inner.parquet"))
    next((top / "more" / "inner.parquet").glob("part-*.parquet")).replace(top / "single.parquet")
    monkeypatch.chdir(top)
    for folder in (str(top), f"{top}/", f"file://{top}", f"{top}/more/.."):
        found = tables.load_tables(spark, folder, file_format="parquet")
        assert {t: df.count() for t, df in found.items()} == {"many": 100, "split": 10, "single": 7} and not found.load_errors
        assert set(found["split"].columns) == {"id", "half"}
    spark.range(5).selectExpr("id AS a", "id AS b").repartition(2).write.option("header", True).csv(str(top / "c.csv"))
    assert tables.load_tables(spark, str(top))["c"].count() == 5
    names = [r["name"] for r in tables.data_version(spark, str(top)).collect()]
    assert len(names) == 2 and all(n.startswith("c.csv/part-") for n in names)


def test_descriptions(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Table,Row,Description\napp, AMT ,first\napp,AMT, second \n,nan,x\n,,y\nb,Z,\n")
    found = {r["feature"]: (r["description"], r["table"]) for r in tables.load_descriptions(spark, str(path)).collect()}
    assert found == {"AMT": ("second", "app"), "Z": ("", "b")}


def test_contract(spark):
    base = spark.createDataFrame([(1, 0), (1, 1), (None, 0)], "SK_ID_CURR long, TARGET int")
    previous = spark.createDataFrame([(1, -3)], "SK_ID_CURR long, DAYS_DECISION int")
    found = {(r["table"], r["check"]): (r["ok"], r["detail"]) for r in tables.check_contract(
        {"application_train": base, "previous_application": previous}, keys={"application_train": "SK_ID_CURR"}
    ).collect()}
    assert found["application_train", "columns"] == (True, "") and found["", "temporal_source"][0]
    assert found["application_train", "key_nulls"] == (False, "1") and found["application_train", "key_duplicates"] == (False, "1")


def test_run_store(spark, tmp_path):
    store = runs.RunStore(str(tmp_path / "store"))
    assert store.read(spark, "cv_results") is None
    frame = lambda v: spark.createDataFrame([(v,)], "x int")
    store.write("cv_results", frame(1), "one")
    store.write("cv_results", frame(2), "two")
    store.write("cv_results", frame(3), "one")
    assert sorted(tuple(r) for r in store.read(spark, "cv_results").collect()) == [(2, "two"), (3, "one")]
    store.write("trace", frame(1), "one", mode="append")
    store.write("trace", frame(2), "one", mode="append")
    assert store.read(spark, "trace", ["one"]).count() == 2
    listed = spark.createDataFrame([("one", "statistical"), ("two", "hybrid")], "run_id string, experiment_type string")
    missing = store.missing_artifacts(spark, listed)
    assert missing.where("artifact = 'cv_results'").isEmpty()
    assert missing.where("artifact = 'llm_hybrid_trace'").select("run_id").collect() == [("two",)]


def write_run(root, name, manifest, files):
    folder = root / name
    (folder / "results").mkdir(parents=True)
    (folder / "run_manifest.json").write_text(json.dumps(manifest, indent=2))
    for path, text in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


def test_run_folders(spark, tmp_path):
    write_run(tmp_path, "r1", {"run_id": "r1", "status": "completed", "llm_metadata_signatures": ["s"], "data_version": {"path": "data"}},
              {"results/cv_results.csv": "fold,auc\n1,0.7\n2,0.74\nmean,0.72\n",
               "features/fold_1/selected_features.csv": "feature\na\nb\n", "features/fold_2/selected_features.csv": "feature\na\n"})
    write_run(tmp_path, "r2", {"run_id": "r2", "status": "failed", "error": "x", "llm_metadata_signatures": ["s"]}, {})
    (tmp_path / "run_manifest.json").write_text("{}")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "run_manifest.json").write_text("{not json")
    manifests = runs.read_manifests(spark, str(tmp_path))
    assert sorted(r["run_id"] for r in manifests.collect()) == ["r1", "r2"]
    assert reports.failed_runs(manifests.withColumn("output_folder", F.col("run_folder"))).first()["error"] == "x"
    calls = {r["run_id"]: r for r in reports.call_summary(manifests).collect()}
    assert list(calls["r1"].asDict()) == reports.CALL_COLUMNS
    assert calls["r1"]["runs_sharing_metadata_signatures"] == "r1;r2" and calls["r2"]["llm_cache_hits"] == 0
    cv = runs.read_run_csv(spark, str(tmp_path), "cv_results.csv")
    assert cv.count() == 3 and cv.first()["run_folder"].endswith("r1")
    assert abs(reports.fold_summary(cv, "run_folder").first()["cv_auc_mean"] - 0.72) < 1e-12
    features = runs.read_fold_features(spark, str(tmp_path / "r1" / "features"))
    assert sorted((r["fold_id"], r["feature_name"]) for r in features.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    (tmp_path / "r1" / "features" / "fold_selected_features.csv").write_text("fold_id,feature_name,rank\n1,z,1\n")
    assert [r["feature_name"] for r in runs.read_fold_features(spark, str(tmp_path / "r1" / "features")).collect()] == ["z"]


def test_completed_runs(spark):
    listed = spark.createDataFrame([("a", "statistical"), ("b", "llm")], "run_id string, experiment_type string")
    present = spark.createDataFrame([(r, n) for r in ("a", "b") for n in runs.REQUIRED_ARTIFACTS], "run_id string, artifact string")
    assert [r["run_id"] for r in runs.completed_runs(listed, present).collect()] == ["a"]


CV = "run_id string, fold string, auc double, gini double, psi_model double"


def test_paired_runs(spark):
    cv = spark.createDataFrame([
        ("base", "1", 0.70, 0.40, 0.1), ("base", "2", 0.74, 0.48, 0.2), ("base", "mean", 0.72, 0.44, 0.15),
        ("cand", "1", 0.75, 0.50, 0.1), ("cand", "2", 0.79, 0.58, 0.2),
    ], CV)
    listed = spark.createDataFrame(
        [("base", "lr", "mrmr", "statistical"), ("cand", "lr", "llm", "llm"), ("other", "rf", "llm", "llm")],
        "run_id string, model string, selector string, experiment_type string",
    )
    found = {r["metric"]: r for r in reports.paired_fold_deltas(cv, listed).collect()}
    assert found["auc"]["fold_count"] == 2 and abs(found["auc"]["mean_delta_candidate_minus_baseline"] - 0.05) < 1e-12
    oot = spark.createDataFrame([("base", 0.7, 0.4), ("cand", 0.75, 0.5)], "run_id string, auc double, gini double")
    summary = reports.experiment_summary(listed.select("run_id"), cv, oot)
    assert abs(summary.where("run_id = 'base'").first()["cv_auc_mean"] - 0.72) < 1e-12
    log = spark.createDataFrame([("base", 1, "a"), ("base", 1, "b"), ("cand", 1, "a"), ("cand", 2, "a")], "run_id string, fold_id int, feature_name string")
    row, overlap = reports.compare_pair(summary, log, "base", "cand", log.where("fold_id = 1"))
    found = row.first()
    assert found["delta_oot_auc_right_minus_left"] == 0.05 and found["delta_cv_auc_mean_right_minus_left"] == 0.05
    assert found["feature_overlap_fold_count"] == 1 and found["feature_overlap_final_jaccard"] == 0.5
    assert reports.help_summary(row).first()["helped"] == "yes"
    assert sorted(r["stage"] for r in overlap.collect()) == ["final", "fold"]


def test_run_table_columns(spark):
    manifests = spark.createDataFrame(
        [("r1", "completed", "lr", "llm", "llm", 20), ("r2", "failed", "lr", "llm", "llm", 20)],
        "run_id string, status string, model string, selector string, experiment_type string, feature_budget int",
    )
    summary = spark.createDataFrame([("r1", 0.8, 0.6, 7.0, 0.3)], "run_id string, oot_auc double, oot_gini double, final_selected_feature_count double, cv_jaccard_similarity_mean double")
    intervals = spark.createDataFrame([("r1", 0.1)], "run_id string, oot_gini_ci_lower double")
    table = reports.run_table(manifests, summary, intervals=intervals)
    assert table.columns == [*reports.FINAL_COLUMNS, "oot_gini_ci_lower"]
    row = table.first()
    assert table.count() == 1 and row["selected_feature_count"] == 7.0 and row["mean_pairwise_jaccard"] == 0.3
    assert reports.stability_table(table).columns == reports.STABILITY_TABLE


def test_runtime_fallback_and_calls(spark):
    cv = spark.createDataFrame([("a", "1", 2.0), ("a", "2", 3.0), ("a", "mean", 2.5), ("b", "1", 9.0)], "run_id string, fold string, fold_time_sec double")
    total = spark.createDataFrame([("b", 50.0)], "run_id string, total_runtime_seconds double")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    found = {r["run_id"]: r["runtime_seconds"] for r in reports.runtime_seconds(listed, total, cv).collect()}
    assert found == {"a": 5.0, "b": 50.0, "c": None}
    log = spark.createDataFrame(
        [("r", "fold", 1, "s", "False", 10, 1, 11)] * 3 + [("r", "fold", 2, "s", "True", 10, 1, 11), ("r", "final", None, "t", "0", 5, 1, 6)],
        "run_id string, scope string, fold_id int, metadata_signature string, cache_hit string, prompt_tokens int, completion_tokens int, total_tokens int",
    )
    row = reports.ranking_call_stats(log).first()
    assert (row["llm_calls_actually_made"], row["llm_cache_hits"], row["llm_prompt_tokens"], row["llm_total_tokens"]) == (2, 1, 15, 17)


def test_temporal_tables(spark):
    folds = spark.createDataFrame([("m", "1", -600.0, -450.0, 0.4), ("m", "2", -449.0, -240.0, 0.5), ("m", "mean", None, None, 0.45)],
                                  "label string, fold string, val_time_start double, val_time_end double, gini double")
    table = reports.temporal_table(folds)
    assert [r["month_label"] for r in table.orderBy("fold").collect()] == ["M-20 to M-15", "M-15 to M-8"]
    assert reports.temporal_table_name(table) == "monthly_metric_table"
    assert reports.temporal_table_name(table.where("fold = 1")) == "temporal_metric_table"
