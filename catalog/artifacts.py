"""Tables and run artifacts written, scanned and joined again: what a run stores must come back as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORDERS, query, scored_orders, table
from catalog.reporting import CV, fold_metrics, runs
from catalog.scores import shifted_orders
from driftwell.operators import reports
from driftwell.session import checkpoint_dir, written_table
from driftwell.sources import runs as run_artifacts
from driftwell.sources.tables import load_tables

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


def run_root(spark: SparkSession) -> str:
    """A fresh folder for runs where all executors can reach it."""
    return f"{checkpoint_dir(spark)}/driftwell-runs-{uuid.uuid4().hex}"


@query("loaded_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in TABLES))
def loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the folder by its name, with its rows."""
    found = load_tables(spark, sf_dir, file_format="parquet")
    counted = [found[t].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in TABLES]
    whole = counted[0]
    for part in counted[1:]:
        whole = whole.unionByName(part)
    return whole


@query("stored_folds", f"WITH {CV} SELECT * FROM cv")
def stored_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold metrics written run by run into a store, one run twice, and read back."""
    store = run_artifacts.RunStore(run_root(spark))
    folds = written_table(fold_metrics(spark, sf_dir))
    # Five order priorities stand for the runs.
    names = sorted(r.run_id for r in runs(spark, sf_dir).collect())
    for name in [*names, *names[:1]]:
        store.write("cv_results", folds.where(F.col("run_id") == name).drop("run_id"), name)
    return store.read(spark, "cv_results", names)


@query("run_csv_scan", f"""
SELECT left(o_orderpriority, 1) AS run, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, CAST(count(DISTINCT year) AS BIGINT) AS folds
FROM {ORDERS} GROUP BY 1""")
def run_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV artifact per run folder, scanned as one table; the run is told by its folder."""
    root = run_root(spark)
    orders = scored_orders(spark, sf_dir).select(
        "o_orderkey", "year", "cents", F.substring("o_orderpriority", 1, 1).alias("run"), F.lit("predictions").alias("kind")
    )
    orders.write.partitionBy("run", "kind").option("header", True).csv(root)
    found = run_artifacts.read_run_csv(spark, root, "part-*.csv", "o_orderkey long, year int, cents long")
    return found.groupBy(F.element_at(F.split("run_folder", "="), -1).alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"), F.countDistinct("year").alias("folds")
    )


@query("fold_feature_scan", f"""
SELECT year AS fold_id, 'customer ' || o_custkey AS feature_name, CAST(NULL AS DOUBLE) AS rank, CAST(count(*) AS DOUBLE) AS score,
       CASE WHEN o_custkey % 3 = 0 THEN 'third' END AS semantic_group FROM {ORDERS} GROUP BY year, o_custkey""")
def fold_feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all folds of a run, written as its combined CSV under the older column name and read back."""
    folder = run_root(spark)
    picked = scored_orders(spark, sf_dir).groupBy(F.col("year").alias("fold_id"), "o_custkey").agg(F.count(F.lit(1)).alias("score"))
    named = picked.select(
        "fold_id", F.concat(F.lit("customer "), "o_custkey").alias("feature"), "score",
        F.when(F.col("o_custkey") % 3 == 0, "third").alias("semantic_group"),
    )
    named.write.option("header", True).csv(f"{folder}/fold_selected_features.csv")
    return run_artifacts.read_fold_features(spark, folder)


@query("fold_windows", f"""
WITH {CV}, w AS (SELECT fold, min(day) AS val_time_start, max(day) AS val_time_end, CAST(count(*) AS BIGINT) AS val_rows FROM src GROUP BY fold)
SELECT run_id, fold, auc, gini, ks, val_time_start, val_time_end, val_rows FROM cv LEFT JOIN w USING (fold)""")
def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold metrics with window bounds that were stored apart from them."""
    windows = shifted_orders(spark, sf_dir).groupBy(F.col("year").alias("fold")).agg(
        F.min("day").alias("val_time_start"), F.max("day").alias("val_time_end"), F.count(F.lit(1)).alias("val_rows"),
        # A column that both sides have is the folds' own.
        F.lit(0.0).alias("auc"),
    )
    return reports.attach_time_info(fold_metrics(spark, sf_dir), windows)


@query("call_summary", """
WITH m AS (SELECT user_id, list_sort(list(DISTINCT event_type || '-' || (user_id // 5))) AS sigs, CAST(count(*) AS BIGINT) AS calls,
                  CAST(sum(event_id % 100) AS BIGINT) AS p, CAST(sum(event_id % 10) AS BIGINT) AS q FROM events GROUP BY user_id),
h AS (SELECT user_id, unnest(sigs) AS sig FROM m),
s AS (SELECT a.user_id, array_to_string(list_sort(list(DISTINCT CAST(b.user_id AS VARCHAR))), ';') AS sharing FROM h a JOIN h b USING (sig) GROUP BY a.user_id)
SELECT CAST(user_id AS VARCHAR) AS run_id, 'lr' AS model, 'ranked' AS selector, 'hybrid' AS experiment_type, 'completed' AS status,
       user_id % 2 = 0 AS llm_shared_ranking_enabled, CAST(user_id % 7 AS INT) AS llm_ranking_budget, calls AS llm_calls_actually_made,
       CASE WHEN user_id % 3 = 0 THEN 0 ELSE calls END AS llm_cache_hits, CAST(NULL AS VARCHAR) AS llm_cache_key,
       array_to_string(sigs, ';') AS llm_metadata_signatures, p AS llm_prompt_tokens, q AS llm_completion_tokens, p + q AS llm_total_tokens,
       sharing AS runs_sharing_metadata_signatures, 'runs/' || user_id AS output_folder
FROM m JOIN s USING (user_id)""")
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for runs, events for ranking calls; a third of the manifests say nothing of cache hits."""
    user, event = F.col("user_id"), F.col("event_id")
    mark = F.concat("event_type", F.lit("-"), F.expr("user_id div 5").cast("string"))
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set(mark)).alias("llm_metadata_signatures"), F.count(F.lit(1)).alias("llm_calls_actually_made"),
        F.sum(event % 100).alias("llm_prompt_tokens"), F.sum(event % 10).alias("llm_completion_tokens"),
    )
    manifests = counted.select(
        user.cast("string").alias("run_id"), F.lit("lr").alias("model"), F.lit("ranked").alias("selector"), F.lit("hybrid").alias("experiment_type"),
        F.lit("completed").alias("status"), (user % 2 == 0).alias("llm_shared_ranking_enabled"), (user % 7).cast("int").alias("llm_ranking_budget"),
        "llm_calls_actually_made", F.when(user % 3 != 0, F.col("llm_calls_actually_made")).alias("llm_cache_hits"),
        F.lit(None).cast("string").alias("llm_cache_key"), "llm_metadata_signatures", "llm_prompt_tokens", "llm_completion_tokens",
        (F.col("llm_prompt_tokens") + F.col("llm_completion_tokens")).alias("llm_total_tokens"), F.concat(F.lit("runs/"), user).alias("output_folder"),
    )
    return reports.call_summary(manifests)
