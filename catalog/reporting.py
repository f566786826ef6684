"""Cross-run tables built from fold metrics of the orders, completeness and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, roc_sql, rounded, table
from catalog.scores import SHIFTED, shifted_orders
from driftwell.operators import reports, scoring
from driftwell.sources import runs as run_artifacts
from driftwell.sources.tables import check_contract

# Order priorities stand for runs, order years for folds.
RUNS = """runs AS (SELECT run_id, CASE WHEN run_id < '4' THEN 'lr' ELSE 'rf' END AS model,
       CASE WHEN run_id IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'mrmr' ELSE 'boruta' END AS selector,
       CASE WHEN run_id IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'statistical' ELSE 'hybrid' END AS experiment_type
       FROM (SELECT DISTINCT o_orderpriority AS run_id FROM orders))"""
CV = f"""src AS (SELECT *, o_orderpriority AS run_id, year AS fold FROM {SHIFTED}), {roc_sql('src', 'run_id, fold', 'y', 'p')},
cv AS (SELECT run_id, fold, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(ks, 9) AS ks FROM best)"""
DIGITS = {"auc": 9, "gini": 9, "ks": 9}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("run_id")
    plain = run.isin("1-URGENT", "4-NOT SPECIFIED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id")).distinct().select(
        "run_id",
        F.when(run < "4", "lr").otherwise("rf").alias("model"),
        F.when(plain, "mrmr").otherwise("boruta").alias("selector"),
        F.when(plain, "statistical").otherwise("hybrid").alias("experiment_type"),
    )


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shifted_orders(spark, sf_dir).withColumns({"run_id": F.col("o_orderpriority"), "fold": F.col("year")})
    return rounded(scoring.roc_metrics(orders, "y", "p", ["run_id", "fold"]), DIGITS).select("run_id", "fold", "auc", "gini", "ks")


@query("fold_metrics", f"WITH {CV} SELECT * FROM cv")
def fold_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_metrics(spark, sf_dir)


SUMMARY_COLUMNS = ", ".join(
    f"round(avg({m}), 9) AS cv_{m}_mean, round(stddev_samp({m}), 9) AS cv_{m}_std" for m in ("auc", "gini", "ks")
)
SUMMARY_DIGITS = {f"cv_{m}_{s}": 9 for m in ("auc", "gini", "ks") for s in ("mean", "std")}


@query("fold_summary", f"WITH {CV} SELECT run_id, CAST(count(*) AS BIGINT) AS cv_fold_count, {SUMMARY_COLUMNS} FROM cv GROUP BY run_id")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.fold_summary(fold_metrics(spark, sf_dir)), SUMMARY_DIGITS)


@query("summary_rows", f"""
WITH {CV}, one AS (SELECT CAST(fold AS VARCHAR) AS fold, auc, gini, ks FROM cv WHERE run_id = '5-LOW')
SELECT * FROM one UNION ALL SELECT 'mean', round(avg(auc), 9), round(avg(gini), 9), round(avg(ks), 9) FROM one
UNION ALL SELECT 'std', round(stddev_samp(auc), 9), round(stddev_samp(gini), 9), round(stddev_samp(ks), 9) FROM one""")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = fold_metrics(spark, sf_dir).where("run_id = '5-LOW'").drop("run_id")
    return rounded(scoring.with_summary_rows(folds, ["auc", "gini", "ks"]), DIGITS)


@query("numeric_folds", f"""
WITH {CV}, one AS (SELECT fold, auc FROM cv WHERE run_id = '5-LOW') SELECT CAST(fold AS INT) AS fold, auc FROM one""")
def numeric_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows are left out again."""
    folds = fold_metrics(spark, sf_dir).where("run_id = '5-LOW'").select("fold", "auc")
    return scoring.fold_rows(scoring.with_summary_rows(folds, ["auc"]))


@query("ci_summary", f"""
WITH {CV}, long AS (SELECT run_id, 'gini' AS metric, gini AS x FROM cv UNION ALL SELECT run_id, 'ks', ks FROM cv),
s AS (SELECT run_id, metric, avg(x) AS v, 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)) AS m FROM long WHERE x IS NOT NULL GROUP BY run_id, metric)
SELECT run_id, metric, round(v, 9) AS value, round(v - m, 9) AS ci95_lower, round(v + m, 9) AS ci95_upper FROM s""")
def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.interval_summary(fold_metrics(spark, sf_dir), keys=["run_id"])
    return rounded(found, {"value": 9, "ci95_lower": 9, "ci95_upper": 9})


@query("paired_fold_delta", f"""
WITH {CV}, {RUNS}, base AS (SELECT model, min(run_id) AS b FROM runs WHERE experiment_type = 'statistical' AND selector = 'mrmr' GROUP BY model),
d AS (SELECT model, b AS baseline_run_id, r.run_id AS candidate_run_id, r.selector AS candidate_selector, r.experiment_type AS candidate_experiment_type,
             c.auc - x.auc AS auc, c.gini - x.gini AS gini
      FROM runs r JOIN base USING (model) JOIN cv c ON c.run_id = r.run_id JOIN cv x ON x.run_id = b AND x.fold = c.fold WHERE r.run_id <> b),
l AS (SELECT * EXCLUDE (auc, gini), 'auc' AS metric, auc AS delta FROM d UNION ALL SELECT * EXCLUDE (auc, gini), 'gini', gini FROM d),
s AS (SELECT * EXCLUDE (delta), count(*) AS n, avg(delta) AS v, 1.96 * coalesce(stddev_samp(delta), 0) / sqrt(count(*)) AS m FROM l GROUP BY ALL)
SELECT * EXCLUDE (n, v, m), CAST(n AS BIGINT) AS fold_count, round(v, 8) AS mean_delta_candidate_minus_baseline, round(v - m, 8) AS ci95_lower,
       round(v + m, 8) AS ci95_upper FROM s""")
def paired_fold_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.paired_fold_deltas(fold_metrics(spark, sf_dir), runs(spark, sf_dir))
    return rounded(found, {"mean_delta_candidate_minus_baseline": 8, "ci95_lower": 8, "ci95_upper": 8})


@query("pivot_report", f"""
WITH {CV}, {RUNS} SELECT model, round(avg(gini) FILTER (selector = 'boruta'), 9) AS boruta, round(avg(gini) FILTER (selector = 'mrmr'), 9) AS mrmr
FROM cv JOIN runs USING (run_id) GROUP BY model""")
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fold_metrics(spark, sf_dir).join(runs(spark, sf_dir), "run_id")
    return rounded(reports.pivot_mean(joined, "model", "selector", "gini", ["boruta", "mrmr"]), {"boruta": 9, "mrmr": 9})


OOT = f"""late AS (SELECT *, o_orderpriority AS run_id FROM {SHIFTED} WHERE day >= -600), {roc_sql('late', 'run_id', 'y', 'p').replace('cnt', 'ocnt').replace('roc', 'oroc').replace('gaps', 'ogaps').replace('best', 'obest')},
oot AS (SELECT run_id, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(ks, 9) AS ks FROM obest)"""


def oot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = shifted_orders(spark, sf_dir).where("day >= -600").withColumn("run_id", F.col("o_orderpriority"))
    return rounded(scoring.roc_metrics(late, "y", "p", ["run_id"]), DIGITS).select("run_id", "auc", "gini", "ks")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports.experiment_summary(
        runs(spark, sf_dir).select("run_id", F.col("model").alias("model_name"), F.col("selector").alias("selector_name")),
        fold_metrics(spark, sf_dir), oot_metrics(spark, sf_dir),
    )
    return rounded(made, SUMMARY_DIGITS)


@query("experiment_summary", f"""
WITH {CV}, {OOT}, {RUNS}, f AS (SELECT run_id, CAST(count(*) AS BIGINT) AS cv_fold_count, {SUMMARY_COLUMNS} FROM cv GROUP BY run_id)
SELECT run_id, model AS model_name, selector AS selector_name, f.* EXCLUDE (run_id), oot.auc AS oot_auc, oot.gini AS oot_gini, oot.ks AS oot_ks
FROM runs LEFT JOIN f USING (run_id) LEFT JOIN oot USING (run_id)""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


RUNTIME = """o_sec AS (SELECT o_orderpriority AS run_id, CAST(year(o_orderdate) AS INT) AS fold, CAST(count(*) AS DOUBLE) AS fold_time_sec FROM orders GROUP BY ALL),
runtime AS (SELECT run_id, CASE WHEN run_id < '3' THEN CAST(5000 AS DOUBLE) ELSE sum(fold_time_sec) END AS runtime_seconds FROM o_sec GROUP BY run_id)"""


def run_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per fold stand for seconds; two runs have a recorded total."""
    folds = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("run_id"), F.year("o_orderdate").alias("fold")
    ).agg(F.count(F.lit(1)).cast("double").alias("fold_time_sec"))
    known = runs(spark, sf_dir).where("run_id < '3'").select("run_id", F.lit(5000.0).alias("total_runtime_seconds"))
    return reports.runtime_seconds(runs(spark, sf_dir), known, folds)


@query("runtime_fallback", f"WITH {RUNTIME} SELECT * FROM runtime")
def runtime_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_seconds(spark, sf_dir)


def run_table_sql() -> str:
    known = {
        "run_id": "run_id", "model": "model", "selector": "selector", "experiment_type": "experiment_type", "oot_auc": "oot.auc",
        "oot_gini": "oot.gini", "oot_ks": "oot.ks", "runtime_seconds": "runtime_seconds", "feature_budget": "CAST(20 AS INT)",
        "config_hash": "substr(sha256(run_id), 1, 12)",
    }
    cells = [
        f"{known.get(c, 'CAST(NULL AS VARCHAR)' if c in reports.TEXT_COLUMNS else 'CAST(NULL AS DOUBLE)')} AS {c}"
        for c in reports.FINAL_COLUMNS
    ]
    return f"WITH {CV}, {OOT}, {RUNS}, {RUNTIME} SELECT {', '.join(cells)} FROM runs JOIN oot USING (run_id) JOIN runtime USING (run_id) WHERE run_id <> '3-MEDIUM'"


@query("run_table", run_table_sql())
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs only, in the fixed column order."""
    manifests = runs(spark, sf_dir).withColumns({
        "status": F.when(F.col("run_id") == "3-MEDIUM", "failed").otherwise("completed"),
        "feature_budget": F.lit(20),
        "config_hash": F.substring(F.sha2("run_id", 256), 1, 12),
    })
    return reports.run_table(manifests, summary(spark, sf_dir), run_seconds(spark, sf_dir))


@query("failed_runs", """
SELECT DISTINCT o_orderpriority AS run_id, 'lr' AS model, 'mrmr' AS selector, 'statistical' AS experiment_type, 'failed' AS status, 'lost' AS error,
       '2001-08-01' AS failed_at, 'runs/' || o_orderpriority AS output_folder FROM orders WHERE o_orderpriority LIKE '%M%'""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runs(spark, sf_dir).withColumns({
        "model": F.lit("lr"), "selector": F.lit("mrmr"), "experiment_type": F.lit("statistical"),
        "status": F.when(F.col("run_id").contains("M"), "failed").otherwise("completed"), "error": F.lit("lost"),
        "failed_at": F.lit("2001-08-01"), "output_folder": F.concat(F.lit("runs/"), F.col("run_id")),
    })
    listed = made.where("run_id < '5'").select("output_folder")
    return reports.failed_runs(run_artifacts.allowed_runs(made, listed))


PAIR_METRICS = ("cv_auc_mean", "cv_gini_mean", "cv_ks_mean", "oot_auc", "oot_gini", "oot_ks")


def pair_sql() -> str:
    cells = []
    for m in reports.COMPARED_METRICS:
        for side in ("left", "right"):
            cells.append(f"{side[0]}.{m} AS {side}_{m}" if m in PAIR_METRICS else f"CAST(NULL AS DOUBLE) AS {side}_{m}")
        cells.append(
            f"round(r.{m} - l.{m}, 9) AS delta_{m}_right_minus_left" if m in PAIR_METRICS
            else f"CAST(NULL AS DOUBLE) AS delta_{m}_right_minus_left"
        )
    return f"""
WITH {CV}, {OOT}, f AS (SELECT run_id, {SUMMARY_COLUMNS} FROM cv GROUP BY run_id),
s AS (SELECT f.*, oot.auc AS oot_auc, oot.gini AS oot_gini, oot.ks AS oot_ks FROM f JOIN oot USING (run_id)),
picks AS (SELECT run_id, fold, o_custkey FROM (SELECT DISTINCT run_id, fold, o_custkey % 40 AS o_custkey FROM src)),
a AS (SELECT fold, o_custkey FROM picks WHERE run_id = '1-URGENT'), b AS (SELECT fold, o_custkey FROM picks WHERE run_id = '5-LOW'),
o AS (SELECT fold, count(CASE WHEN a.o_custkey = b.o_custkey THEN 1 END) / CAST(count(*) AS DOUBLE) AS j FROM a FULL JOIN b USING (fold, o_custkey) GROUP BY fold)
SELECT {', '.join(cells)}, (SELECT CAST(count(*) AS BIGINT) FROM o) AS feature_overlap_fold_count, (SELECT round(avg(j), 9) FROM o) AS feature_overlap_fold_jaccard_mean,
       (SELECT round(stddev_samp(j), 9) FROM o) AS feature_overlap_fold_jaccard_std, CAST(NULL AS DOUBLE) AS feature_overlap_final_jaccard,
       CAST(NULL AS BIGINT) AS feature_overlap_final_intersection_count,
       CASE WHEN round(r.cv_auc_mean - l.cv_auc_mean, 9) > 0.0001 AND round(r.oot_auc - l.oot_auc, 9) > 0.0001 THEN 'yes'
            WHEN round(r.cv_auc_mean - l.cv_auc_mean, 9) < -0.0001 AND round(r.oot_auc - l.oot_auc, 9) < -0.0001 THEN 'no' ELSE 'mixed' END AS helped
FROM s l, s r WHERE l.run_id = '1-URGENT' AND r.run_id = '5-LOW'"""


@query("compare_pair", pair_sql())
def compare_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side; customers modulo 40 stand for the features they picked."""
    log = shifted_orders(spark, sf_dir).select(
        F.col("o_orderpriority").alias("run_id"), F.col("year").alias("fold_id"),
        (F.col("o_custkey") % 40).cast("string").alias("feature_name"),
    ).distinct()
    row, _ = reports.compare_pair(summary(spark, sf_dir), log, "1-URGENT", "5-LOW")
    digits = {c: 9 for c in row.columns if c.startswith("delta_") or "jaccard" in c}
    return reports.help_summary(rounded(row, digits))


@query("temporal_table", f"""
WITH {CV}, w AS (SELECT run_id, fold, min(day) AS val_time_start, max(day) AS val_time_end FROM src GROUP BY run_id, fold)
SELECT run_id AS label, CAST(fold AS INT) AS fold, 'M-' || CAST(round_even(abs(val_time_start) / 30.0, 0) AS BIGINT) || ' to ' || 'M-' ||
       CAST(round_even(abs(val_time_end) / 30.0, 0) AS BIGINT) AS month_label, val_time_start, val_time_end, auc, gini, ks FROM cv JOIN w USING (run_id, fold)""")
def temporal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shifted_orders(spark, sf_dir).select(F.col("o_orderpriority").alias("run_id"), F.col("year").alias("fold"), "day")
    windows = orders.groupBy("run_id", "fold").agg(F.min("day").alias("val_time_start"), F.max("day").alias("val_time_end"))
    folds = fold_metrics(spark, sf_dir).join(windows, ["run_id", "fold"]).withColumnRenamed("run_id", "label")
    return reports.temporal_table(folds)


@query("oot_table", f"WITH {OOT} SELECT run_id AS label, auc AS oot_auc, gini AS oot_gini, ks AS oot_ks FROM oot")
def oot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oot_table(oot_metrics(spark, sf_dir).withColumnRenamed("run_id", "label"))


@query("efficiency", f"""
WITH {OOT}, n AS (SELECT o_orderpriority AS run_id, count(DISTINCT o_custkey % 90) AS k FROM orders GROUP BY 1)
SELECT run_id, 1 - k / CAST(120 AS DOUBLE) AS feature_reduction_ratio, round(gini / k, 12) AS gini_per_feature, round(auc / k, 12) AS auc_per_feature,
       round(ks / k, 12) AS ks_per_feature FROM oot JOIN n USING (run_id)""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.count_distinct(F.col("o_custkey") % 90).alias("selected_feature_count")
    ).withColumn("total_candidate_feature_count", F.lit(120))
    joined = oot_metrics(spark, sf_dir).join(counted, "run_id").withColumns(reports.efficiency_columns())
    names = ["gini_per_feature", "auc_per_feature", "ks_per_feature"]
    return rounded(joined, dict.fromkeys(names, 12)).select("run_id", "feature_reduction_ratio", *names)


# ---- Calls, sharing, completeness, contract ----

@query("ranking_call_stats", """
WITH c AS (SELECT user_id % 11 AS run_id, event_type AS scope, event_id % 5 AS fold_id, sha256(CAST(user_id % 3 AS VARCHAR)) AS metadata_signature,
                  max(CAST(event_id % 4 = 0 AND event_id % 5 = 0 AS INT)) AS hit, max(event_id % 100) AS p, max(event_id % 10) AS q, max(event_id % 1000) AS t
           FROM events GROUP BY ALL)
SELECT run_id, array_to_string(list_sort(list(DISTINCT metadata_signature)), ';') AS llm_metadata_signatures, CAST(count(*) FILTER (hit = 0) AS BIGINT) AS llm_calls_actually_made,
       CAST(count(*) FILTER (hit = 1) AS BIGINT) AS llm_cache_hits, CAST(coalesce(sum(p) FILTER (hit = 0), 0) AS BIGINT) AS llm_prompt_tokens,
       CAST(coalesce(sum(q) FILTER (hit = 0), 0) AS BIGINT) AS llm_completion_tokens, CAST(coalesce(sum(t) FILTER (hit = 0), 0) AS BIGINT) AS llm_total_tokens
FROM c GROUP BY run_id""")
def ranking_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 11).alias("run_id"), F.col("event_type").alias("scope"), (event % 5).alias("fold_id"),
        F.sha2((F.col("user_id") % 3).cast("string"), 256).alias("metadata_signature"),
        ((event % 4 == 0) & (event % 5 == 0)).cast("string").alias("cache_hit"), (event % 100).alias("prompt_tokens"),
        (event % 10).alias("completion_tokens"), (event % 1000).alias("total_tokens"),
    )
    return reports.ranking_call_stats(log).withColumn("llm_metadata_signatures", F.array_join("llm_metadata_signatures", ";"))


# Users of one block of five share a signature per event type, whatever the number of users.
SIGNED = """s AS (SELECT user_id AS run_id, string_agg(DISTINCT event_type || '-' || (user_id // 5), ';') AS signatures FROM events
                  GROUP BY user_id)"""


@query("signature_sharing", f"""
WITH {SIGNED}, h AS (SELECT DISTINCT run_id, unnest(string_split(signatures, ';')) AS sig FROM s),
p AS (SELECT a.run_id, list_sort(list(DISTINCT b.run_id)) AS l FROM h a JOIN h b USING (sig) GROUP BY a.run_id)
SELECT run_id, array_to_string(l, ';') AS runs_sharing_metadata_signatures FROM p""")
def signature_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    mark = F.concat("event_type", F.lit("-"), F.expr("user_id div 5").cast("string"))
    signed = events.groupBy(F.col("user_id").alias("run_id")).agg(F.array_join(F.collect_set(mark), ";").alias("signatures"))
    return reports.runs_sharing(signed)


@query("signature_classes", """
WITH s AS (SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN ['hot'] ELSE list_sort(list(DISTINCT event_type || '-' || (user_id // 5))) END AS sigs FROM events GROUP BY user_id),
m AS (SELECT run_id, sigs, sha256(array_to_string(sigs, chr(10))) AS class_id FROM s),
c AS (SELECT class_id, any_value(sigs) AS sigs, array_to_string(list_sort(list(run_id)), ';') AS runs, count(*) AS n_runs FROM m GROUP BY class_id),
u AS (SELECT class_id, unnest(sigs) AS sig FROM c)
SELECT c.class_id, runs, CAST(n_runs AS INT) AS n_runs, CAST(count(DISTINCT b.class_id) AS INT) AS n_sharing
FROM c JOIN u a ON a.class_id = c.class_id JOIN u b ON b.sig = a.sig GROUP BY c.class_id, runs, n_runs""")
def signature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their set of signatures, a third of them with the same one: every run is listed once."""
    mark = F.concat("event_type", F.lit("-"), F.expr("user_id div 5").cast("string"))
    signed = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.array_join(F.collect_set(mark), ";")).alias("signatures")
    )
    _, classes = reports.sharing_classes(signed)
    return classes.select("class_id", F.array_join("runs", ";").alias("runs"), F.size("runs").alias("n_runs"), F.size("sharing").alias("n_sharing"))


ARTIFACTS = run_artifacts.REQUIRED_ARTIFACTS + run_artifacts.RANKED_ARTIFACTS + run_artifacts.HYBRID_ARTIFACTS
KINDS = ["statistical", "llm", "hybrid"]


def quoted_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PRESENT = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, {quoted_list(KINDS)}[user_id % 3 + 1] AS experiment_type,
       {quoted_list(ARTIFACTS)}[event_id % {len(ARTIFACTS)} + 1] AS artifact FROM events),
r AS (SELECT DISTINCT run_id, experiment_type FROM e),
w AS (SELECT run_id, unnest(list_concat({quoted_list(run_artifacts.REQUIRED_ARTIFACTS)},
        CASE WHEN experiment_type <> 'statistical' THEN {quoted_list(run_artifacts.RANKED_ARTIFACTS)} ELSE [] END,
        CASE WHEN experiment_type = 'hybrid' THEN {quoted_list(run_artifacts.HYBRID_ARTIFACTS)} ELSE [] END)) AS artifact FROM r),
m AS (SELECT w.* FROM w ANTI JOIN e USING (run_id, artifact))"""


def presence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), pick(KINDS, F.col("user_id") % 3).alias("experiment_type"),
        pick(ARTIFACTS, F.col("event_id") % len(ARTIFACTS)).alias("artifact"),
    )
    return events.select("run_id", "experiment_type").distinct(), events.select("run_id", "artifact")


@query("missing_artifacts", f"WITH {PRESENT} SELECT * FROM m")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_artifacts.missing_pairs(*presence(spark, sf_dir))


@query("completed_runs", f"WITH {PRESENT} SELECT * FROM r WHERE run_id NOT IN (SELECT run_id FROM m)")
def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_artifacts.completed_runs(*presence(spark, sf_dir))


@query("run_identity", """
SELECT p_partkey, 'lr_hybrid_' || regexp_replace(p_name, '[ /]', '_', 'g') || '_' || substr(sha256(p_brand), 1, 12) AS run_id FROM part""")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", run_artifacts.run_identity(
        F.lit("lr"), F.lit("hybrid"), F.col("p_name"), F.sha2("p_brand", 256)
    ).alias("run_id"))


@query("contract_check", """
WITH k AS (SELECT 'orders' AS t, o_custkey AS k FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer),
p AS (SELECT t, k, count(*) AS rows FROM k GROUP BY t, k),
a AS (SELECT t, sum(rows) AS rows, sum(rows) FILTER (k IS NULL) AS nulls, sum(rows - 1) FILTER (k IS NOT NULL) AS surplus FROM p GROUP BY t)
SELECT 'customer' AS "table", 'present' AS "check", true AS ok, '' AS detail UNION ALL SELECT 'customer', 'columns', false, 'c_missing'
UNION ALL SELECT 'visits', 'present', false, 'absent'
UNION ALL SELECT t, 'rows', rows > 0, CAST(CAST(rows AS BIGINT) AS VARCHAR) FROM a
UNION ALL SELECT t, 'key_nulls', coalesce(nulls, 0) = 0, CAST(CAST(coalesce(nulls, 0) AS BIGINT) AS VARCHAR) FROM a
UNION ALL SELECT t, 'key_duplicates', coalesce(surplus, 0) = 0, CAST(CAST(coalesce(surplus, 0) AS BIGINT) AS VARCHAR) FROM a
UNION ALL SELECT 'orders', 'time_column', true, printf('missing share %.4f', (SELECT count(*) FILTER (o_orderdate IS NULL) / CAST(count(*) AS DOUBLE) FROM orders))""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("customer", "orders")}
    return check_contract(
        tables, {"customer": ("c_custkey", "c_missing"), "visits": ("x",)}, {"orders": "o_custkey", "customer": "c_custkey"},
        {"orders": "o_orderdate"},
    )
