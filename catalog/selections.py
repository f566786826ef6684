"""Selection stability, rankings and selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from catalog.histories import customers, histories
from catalog.profiles import PREFIXES, STATS, group_sql
from driftwell.functions import labels
from driftwell.operators import models, scoring, selection, stability, wrappers
from driftwell.operators.timeline import Windows
from driftwell.plans.folds import ModelSpec, run_folds
from driftwell.plans.prepare import prepare

TOTAL = 300
PICKS = 12

# Features named from the parts; each (return flag, ship year) picks the ones with most quantity.
NAMED = f"""(SELECT p_partkey, concat_ws('_', [{', '.join(repr(p) for p in PREFIXES)}][p_size % 7 + 1], p_type,
        [{', '.join(repr(s) for s in STATS)}][p_size % 6 + 1]) AS feature_name FROM part)"""
VOLUME = f"""volume AS (SELECT l_returnflag AS run_id, CAST(year(l_shipdate) AS INT) AS fold_id, feature_name, CAST(sum(l_quantity) AS BIGINT) AS score
        FROM lineitem JOIN {NAMED} ON l_partkey = p_partkey GROUP BY ALL)"""
LOG = f"""{VOLUME},
log AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, fold_id ORDER BY score DESC, feature_name) AS INT) AS rank FROM volume) WHERE rank <= {PICKS})"""


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("p_size") % n + 1)
    name = F.concat_ws("_", pick(PREFIXES, 7), F.col("p_type"), pick(STATS, 6))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("feature_name"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("run_id"), F.year("l_shipdate").alias("fold_id"), "l_partkey"
    ).agg(F.sum("l_quantity").alias("score"))
    return lines.join(named_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "run_id", "fold_id", "feature_name"
    ).agg(F.sum("score").cast("long").alias("score"))


def selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, fold_id, feature_name, rank, score): at most a dozen features per run and year."""
    order = Window.partitionBy("run_id", "fold_id").orderBy(F.col("score").desc(), "feature_name")
    return volume(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PICKS)


RUN = ["run_id"]


@query("selection_frequency", f"""
WITH {LOG}
SELECT run_id, feature_name, CAST(count(DISTINCT fold_id) AS BIGINT) AS selection_count, CAST(max(total) AS BIGINT) AS total_folds,
       count(DISTINCT fold_id) / CAST(max(total) AS DOUBLE) AS selection_frequency, round(avg(rank), 9) AS mean_rank_if_available,
       round(avg(score), 6) AS mean_score_if_available
FROM log JOIN (SELECT run_id, count(DISTINCT fold_id) AS total FROM log GROUP BY run_id) USING (run_id) GROUP BY run_id, feature_name""")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stability.selection_frequency(selection_log(spark, sf_dir), RUN)
    return rounded(found, {"mean_rank_if_available": 9, "mean_score_if_available": 6})


GROUPED = f"""grouped AS (SELECT run_id, fold_id, feature_name, {group_sql('upper(feature_name)', 'upper(feature_name)', "''")} AS semantic_group FROM log)"""


@query("group_frequency", f"""
WITH {LOG}, {GROUPED}
SELECT run_id, semantic_group, CAST(count(DISTINCT fold_id) AS BIGINT) AS selection_count, CAST(max(total) AS BIGINT) AS total_folds,
       count(DISTINCT fold_id) / CAST(max(total) AS DOUBLE) AS selection_frequency
FROM grouped JOIN (SELECT run_id, count(DISTINCT fold_id) AS total FROM log GROUP BY run_id) USING (run_id) GROUP BY run_id, semantic_group""")
def group_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.group_frequency(selection_log(spark, sf_dir), RUN)


NOGUEIRA = f"""folds AS (SELECT run_id, CAST(count(DISTINCT fold_id) AS DOUBLE) AS m, count(*) / CAST(count(DISTINCT fold_id) AS DOUBLE) AS k FROM log GROUP BY run_id),
freq AS (SELECT run_id, feature_name, count(*) / max(m) AS f FROM log JOIN folds USING (run_id) GROUP BY run_id, feature_name),
nog AS (SELECT run_id, 1 - (max(m) / (max(m) - 1) * sum(f * (1 - f)) / {TOTAL}) / ((max(k) / {TOTAL}) * (1 - max(k) / {TOTAL})) AS nogueira
        FROM freq JOIN folds USING (run_id) GROUP BY run_id)"""


@query("nogueira", f"WITH {LOG}, {NOGUEIRA} SELECT run_id, round(nogueira, 9) AS nogueira_stability FROM nog")
def nogueira(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.nogueira(selection_log(spark, sf_dir), TOTAL, RUN), {"nogueira_stability": 9})


def pairs_sql(source: str, item: str, prefix: str) -> str:
    """CTE of fold pairs per run with set sizes and shared items."""
    return f"""
{prefix}s AS (SELECT run_id, fold_id, list(DISTINCT {item}) AS items FROM {source} GROUP BY run_id, fold_id),
{prefix} AS (SELECT a.run_id, len(a.items) AS ka, len(b.items) AS kb, len(list_intersect(a.items, b.items)) AS r
             FROM {prefix}s a JOIN {prefix}s b ON a.run_id = b.run_id AND a.fold_id < b.fold_id)"""


@query("pairwise_jaccard", f"""
WITH {LOG}, {GROUPED}, {pairs_sql('log', 'feature_name', 'fp')}, {pairs_sql('grouped', 'semantic_group', 'gp')}
SELECT run_id, round(avg(fp.r / CAST(fp.ka + fp.kb - fp.r AS DOUBLE)), 9) AS feature_jaccard, max(g) AS group_jaccard
FROM fp JOIN (SELECT run_id, round(avg(r / CAST(ka + kb - r AS DOUBLE)), 9) AS g FROM gp GROUP BY run_id) USING (run_id) GROUP BY run_id""")
def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stability.with_semantic_group(selection_log(spark, sf_dir))
    one = stability.set_stability(log, TOTAL, RUN).select("run_id", F.col("mean_pairwise_jaccard").alias("feature_jaccard"))
    two = stability.set_stability(log, TOTAL, RUN, item="semantic_group").select("run_id", F.col("mean_pairwise_jaccard").alias("group_jaccard"))
    return rounded(one.join(two, "run_id"), {"feature_jaccard": 9, "group_jaccard": 9})


@query("kuncheva", f"""
WITH {LOG}, {pairs_sql('log', 'feature_name', 'fp')}
SELECT run_id, round(avg((r * {TOTAL} - ka * ka) / CAST(ka * ({TOTAL} - ka) AS DOUBLE)) FILTER (ka = kb AND ka > 0), 9) AS kuncheva_stability FROM fp GROUP BY run_id""")
def kuncheva(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stability.set_stability(selection_log(spark, sf_dir), TOTAL, RUN).select("run_id", "kuncheva_stability")
    return rounded(found, {"kuncheva_stability": 9})


RANK_STABILITY = f"""
sizes AS (SELECT run_id, fold_id, max(rank) + 1 AS missing FROM log GROUP BY run_id, fold_id),
fp AS (SELECT a.run_id, a.fold_id AS f1, b.fold_id AS f2, a.missing AS m1, b.missing AS m2 FROM sizes a JOIN sizes b ON a.run_id = b.run_id AND a.fold_id < b.fold_id),
feats AS (SELECT DISTINCT fp.run_id, f1, f2, m1, m2, feature_name FROM fp JOIN log ON log.run_id = fp.run_id AND (fold_id = f1 OR fold_id = f2)),
xy AS (SELECT feats.run_id, f1, f2, feats.feature_name, coalesce(l.rank, m1) AS x, coalesce(r.rank, m2) AS y FROM feats
       LEFT JOIN log l ON l.run_id = feats.run_id AND l.fold_id = f1 AND l.feature_name = feats.feature_name
       LEFT JOIN log r ON r.run_id = feats.run_id AND r.fold_id = f2 AND r.feature_name = feats.feature_name),
sp AS (SELECT run_id, f1, f2, corr(x, y) AS v FROM xy GROUP BY run_id, f1, f2),
kd AS (SELECT a.run_id, a.f1, a.f2, sum(sign((a.x - b.x) * (a.y - b.y))) / CAST(sum(abs(sign((a.x - b.x) * (a.y - b.y)))) AS DOUBLE) AS v
       FROM xy a JOIN xy b ON a.run_id = b.run_id AND a.f1 = b.f1 AND a.f2 = b.f2 AND a.feature_name < b.feature_name GROUP BY a.run_id, a.f1, a.f2)"""


@query("rank_stability", f"""
WITH {LOG}, {RANK_STABILITY}
SELECT run_id, metric, round(avg(v), 9) AS mean_value, round(stddev_samp(v), 9) AS std_value, CAST(count(v) AS INT) AS n_pairs
FROM (SELECT run_id, 'spearman' AS metric, v FROM sp UNION ALL SELECT run_id, 'kendall_tau', v FROM kd) GROUP BY run_id, metric""")
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.rank_stability(selection_log(spark, sf_dir), RUN), {"mean_value": 9, "std_value": 9})


@query("jaccard_previous", f"""
WITH {LOG}, s AS (SELECT run_id, fold_id, list(DISTINCT feature_name) AS items FROM log GROUP BY run_id, fold_id),
l AS (SELECT *, lag(items) OVER (PARTITION BY run_id ORDER BY fold_id) AS before FROM s)
SELECT run_id, fold_id, CAST(len(items) AS INT) AS selected_features,
       CASE WHEN before IS NOT NULL THEN len(list_intersect(items, before)) / CAST(len(list_distinct(list_concat(items, before))) AS DOUBLE) END AS jaccard_similarity FROM l""")
def jaccard_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stability.jaccard_with_previous(selection_log(spark, sf_dir), RUN)
    return found


@query("fold_overlap", f"""
WITH {LOG}, a AS (SELECT fold_id, feature_name FROM log WHERE run_id = 'A'), r AS (SELECT fold_id, feature_name FROM log WHERE run_id = 'R'),
both_folds AS (SELECT DISTINCT fold_id FROM a INTERSECT SELECT DISTINCT fold_id FROM r)
SELECT fold_id, CAST(count(a.feature_name) AS BIGINT) AS left_feature_count, CAST(count(r.feature_name) AS BIGINT) AS right_feature_count,
       CAST(count(CASE WHEN a.feature_name = r.feature_name THEN 1 END) AS BIGINT) AS intersection_count, CAST(count(*) AS BIGINT) AS union_count,
       count(CASE WHEN a.feature_name = r.feature_name THEN 1 END) / CAST(count(*) AS DOUBLE) AS jaccard_similarity
FROM a FULL JOIN r USING (fold_id, feature_name) WHERE fold_id IN (SELECT fold_id FROM both_folds) GROUP BY fold_id""")
def fold_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = selection_log(spark, sf_dir)
    return stability.fold_overlap(log.where("run_id = 'A'"), log.where("run_id = 'R'"))


@query("stability_bundle", f"""
WITH {LOG.replace('FROM lineitem JOIN', "FROM (SELECT * FROM lineitem WHERE l_returnflag = 'N') JOIN")}, {GROUPED}, {NOGUEIRA},
{pairs_sql('log', 'feature_name', 'jp')}, {pairs_sql('grouped', 'semantic_group', 'gp')}, {RANK_STABILITY},
ff AS (SELECT feature_name, count(DISTINCT fold_id) / (SELECT max(m) FROM folds) AS f FROM log GROUP BY feature_name),
gf AS (SELECT semantic_group, count(DISTINCT fold_id) / (SELECT max(m) FROM folds) AS f FROM grouped GROUP BY semantic_group),
c AS (SELECT (SELECT CAST(count(*) FILTER (f >= 0.8) AS BIGINT) FROM ff) AS sf, (SELECT CAST(count(*) FILTER (f >= 0.8) AS BIGINT) FROM gf) AS sg,
             (SELECT floor(avg(len(items))) FROM jps) AS kf, (SELECT floor(avg(len(items))) FROM gps) AS kg)
SELECT (SELECT round(nogueira, 9) FROM nog) AS nogueira_stability,
       (SELECT round(avg((r * {TOTAL} - ka * ka) / CAST(ka * ({TOTAL} - ka) AS DOUBLE)) FILTER (ka = kb), 9) FROM jp) AS kuncheva_stability,
       (SELECT round(avg(r / CAST(ka + kb - r AS DOUBLE)), 9) FROM jp) AS mean_pairwise_jaccard,
       (SELECT round(avg(r / CAST(ka + kb - r AS DOUBLE)), 9) FROM gp) AS semantic_group_jaccard,
       sf AS stable_feature_count_80, sf / kf AS stable_feature_ratio_80, sg AS stable_semantic_group_count_80, sg / kg AS semantic_group_stable_ratio_80,
       {TOTAL} AS total_candidate_feature_count,
       (SELECT round(avg(v), 9) FROM sp) AS spearman_rank_stability_mean, (SELECT round(stddev_samp(v), 9) FROM sp) AS spearman_rank_stability_std,
       (SELECT round(avg(v), 9) FROM kd) AS kendall_rank_stability_mean, (SELECT round(stddev_samp(v), 9) FROM kd) AS kendall_rank_stability_std,
       CAST(NULL AS DOUBLE) AS rbo_rank_stability_mean, CAST(NULL AS DOUBLE) AS rbo_rank_stability_std FROM c""")
def stability_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = selection_log(spark, sf_dir).where("run_id = 'N'").drop("run_id")
    found = stability.stability_bundle(log, TOTAL)
    return rounded(found, {c: 9 for c in found.columns if c.endswith(("stability", "jaccard", "_mean", "_std")) and "rbo" not in c})


# ---- Rankings ----

OVERALL = f"""{VOLUME},
overall AS (SELECT run_id, feature_name AS feature, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sum(score) DESC, feature_name) AS INT) AS rank
            FROM volume GROUP BY run_id, feature_name),
outer_rank AS (SELECT feature, rank FROM overall WHERE run_id = 'A' AND rank <= 60),
inner_rank AS (SELECT feature, rank FROM overall WHERE run_id = 'R' AND rank <= 25)"""


def overall(spark: SparkSession, sf_dir: str, run: str, top: int | None = None) -> DataFrame:
    """(feature, rank) of a run over all years: the ``top`` first, or all."""
    totals = volume(spark, sf_dir).where(F.col("run_id") == run).groupBy("feature_name").agg(F.sum("score").alias("score"))
    order = Window.orderBy(F.col("score").desc(), "feature_name")
    # One row per feature name.
    ranked = totals.select(F.col("feature_name").alias("feature"), F.row_number().over(order).alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


@query("fill_to_budget", f"""
WITH {OVERALL}, merged AS (SELECT feature, min(tier * 1000 + rank) AS place FROM (SELECT 0 AS tier, * FROM (SELECT * FROM inner_rank WHERE rank <= 10)
     UNION ALL SELECT 1, * FROM outer_rank) GROUP BY feature)
SELECT feature, CAST(row_number() OVER (ORDER BY place) AS INT) AS rank FROM merged QUALIFY row_number() OVER (ORDER BY place) <= 40""")
def fill_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short core first, then the long ranking, without repeats."""
    return selection.fill_to_budget([overall(spark, sf_dir, "R", 10), overall(spark, sf_dir, "A", 60)], 40)


@query("validated_ranking", f"""
WITH {OVERALL}
SELECT o.feature, CAST(row_number() OVER (PARTITION BY i.feature IS NOT NULL ORDER BY o.rank) AS INT) AS rank, i.feature IS NOT NULL AS known
FROM outer_rank o LEFT JOIN inner_rank i ON i.feature = o.feature""")
def validated_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unknown = selection.validated_ranking(overall(spark, sf_dir, "A", 60), overall(spark, sf_dir, "R", 25))
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query("ordered_unique", f"""
WITH {LOG} SELECT feature_name AS feature, CAST(row_number() OVER (ORDER BY min(fold_id * 100 + rank)) AS INT) AS rank
FROM log WHERE run_id = 'A' GROUP BY feature_name""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = selection_log(spark, sf_dir).where("run_id = 'A'").withColumn("place", F.col("fold_id") * 100 + F.col("rank"))
    return selection.ordered_unique(log, "feature_name", "place")


@query("hybrid_trace", f"""
WITH {OVERALL} SELECT o.rank AS llm_rank, o.feature AS feature_name, i.rank IS NOT NULL AS survived_hybrid, i.rank AS hybrid_rank
FROM outer_rank o LEFT JOIN inner_rank i USING (feature)""")
def hybrid_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hybrid_trace(overall(spark, sf_dir, "A", 60), overall(spark, sf_dir, "R", 25))


@query("budget_flags", f"""
WITH {OVERALL} SELECT feature, rank, rank <= 20 AS selected_for_lr_top20, rank <= 40 AS selected_for_catboost_top40,
       rank <= 60 AS candidate_for_lr_hybrid, rank <= 100 AS candidate_for_catboost_hybrid FROM overall WHERE run_id = 'N'""")
def budget_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_budget_flags(overall(spark, sf_dir, "N"), selection.RANKING_BUDGETS)


@query("core_frequency", f"""
WITH {LOG} SELECT feature_name AS feature, CAST(count(*) AS BIGINT) AS selection_count, round(avg(rank), 9) AS mean_rank,
       count(*) / (SELECT CAST(count(DISTINCT fold_id) AS DOUBLE) FROM log) AS selection_frequency
FROM log WHERE run_id = 'A' GROUP BY feature_name""")
def core_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = selection_log(spark, sf_dir)
    years = log.select("fold_id").distinct().count()
    picks = log.where("run_id = 'A'").select(F.col("fold_id").alias("iteration"), F.col("feature_name").alias("feature"), "rank")
    return rounded(selection.core_frequency(picks, years), {"mean_rank": 9})


@query("dedupe_keep_last", """
SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value, max_by(props, event_id) AS props
FROM events GROUP BY user_id, event_type""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").drop("ts")
    return selection.keep_last(events, ["user_id", "event_type"], "event_id")


RULE_METADATA = f"""(SELECT feature_name AS feature, round(count(*) FILTER (l_tax = 0) / CAST(count(*) AS DOUBLE), 4) AS missing_rate,
       CAST(count(*) FILTER (l_tax <> 0) AS BIGINT) AS non_null_count FROM lineitem JOIN {NAMED} ON l_partkey = p_partkey GROUP BY feature_name)"""
PRIORITY = "CASE semantic_group " + " ".join(f"WHEN '{g}' THEN {p}" for g, p in labels.GROUP_PRIORITY.items()) + " ELSE 0 END"


@query("domain_rule_rank", f"""
WITH g AS (SELECT *, {group_sql('upper(feature)', 'upper(feature)', "''")} AS semantic_group FROM {RULE_METADATA}),
r AS (SELECT feature, CAST(row_number() OVER (ORDER BY {PRIORITY} DESC, missing_rate, non_null_count DESC, feature) AS INT) AS rank FROM g)
SELECT * FROM r WHERE rank <= 40""")
def domain_rule_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax-free lines stand for missing values of the part's feature."""
    lines = table(spark, sf_dir, "lineitem").join(named_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    free = F.col("l_tax") == 0
    metadata = lines.groupBy(F.col("feature_name").alias("feature")).agg(
        F.round(F.count_if(free) / F.count(F.lit(1)), 4).alias("missing_rate"), F.count_if(~free).alias("non_null_count")
    )
    return selection.domain_rule_ranking(metadata.withColumn("semantic_group", labels.semantic_group(F.col("feature"))), 40)


# ---- Selectors and models ----

def embedding_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    vectors = table(spark, sf_dir, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return vectors.select("vec_id", (F.col("label") == 1).cast("int").alias("y"), *cells), names


def document_table(spark: SparkSession, sf_dir: str, how: str = "inner") -> tuple[DataFrame, list[str]]:
    """Labelled documents with counts over the whole text; with ``how`` left, all documents."""
    text = F.col("text")
    counts = {
        "n_chars": F.col("n_chars").cast("double"),
        "words": F.size(F.split(text, r"\s+")).cast("double"),
        "lines": F.size(F.split(text, "\n")).cast("double"),
        "digits": F.regexp_count(text, F.lit("[0-9]")).cast("double"),
        "capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("double"),
        "stops": F.regexp_count(text, F.lit("[.!?]")).cast("double"),
    }
    # Counted before the join, which then moves numbers in place of texts.
    counted = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in counts.items()])
    made = counted.join(table(spark, sf_dir, "labels"), "doc_id", how)
    return made.select("doc_id", F.col("quality").alias("y"), *counts), list(counts)


@query("rf_importance")
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = document_table(spark, sf_dir)
    scores = selection.forest_importance(df, "y", names, trees=32)
    return models.importance_frame(spark, list(scores), list(scores.values()))


@query("mrmr_rank")
def mrmr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = embedding_table(spark, sf_dir)
    picked = selection.MrmrSelector(10, trees=32).fit(df, "y", names)
    return selection.selection_rows(df, picked.selected, picked.scores, "mrmr", 1)


@query("pca_components")
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = embedding_table(spark, sf_dir)
    return selection.PcaSelector(0.8).fit(df, "y", names).explained(df)


@query("pca_projection")
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = embedding_table(spark, sf_dir)
    return selection.PcaSelector(5).fit(df, "y", names).transform(df, "vec_id", "y")


@query("boruta_rank")
def boruta_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = document_table(spark, sf_dir)
    return wrappers.BorutaSelector().fit(df, "y", names).report(df)


@query("rfe")
def rfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = document_table(spark, sf_dir)
    kept = wrappers.RfeSelector(3, 2, trees=8, depth=3).fit(df, "y", names)
    return selection.selection_rows(df, kept.selected, kept.scores, "rfe", 1)


def scored_documents(spark: SparkSession, sf_dir: str, kind: str, settings: dict) -> DataFrame:
    """Every document's score by a model of the labelled ones; y is NULL without a label."""
    df, names = document_table(spark, sf_dir)
    every, _ = document_table(spark, sf_dir, "left")
    return models.fit_model(kind, df, names, "y", settings).score(every, "doc_id", "y")


@query("lr_scores")
def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir, "lr", {"maxIter": 50})


@query("rf_scores")
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir, "rf", {"numTrees": 20, "maxDepth": 6})


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir, "gbt", {"maxIter": 8, "maxDepth": 4, "minInstancesPerNode": 10})


@query("document_roc")
def document_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model's score through the exact metrics."""
    return scoring.roc_metrics(lr_scores(spark, sf_dir).where(F.col("y").isNotNull()), "y", "score")


@query("time_folds_experiment")
def time_folds_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories to features, windows, and a cross-validated logistic model with mRMR."""
    tables = histories(spark, sf_dir) | {"application_train": customers(spark, sf_dir)}
    prepared = prepare(tables, windows=Windows(-800, -30, 0))
    spec = ModelSpec("lr", {"maxIter": 30}, selector=lambda: selection.MrmrSelector(8, trees=16), selector_name="mrmr")
    found = run_folds(prepared.dev, prepared.key, prepared.target, prepared.time, prepared.features, spec, n_splits=2)
    return found.folds.select("fold", "train_size", "val_size", "selected_features", "auc", "gini", "ks", "psi_model", "jaccard_similarity")


@query("average_rank", f"""
WITH {VOLUME}
SELECT run_id, fold_id, feature_name, score, rank() OVER w + (count(*) OVER (PARTITION BY run_id, fold_id, score) - 1) / 2.0 AS rank
FROM (SELECT run_id, fold_id, feature_name, score // 50 AS score FROM volume) WINDOW w AS (PARTITION BY run_id, fold_id ORDER BY score DESC)""")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse scores, so that many features share a rank."""
    coarse = volume(spark, sf_dir).withColumn("score", F.expr("score div 50"))
    return stability.average_rank(coarse, "score", ["run_id", "fold_id"]).select("run_id", "fold_id", "feature_name", "score", "rank")
