"""Windows, audits and time-ordered splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORDERS, query, scored_orders
from driftwell.operators import timeline
from driftwell.operators.timeline import Windows

WINDOWS = Windows(-1500, -600, -30)
INSIDE = "day BETWEEN -1500 AND -30"
SPLIT = "CASE WHEN day >= -1500 AND day < -600 THEN 'dev' WHEN day >= -600 AND day <= -30 THEN 'oot' END"
# Some orders lose their day, so that missing times are met.
GAPPY = f"(SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE day END AS day) FROM {ORDERS})"


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_orders(spark, sf_dir).withColumn("day", F.when(F.col("o_orderkey") % 50 != 7, F.col("day")))


@query("time_windows", f"SELECT o_orderkey, day, y, {SPLIT} AS split FROM {GAPPY} WHERE {INSIDE}")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.cut_windows(gappy_orders(spark, sf_dir), "day", WINDOWS).select("o_orderkey", "day", "y", "split")


@query("window_audit", f"""
SELECT CAST(count(*) AS BIGINT) AS source_rows, CAST(count(*) FILTER (day IS NULL) AS BIGINT) AS dropped_missing_time,
       CAST(count(*) FILTER (day < -1500) AS BIGINT) AS dropped_older, CAST(count(*) FILTER ({SPLIT} = 'dev') AS BIGINT) AS dev_rows,
       CAST(count(*) FILTER ({SPLIT} = 'oot') AS BIGINT) AS oot_rows FROM {GAPPY}""")
def window_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.window_audit(gappy_orders(spark, sf_dir), "day", WINDOWS)


@query("split_manifest", f"""
SELECT {SPLIT} AS split, CAST(count(*) AS BIGINT) AS row_count, min(day) AS time_min, max(day) AS time_max, avg(y) AS target_rate
FROM {GAPPY} WHERE {INSIDE} GROUP BY 1""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.split_manifest(timeline.cut_windows(gappy_orders(spark, sf_dir), "day", WINDOWS), "day", "y")


@query("leakage_report", f"""
SELECT *, train_time_max < oot_time_min AS temporal_split_disjoint, true AS target_column_excluded, false AS oot_used_in_feature_selection
FROM (SELECT CAST(max(day) FILTER ({SPLIT} = 'dev') AS DOUBLE) AS train_time_max,
             CAST(min(day) FILTER ({SPLIT} = 'oot') AS DOUBLE) AS oot_time_min FROM {GAPPY})""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = timeline.cut_windows(gappy_orders(spark, sf_dir), "day", WINDOWS)
    features = timeline.model_columns(cut, "day", "y", others=("o_orderkey", "o_custkey", "split"))
    return timeline.leakage_report(cut, features, "day", "y")


@query("time_fill", f"""
SELECT o_orderkey, coalesce(CAST(day AS DOUBLE), (SELECT CAST(min(day) AS DOUBLE) - 30 FROM {GAPPY})) AS day FROM {GAPPY}""")
def time_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fill_missing_time(gappy_orders(spark, sf_dir), "day").select("o_orderkey", "day")


# Fold bounds by positions over the sorted rows.
BOUNDS = f"""
per AS (SELECT day, count(*) AS rows FROM {ORDERS} GROUP BY day),
cum AS (SELECT day, rows, sum(rows) OVER (ORDER BY day) AS upto, row_number() OVER (ORDER BY day) - 1 AS place,
               sum(rows) OVER () AS n FROM per),
spans AS (SELECT CAST(i AS INT) AS fold, n - (5 - i + 1) * (n // 6) + 1 AS first_row, n - (5 - i + 1) * (n // 6) + n // 6 AS last_row
          FROM (SELECT max(n) AS n FROM cum), range(1, 6) t(i)),
marks AS (SELECT fold, a.day AS val_start, a.place AS start_place, b.day AS val_end
          FROM spans JOIN cum a ON first_row > a.upto - a.rows AND first_row <= a.upto
                     JOIN cum b ON last_row > b.upto - b.rows AND last_row <= b.upto),
bounds AS (SELECT fold, cum.day AS train_end, val_start, val_end FROM marks JOIN cum ON cum.place = start_place - 1 - 1)"""


@query("grouped_ts_split", f"WITH {BOUNDS} SELECT * FROM bounds")
def grouped_ts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.grouped_time_bounds(scored_orders(spark, sf_dir), "day", 5, 1)


@query("fold_sizes", f"""
WITH {BOUNDS}
SELECT fold, CAST(sum(rows) FILTER (day <= train_end) AS BIGINT) AS train_size,
       min(day) FILTER (day <= train_end) AS train_time_start, max(day) FILTER (day <= train_end) AS train_time_end,
       CAST(sum(rows) FILTER (day BETWEEN val_start AND val_end) AS BIGINT) AS val_size,
       min(day) FILTER (day BETWEEN val_start AND val_end) AS val_time_start,
       max(day) FILTER (day BETWEEN val_start AND val_end) AS val_time_end
FROM bounds, per GROUP BY fold""")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir)
    return timeline.fold_info(orders, "day", timeline.grouped_time_folds(orders, "day", 5, 1))


@query("fold_membership", f"""
WITH {BOUNDS}
SELECT o_orderkey, fold, CASE WHEN day <= train_end THEN 'train' ELSE 'val' END AS role
FROM {ORDERS} o JOIN bounds ON day <= train_end OR day BETWEEN val_start AND val_end""")
def fold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir).select("o_orderkey", "day")
    folds = timeline.grouped_time_folds(orders, "day", 5, 1)
    return timeline.fold_membership(orders, "day", folds).select("o_orderkey", "fold", "role")


def positions_sql(window: str, test: str, gap: int) -> str:
    return f"""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY day, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM {ORDERS}),
sizes AS (SELECT max(n) AS n, {window} AS w, {test} AS t FROM o),
folds AS (SELECT CAST(i + 1 AS INT) AS fold, i * t AS a, i * t + w AS b, i * t + w + {gap} AS c, i * t + w + {gap} + t AS d
          FROM sizes, range(0, 4) r(i) WHERE i < (n - w) // t AND i * t + w + {gap} + t <= n)
SELECT o_orderkey, fold, CASE WHEN place < b THEN 'train' ELSE 'test' END AS role
FROM o JOIN folds ON (place >= a AND place < b) OR (place >= c AND place < d)"""


@query("sliding_split", positions_sql("max(n) // 5", "max(n) // 5", 0))
def sliding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir).select("o_orderkey", "day")
    folds = timeline.sliding_positions(orders.count(), 4)
    return timeline.sliding_split(orders, "day", "o_orderkey", folds).select("o_orderkey", "fold", "role")


@query("ratio_split", positions_sql(
    "CAST(floor(max(n) * CAST(0.7 AS DOUBLE) / 4) AS BIGINT)", "CAST(floor(max(n) * CAST(0.3 AS DOUBLE) / 4) AS BIGINT)", 11
))
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir).select("o_orderkey", "day")
    folds = timeline.ratio_positions(orders.count(), 4, 0.7, 0.3, gap=11)
    return timeline.sliding_split(orders, "day", "o_orderkey", folds).select("o_orderkey", "fold", "role")


@query("oot_split", f"""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY day, o_orderkey) AS place, count(*) OVER () AS n FROM {GAPPY} WHERE day IS NOT NULL)
SELECT o_orderkey, CASE WHEN place <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS role FROM o""")
def oot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = gappy_orders(spark, sf_dir).select("o_orderkey", "day")
    return timeline.out_of_time_split(orders, "day", "o_orderkey", 0.2).select("o_orderkey", "role")


@query("last_fold_scores", """
SELECT l_orderkey, max(l_linenumber) AS fold, max_by(l_extendedprice, l_linenumber) AS score
FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber)""")
def last_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for folds: the last one of each order counts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("score")
    )
    # Orders whose line numbers repeat have no last fold to speak of.
    clean = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("d")).where("n = d")
    return timeline.last_fold_scores(lines.join(clean.select("l_orderkey"), "l_orderkey", "left_semi"), "l_orderkey")


@query("last_fold_scores_all", """
WITH newest AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS fold FROM lineitem)
SELECT l_orderkey, fold, max(l_extendedprice) AS score FROM newest WHERE l_linenumber = fold GROUP BY l_orderkey, fold""")
def last_fold_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is read: of lines that share the last number, the one with the larger price counts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("score")
    )
    return timeline.last_fold_scores(lines, "l_orderkey")
