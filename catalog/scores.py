"""Ranking and threshold metrics, drift, information value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORDERS, query, roc_sql, rounded, scored_orders, table
from driftwell.operators import drift, evidence, resample, scoring
from driftwell.functions.labels import drift_level, psi_flag

METRIC_DIGITS = dict.fromkeys(["auc", "gini", "ks", "ks_threshold", "decision_threshold", "log_loss", "brier", "precision", "recall", "f1", "accuracy", "approval_rate", "bad_rate_approved"], 9)

# The score depends on the label a little, so that the metrics are not all at chance.
SHIFTED = f"(SELECT *, (cents % 1000) / CAST(2000 AS DOUBLE) + y * (o_orderkey % 400) / CAST(1000 AS DOUBLE) + CAST(0.001 AS DOUBLE) AS p FROM {ORDERS})"


def shifted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("cents") % 1000) / F.lit(2000.0) + F.col("y") * (F.col("o_orderkey") % 400) / F.lit(1000.0) + F.lit(0.001)
    return scored_orders(spark, sf_dir).withColumn("p", score)


ROC_COLUMNS = "round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(ks, 9) AS ks, round(ks_threshold, 9) AS ks_threshold"


@query("roc_ks", f"WITH src AS (SELECT * FROM {SHIFTED}), {roc_sql('src', 'o_orderpriority', 'y', 'p')} SELECT o_orderpriority, {ROC_COLUMNS} FROM best")
def roc_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.roc_metrics(shifted_orders(spark, sf_dir), "y", "p", ["o_orderpriority"]).drop("positives", "negatives")
    return rounded(found, {c: 9 for c in ("auc", "gini", "ks", "ks_threshold")})


@query("auc_gini", f"WITH src AS (SELECT * FROM {ORDERS}), {roc_sql('src', '', 'y', 's')} SELECT {ROC_COLUMNS} FROM best")
def auc_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.roc_metrics(scored_orders(spark, sf_dir), "y", "s").drop("positives", "negatives")
    return rounded(found, {c: 9 for c in ("auc", "gini", "ks", "ks_threshold")})


def confusion_sql(flag: str) -> str:
    """Confusion counts, ratios and losses of ``flag`` within a select list."""
    tp, fp = f"(count(*) FILTER (y = 1 AND {flag}))", f"(count(*) FILTER (y = 0 AND {flag}))"
    fn, tn = f"(count(*) FILTER (y = 1 AND NOT {flag}))", f"(count(*) FILTER (y = 0 AND NOT {flag}))"
    ratio = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 9)"
    return f"""CAST({tn} AS BIGINT) AS tn, CAST({fp} AS BIGINT) AS fp, CAST({fn} AS BIGINT) AS fn, CAST({tp} AS BIGINT) AS tp,
       {ratio(tp, f'({tp} + {fp})')} AS precision, {ratio(tp, f'({tp} + {fn})')} AS recall,
       {ratio(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1, {ratio(f'({tp} + {tn})', 'count(*)')} AS accuracy,
       {ratio(f'({tn} + {fn})', 'count(*)')} AS approval_rate, {ratio(fn, f'({tn} + {fn})')} AS bad_rate_approved"""


@query("confusion", f"SELECT o_orderpriority, {confusion_sql('(p >= 0.4)')} FROM {SHIFTED} GROUP BY o_orderpriority")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = scoring.flag_at(F.col("p"), 0.4)
    found = scoring.confusion_metrics(shifted_orders(spark, sf_dir), "y", flag, ["o_orderpriority"])
    return rounded(found, {c: d for c, d in METRIC_DIGITS.items() if c in found.columns})


LOSSES = """round(avg(-(y * ln(least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
       + (1 - y) * ln(1 - least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))), 9) AS log_loss,
       round(avg(({p} - y) * ({p} - y)), 9) AS brier"""


@query("logloss_brier", f"SELECT o_orderstatus, {LOSSES.format(p='s')} FROM {ORDERS} GROUP BY o_orderstatus")
def logloss_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = scoring.probability_losses("y", "s")
    found = scored_orders(spark, sf_dir).groupBy("o_orderstatus").agg(*[c.alias(n) for n, c in losses.items()])
    return rounded(found, {"log_loss": 9, "brier": 9})


def evaluate_sql(keys: str, threshold: str, flag: str, used: str) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    join = f"JOIN best USING ({keys})" if keys else "CROSS JOIN best"
    final = f"JOIN counted USING ({keys})" if keys else "CROSS JOIN counted"
    return f"""
WITH src AS (SELECT * FROM {SHIFTED}), {roc_sql('src', keys, 'y', 'p')},
counted AS (SELECT {lead}{confusion_sql(flag)}, {LOSSES.format(p='p')} FROM src {join} {group})
SELECT {lead}{ROC_COLUMNS}, {threshold} AS decision_threshold, {used} FROM best {final}"""


COUNTED = "tn, fp, fn, tp, precision, recall, f1, accuracy, approval_rate, bad_rate_approved, log_loss, brier"


@query("evaluate_model", evaluate_sql("o_orderpriority", "round(ks_threshold, 9)", "(p >= ks_threshold)", COUNTED))
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric per group at the group's own KS threshold."""
    return rounded(scoring.evaluate(shifted_orders(spark, sf_dir), "y", "p", keys=["o_orderpriority"]), METRIC_DIGITS)


@query("evaluate_at_threshold", evaluate_sql("", "CAST(0.35 AS DOUBLE)", "(p >= 0.35)", COUNTED))
def evaluate_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.evaluate(shifted_orders(spark, sf_dir), "y", "p", threshold=0.35), METRIC_DIGITS)


@query("evaluate_flags", evaluate_sql("o_orderpriority", "CAST(NULL AS DOUBLE)", "(o_totalprice > 300000)", COUNTED))
def evaluate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags are given rather than derived from the score."""
    orders = shifted_orders(spark, sf_dir).withColumn("flag", (F.col("o_totalprice") > 300000).cast("int"))
    return rounded(scoring.evaluate(orders, "y", "p", flag="flag", keys=["o_orderpriority"]), METRIC_DIGITS)


@query("threshold_labels", f"""
WITH src AS (SELECT * FROM {SHIFTED}), train AS (SELECT * FROM src WHERE day < -600), {roc_sql('train', '', 'y', 'p')}
SELECT o_orderkey, y AS y_true, p AS y_pred_proba, CAST(p >= (SELECT ks_threshold FROM best) AS INT) AS y_pred FROM src WHERE day >= -600""")
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of late orders at the threshold found on early ones."""
    orders = shifted_orders(spark, sf_dir)
    limit = scoring.decision_threshold(orders.where("day < -600"), "y", "p")
    return orders.where("day >= -600").select(
        "o_orderkey", F.col("y").alias("y_true"), F.col("p").alias("y_pred_proba"),
        scoring.flag_at(F.col("p"), limit).alias("y_pred"),
    )


def lift_sql(keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    cells = []
    for percent, fraction in ((10, "0.1"), (20, "0.2")):
        top = f"place <= greatest(1, ceil(n * CAST({fraction} AS DOUBLE)))"
        cells.append(f"round(avg(y) FILTER ({top}) / nullif(avg(y), 0), 9) AS lift_at_{percent}")
        cells.append(f"round(CAST(sum(y) FILTER ({top}) AS DOUBLE) / nullif(sum(y), 0), 9) AS bad_rate_capture_at_{percent}")
    return f"""
WITH o AS (SELECT *, row_number() OVER ({part} ORDER BY coarse DESC, o_orderkey) AS place, count(*) OVER ({part}) AS n
           FROM (SELECT *, floor(p * 20) AS coarse FROM {SHIFTED}))
SELECT {lead}{', '.join(cells)} FROM o {f'GROUP BY {keys}' if keys else ''}"""


LIFT_DIGITS = {f"{m}_at_{p}": 9 for m in ("lift", "bad_rate_capture") for p in (10, 20)}


@query("lift_capture", lift_sql(""))
def lift_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse scores: most rows are tied, and ties go by order key."""
    orders = shifted_orders(spark, sf_dir).withColumn("coarse", F.floor(F.col("p") * 20))
    return rounded(scoring.lift_and_capture(orders, "y", "coarse", "o_orderkey"), LIFT_DIGITS)


@query("lift_capture_by_group", lift_sql("o_orderpriority"))
def lift_capture_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shifted_orders(spark, sf_dir).withColumn("coarse", F.floor(F.col("p") * 20))
    return rounded(scoring.lift_and_capture(orders, "y", "coarse", "o_orderkey", keys=["o_orderpriority"]), LIFT_DIGITS)


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random draws: checked against the plain bootstrap in the tests."""
    return resample.bootstrap_interval(shifted_orders(spark, sf_dir), "y", "p", ["o_orderpriority"])


# ---- Drift ----

def quantile_list(steps: int) -> str:
    return "[" + ", ".join(f"CAST({i}.0 AS DOUBLE) / {steps}" for i in range(steps + 1)) + "]"


def psi_sql(reference: str, comparison: str, columns: list[str]) -> str:
    """CTE ``psi`` (feature, psi) of the columns of two sources."""
    long = lambda source: " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {source}" for c in columns)
    return f"""
ref AS ({long(reference)}), cmp AS ({long(comparison)}),
marks AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {quantile_list(10)}))) AS q FROM ref WHERE x IS NOT NULL GROUP BY feature),
sides AS (SELECT feature, 'e' AS side, x FROM ref UNION ALL SELECT feature, 'a', x FROM cmp),
placed AS (SELECT feature, side, len(list_filter(q[2:-2], lambda b: x > b)) AS bin FROM sides JOIN marks USING (feature)
           WHERE x IS NOT NULL AND len(q) >= 2),
counted AS (SELECT feature, bin, count(*) FILTER (side = 'e') AS e, count(*) FILTER (side = 'a') AS a FROM placed GROUP BY feature, bin),
shares AS (SELECT feature, e / CAST(sum(e) OVER (PARTITION BY feature) AS DOUBLE) AS e, a / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) AS a FROM counted),
found AS (SELECT feature, sum((e - a) * ln((e + 1e-6) / (a + 1e-6))) AS psi FROM shares GROUP BY feature),
psi AS (SELECT feature, round(psi, 9) AS psi FROM (SELECT DISTINCT feature FROM ref) LEFT JOIN found USING (feature))"""


PSI_COLUMNS = ["o_totalprice", "o_custkey", "y", "day"]
PSI_ORDERS = psi_sql(f"(SELECT * FROM {ORDERS} WHERE day < -900)", f"(SELECT * FROM {ORDERS} WHERE day >= -900)", PSI_COLUMNS)


def order_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir)
    found = drift.feature_psi(orders.where("day < -900"), orders.where("day >= -900"), PSI_COLUMNS)
    return rounded(found, {"psi": 9})


@query("psi_feature", f"WITH {PSI_ORDERS} SELECT * FROM psi")
def psi_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_psi(spark, sf_dir)


LEVEL = "CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'moderate' ELSE 'high' END"


@query("psi_flags", f"""
WITH {PSI_ORDERS}
SELECT feature, psi, CASE WHEN psi <= 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' WHEN psi IS NOT NULL THEN 'unstable' END AS psi_flag,
       {LEVEL} AS drift_level FROM psi""")
def psi_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_psi(spark, sf_dir)
    return found.withColumns({"psi_flag": psi_flag(F.col("psi")), "drift_level": drift_level(F.col("psi"))})


@query("psi_summary", f"""
WITH {PSI_ORDERS}
SELECT round(avg(psi), 9) AS selected_feature_psi_mean, max(psi) AS selected_feature_psi_max,
       round(quantile_cont(psi, 0.5), 9) AS selected_feature_psi_median,
       avg(CASE WHEN psi >= 0.25 THEN 1.0 ELSE 0.0 END) AS selected_feature_psi_high_drift_ratio,
       avg(CASE WHEN psi >= 0.1 THEN 1.0 ELSE 0.0 END) AS selected_feature_psi_moderate_or_high_drift_ratio FROM psi""")
def psi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.psi_summary(order_psi(spark, sf_dir))
    return rounded(found, {"selected_feature_psi_mean": 9, "selected_feature_psi_median": 9})


PSI_EVENTS = psi_sql("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15')", "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')", ["value"])


@query("psi_score", f"WITH {PSI_EVENTS} SELECT * FROM psi")
def psi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "value")
    early, late = F.col("ts") < F.lit("2024-01-15").cast("timestamp"), F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    return rounded(drift.feature_psi(events.where(early), events.where(late), ["value"]), {"psi": 9})


PSI_LINES = psi_sql(
    "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01')", "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01')",
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
)


@query("selected_feature_psi", f"WITH {PSI_LINES} SELECT feature AS feature_name, psi, {LEVEL} AS drift_level FROM psi")
def selected_feature_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    split = F.lit("1998-07-01").cast("timestamp")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    found = drift.selected_feature_psi(lines.where(F.col("l_shipdate") < split), lines.where(F.col("l_shipdate") >= split), columns)
    return rounded(found, {"psi": 9})


# ---- Information value ----

# Prices of cancelled-looking orders are missing, so that there is a missing bin.
IV_SOURCE = f"(SELECT *, CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE CAST(cents AS DOUBLE) END AS amount FROM {ORDERS})"


def iv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 40 != 3, F.col("cents").cast("double"))
    return scored_orders(spark, sf_dir).withColumn("amount", amount)


IV_COLUMNS = ["amount", "o_custkey", "day", "o_orderpriority", "o_orderstatus"]
IV_BINS = f"""
src AS (SELECT * FROM {IV_SOURCE}),
nums AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y FROM src" for c in IV_COLUMNS[:3])}),
marks AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {quantile_list(10)}))) AS q FROM nums WHERE x IS NOT NULL GROUP BY feature),
binned AS (SELECT feature, coalesce(CASE WHEN x IS NOT NULL THEN CAST(len(list_filter(q[2:-2], lambda b: x > b)) AS VARCHAR) END, 'Missing') AS bin, y
           FROM nums JOIN marks USING (feature)
           {' '.join(f"UNION ALL SELECT '{c}', coalesce({c}, 'Missing'), y FROM src" for c in IV_COLUMNS[3:])}),
counted AS (SELECT feature, bin, CAST(sum(1 - y) AS BIGINT) AS good, CAST(sum(y) AS BIGINT) AS bad FROM binned GROUP BY feature, bin),
smooth AS (SELECT *, CASE WHEN good = 0 OR bad = 0 THEN 0.5 ELSE 0.0 END AS add, sum(good) OVER (PARTITION BY feature) AS ag,
                  sum(bad) OVER (PARTITION BY feature) AS ab FROM counted),
shares AS (SELECT feature, bin, good, bad, (good + add) / CAST(ag AS DOUBLE) AS good_share, (bad + add) / CAST(ab AS DOUBLE) AS bad_share,
                  good = 0 OR bad = 0 AS pure FROM smooth),
bins AS (SELECT *, ln(good_share / bad_share) AS woe, (good_share - bad_share) * ln(good_share / bad_share) AS iv FROM shares),
ivs AS (SELECT feature, sum(iv) AS iv, CAST(count(*) AS BIGINT) AS bins, bool_or(pure) AS pure_bin FROM bins GROUP BY feature)"""


@query("iv_woe", f"""
WITH {IV_BINS} SELECT feature, bin, good, bad, round(good_share, 9) AS good_share, round(bad_share, 9) AS bad_share, round(woe, 9) AS woe,
       round(iv, 9) AS iv, pure FROM bins""")
def iv_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = evidence.InformationValue().fit(iv_orders(spark, sf_dir), "y", IV_COLUMNS)
    return rounded(fitted.bin_table, {c: 9 for c in ("good_share", "bad_share", "woe", "iv")})


@query("iv_leak_flags", f"""
WITH {IV_BINS} SELECT feature, round(iv, 9) AS iv, bins, pure_bin, iv >= 0.5 AS high_iv, pure_bin OR iv >= 0.5 AS leakage_flag FROM ivs""")
def iv_leak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.InformationValue().fit(iv_orders(spark, sf_dir), "y", IV_COLUMNS).table, {"iv": 9})


@query("iv_selected", f"WITH {IV_BINS} SELECT feature, round(iv, 9) AS iv FROM ivs WHERE iv >= 0.001")
def iv_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = evidence.InformationValue(min_iv=0.001).fit(iv_orders(spark, sf_dir), "y", IV_COLUMNS)
    return rounded(fitted.table.where(F.col("feature").isin(fitted.selected)).select("feature", "iv"), {"iv": 9})


@query("woe_encode", f"""
WITH {IV_BINS},
w AS (SELECT feature, bin, woe FROM bins),
m AS (SELECT feature, q FROM marks)
SELECT o_orderkey, round(a.woe, 9) AS amount, round(p.woe, 9) AS o_orderpriority
FROM src
JOIN w a ON a.feature = 'amount' AND a.bin = coalesce(CASE WHEN amount IS NOT NULL THEN
     CAST(len(list_filter((SELECT q FROM m WHERE feature = 'amount')[2:-2], lambda b: amount > b)) AS VARCHAR) END, 'Missing')
JOIN w p ON p.feature = 'o_orderpriority' AND p.bin = o_orderpriority""")
def woe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = iv_orders(spark, sf_dir)
    fitted = evidence.InformationValue().fit(orders, "y", IV_COLUMNS)
    return rounded(fitted.encode(orders, ["amount", "o_orderpriority"], "o_orderkey"), {"amount": 9, "o_orderpriority": 9})
