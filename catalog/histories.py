"""History tables to features: mass aggregation, domain columns, joins, recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORDERS, SINGLE, query, round_sql, rounded, scored_orders, table
from driftwell.functions.labels import month_ceil, month_floor, segment_label
from driftwell.operators import history, timeline
from driftwell.sources.tables import null_day_sentinel, sentinel_counts

STATS = ("MIN", "MAX", "MEAN", "SUM", "VAR")
FEW = ("MEAN", "SUM")
Digits = dict[str, int | None]


def stat_sql(column: str, stat: str) -> str:
    name = {"MIN": "min", "MAX": "max", "MEAN": "avg", "SUM": "sum", "VAR": "var_samp"}[stat]
    expression = f"{name}({column})"
    return f"coalesce({expression}, 0)" if stat == "SUM" else expression


def plan(prefix: str, spec: dict[str, Digits | None]) -> dict[str, tuple[str, str, int | None]]:
    """Output name to (column, statistic, digits); a column marked None has two values."""
    made = {}
    for column, digits in spec.items():
        for stat in STATS if digits is not None else FEW:
            default = SINGLE if stat == "VAR" else None
            made[f"{prefix}_{column}_{stat}"] = (column, stat, (digits or {}).get(stat, default))
    return made


def mass_sql(
    source: str, key: str, prefix: str, spec: dict[str, Digits | None], types: dict[str, str] | None = None,
    unrounded: bool = False,
) -> str:
    cells = []
    for name, (column, stat, digits) in plan(prefix, spec).items():
        expression = round_sql(stat_sql(f'"{column}"', stat), None if unrounded else digits)
        if stat == "SUM" and (types or {}).get(column, "BIGINT") == "BIGINT":
            expression = f"CAST({expression} AS BIGINT)"
        cells.append(f'{expression} AS "{name}"')
    return f"SELECT {key}, {', '.join(cells)} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"


def tidy(df: DataFrame, prefix: str, spec: dict[str, Digits | None]) -> DataFrame:
    return rounded(df, {name: digits for name, (_, _, digits) in plan(prefix, spec).items()})


# ---- The tables in the shape of the five histories ----

def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scored_orders(spark, sf_dir)
    debt = F.when(F.col("o_orderstatus") == "F", F.lit(0)).when(F.col("o_orderstatus") == "O", F.col("cents"))
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_BUREAU"),
        F.col("cents").alias("AMT_CREDIT_SUM"),
        debt.otherwise(F.expr("cents div 2")).cast("long").alias("AMT_CREDIT_SUM_DEBT"),
        F.col("day").cast("long").alias("DAYS_CREDIT"),
        (F.col("day") + F.col("o_orderkey") % 365).cast("long").alias("DAYS_CREDIT_ENDDATE"),
    )


BUREAU = f"""(
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU, cents AS AMT_CREDIT_SUM,
           CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN cents ELSE cents // 2 END AS BIGINT) AS AMT_CREDIT_SUM_DEBT,
           CAST(day AS BIGINT) AS DAYS_CREDIT, CAST(day + o_orderkey % 365 AS BIGINT) AS DAYS_CREDIT_ENDDATE
    FROM {ORDERS})"""


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-F.col("l_linenumber")).cast("long").alias("MONTHS_BALANCE"),
        F.col("l_quantity").cast("long").alias("QUANTITY"),
        (F.col("l_returnflag") == "R").cast("int").alias("RETURNED"),
    )


BALANCE = """(
    SELECT l_orderkey AS SK_ID_BUREAU, CAST(-l_linenumber AS BIGINT) AS MONTHS_BALANCE,
           CAST(l_quantity AS BIGINT) AS QUANTITY, CAST(l_returnflag = 'R' AS INT) AS RETURNED
    FROM lineitem)"""

BALANCE_SPEC: dict[str, Digits | None] = {"MONTHS_BALANCE": {}, "QUANTITY": {}, "RETURNED": None}
# Means of whole numbers are equal bit by bit; other sums depend on the order of the rows.
EXACT: Digits = {}
# Variances of nearly constant ratios are rounding noise: compared to nine places.
RATIO: Digits = {"SUM": SINGLE, "MEAN": SINGLE, "VAR": 9}


def bureau_sql() -> tuple[str, dict[str, Digits | None]]:
    """Bureau credits with their balance statistics and derived columns, and what to aggregate."""
    balance_names = list(plan("BB", BALANCE_SPEC))
    inner = mass_sql(BALANCE, "SK_ID_BUREAU", "BB", BALANCE_SPEC, unrounded=True)
    source = f"""(
        SELECT b.*, {', '.join(f'bb."{n}"' for n in balance_names)},
               AMT_CREDIT_SUM - AMT_CREDIT_SUM_DEBT AS DEBT_CREDIT_DIFF,
               AMT_CREDIT_SUM_DEBT / (CAST(AMT_CREDIT_SUM AS DOUBLE) + 1e-6) AS DEBT_RATIO,
               DAYS_CREDIT_ENDDATE - DAYS_CREDIT AS CREDIT_DURATION
        FROM {BUREAU} b LEFT JOIN ({inner}) bb USING (SK_ID_BUREAU))"""
    spec: dict[str, Digits | None] = {
        "AMT_CREDIT_SUM": EXACT, "AMT_CREDIT_SUM_DEBT": EXACT, "DAYS_CREDIT": EXACT, "DAYS_CREDIT_ENDDATE": EXACT,
        **{n: dict.fromkeys(STATS if n.endswith(("MEAN", "VAR")) else ("MEAN", "VAR"), SINGLE) for n in balance_names},
        "DEBT_CREDIT_DIFF": EXACT, "DEBT_RATIO": RATIO, "CREDIT_DURATION": EXACT,
    }
    return source, spec


BUREAU_SOURCE, BUREAU_SPEC = bureau_sql()
BUREAU_TYPES = {n: "DOUBLE" for n in BUREAU_SPEC if n.endswith(("MEAN", "VAR"))} | {"DEBT_RATIO": "DOUBLE"}

@query("two_level_rollup", mass_sql(BUREAU_SOURCE, "SK_ID_CURR", "BURO", BUREAU_SPEC, BUREAU_TYPES))
def two_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items to orders, orders to customers: the two-level bureau features."""
    features = history.bureau_features(bureau(spark, sf_dir), balance(spark, sf_dir))
    return tidy(features, "BURO", BUREAU_SPEC)


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("cents").alias("AMT_APPLICATION"),
        F.expr("cents * 9 div 10").alias("AMT_CREDIT"),
        F.expr("cents div 12").alias("AMT_ANNUITY"),
        (14 - F.col("o_orderkey") % 5).alias("CNT_PAYMENT"),
        F.col("day").cast("long").alias("DAYS_DECISION"),
    )


PREVIOUS = f"""(
    SELECT o_custkey AS SK_ID_CURR, cents AS AMT_APPLICATION, cents * 9 // 10 AS AMT_CREDIT, cents // 12 AS AMT_ANNUITY,
           14 - o_orderkey % 5 AS CNT_PAYMENT, CAST(day AS BIGINT) AS DAYS_DECISION FROM {ORDERS})"""
PREVIOUS_SPEC: dict[str, Digits | None] = {
    "AMT_APPLICATION": EXACT, "AMT_CREDIT": EXACT, "AMT_ANNUITY": EXACT, "CNT_PAYMENT": EXACT, "DAYS_DECISION": EXACT,
    "ASK_GRANT_RATIO": RATIO, "APPLICATION_DIFF": EXACT, "PAYMENT_TERM": RATIO, "recent_decision": EXACT,
    "INTEREST_ESTIMATE": RATIO,
}
RATIO_TYPES = dict.fromkeys(["ASK_GRANT_RATIO", "PAYMENT_TERM", "INTEREST_ESTIMATE"], "DOUBLE")


@query("previous_features", f"""
WITH src AS (SELECT *, AMT_APPLICATION / (CAST(AMT_CREDIT AS DOUBLE) + 1e-6) AS ASK_GRANT_RATIO,
                    AMT_APPLICATION - AMT_CREDIT AS APPLICATION_DIFF,
                    AMT_CREDIT / (CAST(AMT_ANNUITY AS DOUBLE) + 1e-6) AS PAYMENT_TERM, DAYS_DECISION AS recent_decision,
                    (CNT_PAYMENT * AMT_ANNUITY - AMT_CREDIT) / (CAST(AMT_CREDIT AS DOUBLE) + 1e-6) AS INTEREST_ESTIMATE
             FROM {PREVIOUS})
SELECT *, "PREV_recent_decision_MAX" AS recent_decision FROM ({mass_sql('src', 'SK_ID_CURR', 'PREV', PREVIOUS_SPEC, RATIO_TYPES)})
""")
def previous_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.previous_application_features(previous(spark, sf_dir)), "PREV", PREVIOUS_SPEC)


def pos_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("SK_ID_CURR"),
        (-(F.col("event_id") % 24)).alias("MONTHS_BALANCE"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 9).when(F.col("event_type") != "view", 0)
        .cast("long").alias("SK_DPD"),
        (1 + F.col("event_id") % 12).alias("CNT_INSTALMENT"),
        (F.col("event_id") % 7).alias("CNT_INSTALMENT_FUTURE"),
    )


POS = """(
    SELECT user_id AS SK_ID_CURR, -(event_id % 24) AS MONTHS_BALANCE,
           CAST(CASE WHEN event_type = 'error' THEN event_id % 9 WHEN event_type <> 'view' THEN 0 END AS BIGINT) AS SK_DPD,
           1 + event_id % 12 AS CNT_INSTALMENT, event_id % 7 AS CNT_INSTALMENT_FUTURE FROM events)"""
POS_SPEC: dict[str, Digits | None] = {
    "MONTHS_BALANCE": EXACT, "SK_DPD": EXACT, "CNT_INSTALMENT": EXACT, "CNT_INSTALMENT_FUTURE": EXACT,
    "LATE_PAYMENT": None, "TOTAL_INSTALMENT_PROG": RATIO,
}


@query("pos_features", f"""
WITH src AS (SELECT *, CAST(coalesce(SK_DPD > 0, false) AS INT) AS LATE_PAYMENT,
                    CNT_INSTALMENT_FUTURE / (CAST(CNT_INSTALMENT AS DOUBLE) + 1e-6) AS TOTAL_INSTALMENT_PROG FROM {POS})
{mass_sql('src', 'SK_ID_CURR', 'POS', POS_SPEC, {'TOTAL_INSTALMENT_PROG': 'DOUBLE'})}
""")
def pos_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.pos_cash_features(pos_cash(spark, sf_dir)), "POS", POS_SPEC)


def installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ship = F.datediff("l_shipdate", F.lit("2001-12-31")).cast("long")
    paid = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)), ship + (F.col("l_linenumber") - 3) * F.col("l_quantity").cast("long"))
    return lines.join(owners, lines.l_orderkey == owners.o_orderkey).select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        cents.alias("AMT_INSTALMENT"),
        (cents - (F.col("l_linenumber") - 2) * 100).alias("AMT_PAYMENT"),
        ship.alias("DAYS_INSTALMENT"),
        paid.alias("DAYS_ENTRY_PAYMENT"),
    )


INSTALLMENTS = """(
    SELECT SK_ID_CURR, cents AS AMT_INSTALMENT, cents - (l_linenumber - 2) * 100 AS AMT_PAYMENT, ship AS DAYS_INSTALMENT,
           CASE WHEN NOT (l_linestatus = 'O' AND l_linenumber = 7) THEN ship + (l_linenumber - 3) * CAST(l_quantity AS BIGINT) END AS DAYS_ENTRY_PAYMENT
    FROM (SELECT o_custkey AS SK_ID_CURR, l_linenumber, l_linestatus, l_quantity,
                 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                 CAST(date_diff('day', DATE '2001-12-31', CAST(l_shipdate AS DATE)) AS BIGINT) AS ship
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
INSTALLMENT_SPEC: dict[str, Digits | None] = {
    "AMT_INSTALMENT": EXACT, "AMT_PAYMENT": EXACT, "DAYS_INSTALMENT": EXACT, "DAYS_ENTRY_PAYMENT": EXACT,
    "PAYMENT_DIFF": EXACT, "PAYMENT_RATIO": RATIO, "DAYS_DIFF": EXACT, "IS_LATE": None, "IS_UNDERPAID": None,
}


@query("installment_features", f"""
WITH src AS (SELECT *, AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
                    AMT_PAYMENT / (CAST(AMT_INSTALMENT AS DOUBLE) + 1e-6) AS PAYMENT_RATIO,
                    DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DAYS_DIFF,
                    CAST(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0, false) AS INT) AS IS_LATE,
                    CAST(coalesce(AMT_INSTALMENT - AMT_PAYMENT > 0, false) AS INT) AS IS_UNDERPAID FROM {INSTALLMENTS})
{mass_sql('src', 'SK_ID_CURR', 'INSTAL', INSTALLMENT_SPEC, {'PAYMENT_RATIO': 'DOUBLE'})}
""")
def installment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.installment_features(installments(spark, sf_dir)), "INSTAL", INSTALLMENT_SPEC)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", cents.alias("cents")).select(
        F.col("user_id").alias("SK_ID_CURR"),
        (-(F.col("event_id") % 36)).alias("MONTHS_BALANCE"),
        F.col("cents").alias("AMT_BALANCE"),
        ((F.col("user_id") % 10 + 1) * 1000).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.expr("cents div 2").alias("AMT_PAYMENT_CURRENT"),
        (F.col("event_id") % 50 + 100).alias("AMT_INST_MIN_REGULARITY"),
        F.expr("cents div 3").alias("AMT_DRAWINGS_CURRENT"),
    )


CARDS = """(
    SELECT user_id AS SK_ID_CURR, -(event_id % 36) AS MONTHS_BALANCE, cents AS AMT_BALANCE,
           (user_id % 10 + 1) * 1000 AS AMT_CREDIT_LIMIT_ACTUAL, cents // 2 AS AMT_PAYMENT_CURRENT,
           event_id % 50 + 100 AS AMT_INST_MIN_REGULARITY, cents // 3 AS AMT_DRAWINGS_CURRENT
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events))"""
CARD_SPEC: dict[str, Digits | None] = {
    "MONTHS_BALANCE": EXACT, "AMT_BALANCE": EXACT, "AMT_CREDIT_LIMIT_ACTUAL": EXACT, "AMT_PAYMENT_CURRENT": EXACT,
    "AMT_INST_MIN_REGULARITY": EXACT, "AMT_DRAWINGS_CURRENT": EXACT,
    "LIMIT_USE": RATIO, "PAYMENT_DIV_MIN": RATIO,
    "DRAWING_RATIO": RATIO,
}


@query("card_features", f"""
WITH src AS (SELECT *, AMT_BALANCE / (CAST(AMT_CREDIT_LIMIT_ACTUAL AS DOUBLE) + 1e-6) AS LIMIT_USE,
                    AMT_PAYMENT_CURRENT / (CAST(AMT_INST_MIN_REGULARITY AS DOUBLE) + 1e-6) AS PAYMENT_DIV_MIN,
                    AMT_DRAWINGS_CURRENT / (CAST(AMT_CREDIT_LIMIT_ACTUAL AS DOUBLE) + 1e-6) AS DRAWING_RATIO FROM {CARDS})
{mass_sql('src', 'SK_ID_CURR', 'CC', CARD_SPEC, dict.fromkeys(['LIMIT_USE', 'PAYMENT_DIV_MIN', 'DRAWING_RATIO'], 'DOUBLE'))}
""")
def card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.credit_card_features(cards(spark, sf_dir)), "CC", CARD_SPEC)


# ---- Plain aggregations ----

ORDER_SPEC: dict[str, Digits | None] = {"cents": EXACT, "day": EXACT, "y": None}


@query("mass_agg_orders", mass_sql(ORDERS, "o_custkey", "ORD", ORDER_SPEC))
def mass_agg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir).select("o_custkey", "cents", "day", "y")
    return tidy(history.mass_aggregate(orders, "o_custkey", "ORD"), "ORD", ORDER_SPEC)


LEVELS = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def onehot_cells() -> str:
    cells = []
    for column, levels in LEVELS.items():
        for level in [*levels, None]:
            test = f"{column} IS NULL" if level is None else f"{column} = '{level}'"
            hit, name = f"CASE WHEN {test} THEN 1 ELSE 0 END", f"ORD_{column}_{level or 'nan'}"
            cells += [f'avg({hit}) AS "{name}_MEAN"', f'CAST(sum({hit}) AS BIGINT) AS "{name}_SUM"']
    return ", ".join(cells)


@query("onehot_agg", f"SELECT o_custkey, {onehot_cells()} FROM orders GROUP BY o_custkey")
def onehot_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return history.mass_aggregate(orders, "o_custkey", "ORD", categorical="onehot")


@query("level_maps", """
WITH n AS (SELECT l_suppkey, count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'N') AS missing FROM lineitem GROUP BY l_suppkey),
c AS (SELECT l_suppkey, 'p' || l_partkey AS level, count(*) AS hits FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_partkey)
SELECT l_suppkey, level, CAST(hits AS BIGINT) AS hits, CAST(rows AS BIGINT) AS rows, CAST(missing AS BIGINT) AS missing,
       round(hits / rows, 12) AS mean FROM c JOIN n USING (l_suppkey)""")
def level_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot sums of thousands of levels: every part of a supplier's lines, without a column per part."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.when(F.col("l_returnflag") != "N", F.concat(F.lit("p"), F.col("l_partkey"))).alias("part")
    )
    maps = history.mass_aggregate(lines, "l_suppkey", "LINE", categorical="map")
    cells = maps.select("l_suppkey", F.explode("LINE_part_LEVELS").alias("level", "hits"), F.col("LINE_ROWS").alias("rows"), F.col("LINE_part_MISSING").alias("missing"))
    return cells.withColumn("mean", F.round(F.col("hits") / F.col("rows"), 12))


@query("named_aggs", f"""
SELECT o_custkey, min(cents) AS lowest, max(cents) AS highest, avg(cents) AS average, CAST(sum(cents) AS BIGINT) AS total,
       round(stddev_samp(cents), 1) AS spread, CAST(count(cents) AS BIGINT) AS orders, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS states,
       median(cents) AS middle
FROM {ORDERS} GROUP BY o_custkey""")
def named_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {
        "lowest": ("cents", "min"), "highest": ("cents", "max"), "average": ("cents", "mean"), "total": ("cents", "sum"),
        "spread": ("cents", "std"), "orders": ("cents", "count"), "states": ("o_orderstatus", "nunique"),
        "middle": ("cents", "median"),
    }
    return rounded(history.named_aggregate(scored_orders(spark, sf_dir), "o_custkey", spec), {"spread": 1})


@query("named_medians", f"""
SELECT o_custkey, CAST(count(cents) AS BIGINT) AS orders, median(cents) AS cents_middle, median(day) AS day_middle, round(median(s), 12) AS score_middle
FROM {ORDERS} GROUP BY o_custkey""")
def named_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three medians from one count of all their values."""
    spec = {"orders": ("cents", "count"), "cents_middle": ("cents", "median"), "day_middle": ("day", "median"), "score_middle": ("s", "median")}
    return rounded(history.named_aggregate(scored_orders(spark, sf_dir), "o_custkey", spec), {"score_middle": 12})


@query("sentinel_nullify", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, CAST(count(nullif(l_quantity, 50)) AS BIGINT) AS kept,
       sum(nullif(l_quantity, 50)) AS total, max(nullif(l_quantity, 50)) AS highest
FROM lineitem GROUP BY l_returnflag""")
def sentinel_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("DAYS_QUANTITY"))
    return null_day_sentinel(lines, sentinel=50).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count("DAYS_QUANTITY").alias("kept"),
        F.sum("DAYS_QUANTITY").alias("total"), F.max("DAYS_QUANTITY").alias("highest"),
    )


@query("sentinel_counts", """
SELECT 'DAYS_QUANTITY' AS "column", CAST(count(*) FILTER (l_quantity = 50) AS BIGINT) AS replaced FROM lineitem
UNION ALL SELECT 'DAYS_LINE', CAST(count(*) FILTER (l_linenumber = 50) AS BIGINT) FROM lineitem""")
def sentinel_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("DAYS_QUANTITY"), F.col("l_linenumber").alias("DAYS_LINE"), "l_tax"
    )
    return sentinel_counts(lines, sentinel=50)


@query("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return history.latest_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey")


@query("badrate_by_month", f"""
SELECT CAST(floor(day / 30.0) AS BIGINT) AS month, avg(y) AS mean, CAST(count(y) AS BIGINT) AS count FROM {ORDERS} GROUP BY 1""")
def badrate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scored_orders(spark, sf_dir).withColumn("month", month_floor(F.col("day")))
    return history.rate_and_volume(orders, "month", "y")


@query("value_counts", """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM orders GROUP BY o_orderstatus""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("segment_label", f"""
WITH m AS (SELECT *, CAST(floor(day / 30.0) AS BIGINT) AS month, CAST(ceil(day / 30.0) AS BIGINT) AS month_ceiling FROM {ORDERS})
SELECT CASE WHEN month < -20 THEN 'Trash' WHEN month < -7 THEN 'Dev' ELSE 'OOT' END AS segment,
       CAST(count(*) AS BIGINT) AS rows, min(month) AS first_month, max(month) AS last_month,
       CAST(sum(month_ceiling) AS BIGINT) AS ceilings, avg(y) AS rate
FROM m GROUP BY 1""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = scored_orders(spark, sf_dir).withColumns(
        {"month": month_floor(F.col("day")), "month_ceiling": month_ceil(F.col("day"))}
    )
    return months.groupBy(segment_label(F.col("month")).alias("segment")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.sum("month_ceiling").alias("ceilings"), F.avg("y").alias("rate"),
    )


# ---- Joins and recency ----

def histories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "bureau": bureau(spark, sf_dir),
        "bureau_balance": balance(spark, sf_dir),
        "previous_application": previous(spark, sf_dir),
        "POS_CASH_balance": pos_cash(spark, sf_dir),
        "installments_payments": installments(spark, sf_dir),
        "credit_card_balance": cards(spark, sf_dir),
    }


PROXY = f"""
SELECT SK_ID_CURR, CAST(max(day) AS DOUBLE) AS application_time_proxy FROM (
    SELECT SK_ID_CURR, DAYS_DECISION AS day FROM {PREVIOUS}
    UNION ALL SELECT SK_ID_CURR, DAYS_CREDIT FROM {BUREAU}
    UNION ALL SELECT SK_ID_CURR, greatest(DAYS_INSTALMENT, DAYS_ENTRY_PAYMENT) FROM {INSTALLMENTS}
    UNION ALL SELECT SK_ID_CURR, MONTHS_BALANCE * 30 FROM {POS}
    UNION ALL SELECT SK_ID_CURR, MONTHS_BALANCE * 30 FROM {CARDS}) GROUP BY SK_ID_CURR"""


@query("recency_proxy", PROXY)
def recency_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.time_proxy(histories(spark, sf_dir))


@query("latest_event", "SELECT user_id, max(value) AS newest FROM events WHERE value IS NOT NULL GROUP BY user_id")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest_event(table(spark, sf_dir, "events"), "user_id", "value", "newest")


CUSTOMERS = "(SELECT c_custkey AS SK_ID_CURR, CAST(c_acctbal < 0 AS INT) AS TARGET, c_mktsegment, c_nationkey FROM customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("SK_ID_CURR"), (F.col("c_acctbal") < 0).cast("int").alias("TARGET"),
        "c_mktsegment", "c_nationkey",
    )


MERGE_PREVIOUS: dict[str, Digits | None] = {"AMT_APPLICATION": EXACT, "DAYS_DECISION": EXACT}
MERGE_CARDS: dict[str, Digits | None] = {"AMT_BALANCE": EXACT}


@query("feature_merge", f"""
SELECT * FROM {CUSTOMERS}
LEFT JOIN ({mass_sql(PREVIOUS, 'SK_ID_CURR', 'PREV', MERGE_PREVIOUS)}) USING (SK_ID_CURR)
LEFT JOIN ({mass_sql(CARDS, 'SK_ID_CURR', 'CC', MERGE_CARDS)}) USING (SK_ID_CURR)
LEFT JOIN ({PROXY}) USING (SK_ID_CURR)""")
def feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base table with feature tables of different coverage."""
    tables = histories(spark, sf_dir)
    one = history.mass_aggregate(
        tables["previous_application"].select("SK_ID_CURR", *MERGE_PREVIOUS), "SK_ID_CURR", "PREV"
    )
    two = history.mass_aggregate(tables["credit_card_balance"].select("SK_ID_CURR", *MERGE_CARDS), "SK_ID_CURR", "CC")
    merged = history.merge_features(
        customers(spark, sf_dir),
        [tidy(one, "PREV", MERGE_PREVIOUS), tidy(two, "CC", MERGE_CARDS), timeline.time_proxy(tables)],
        "SK_ID_CURR",
    )
    return merged


@query("dataset_parts", f"""
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS rows, CAST(sum(TARGET) AS BIGINT) AS positives, max(application_time_proxy) AS newest
FROM {CUSTOMERS} LEFT JOIN ({PROXY}) USING (SK_ID_CURR) GROUP BY c_mktsegment""")
def dataset_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged table after separating target and key from the features."""
    proxy = timeline.time_proxy(histories(spark, sf_dir))
    features, labels, merged = history.prepare_dataset(customers(spark, sf_dir), [proxy])
    assert "TARGET" not in features.columns and labels is not None
    return merged.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("TARGET").alias("positives"), F.max("application_time_proxy").alias("newest")
    )
