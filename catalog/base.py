"""Registry of the runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.numbers import quoted

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Newest order date: days are counted back from it.
REFERENCE_DATE = "2001-08-01"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Digits entry: cut to single precision. Unlike decimal places this has no ties on sums of fractions.
SINGLE = 99


def rounded(df: DataFrame, digits: Mapping[str, int | None]) -> DataFrame:
    """Round columns, since float sums depend on the order of the rows in both engines."""
    def cut(name: str, places: int):
        value = quoted(name)
        return value.cast("float").cast("double") if places == SINGLE else F.round(value, places)

    return df.withColumns({c: cut(c, d) for c, d in digits.items() if d is not None})


def round_sql(expression: str, digits: int | None) -> str:
    if digits == SINGLE:
        return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"
    return expression if digits is None else f"round({expression}, {digits})"


# ---- Orders with day, label and score ----

def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with days before the reference date, a label and a score in (0, 1)."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.year("o_orderdate").alias("year"),
        F.datediff("o_orderdate", F.lit(REFERENCE_DATE)).alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / 500000.0).alias("s"),
    )


ORDERS = """(
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
           CAST(year(o_orderdate) AS INT) AS year,
           CAST(date_diff('day', DATE '2001-08-01', CAST(o_orderdate AS DATE)) AS INT) AS day,
           CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
           CAST(o_orderstatus = 'F' AS INT) AS y,
           o_totalprice / CAST(500000 AS DOUBLE) AS s
    FROM orders)"""


def roc_sql(source: str, keys: str, label: str = "y", score: str = "s") -> str:
    """CTEs ``cnt``, ``roc`` and ``best`` with AUC, KS and threshold per key list."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    order = "ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    cnt AS (SELECT {lead}{score} AS score, CAST(sum({label}) AS BIGINT) AS pos, CAST(sum(1 - {label}) AS BIGINT) AS neg
            FROM {source} GROUP BY {lead}{score}),
    roc AS (SELECT *, sum(pos) OVER ({part} {order}) AS cp, sum(neg) OVER ({part} {order}) AS cn,
                   sum(pos) OVER ({part}) AS ap, sum(neg) OVER ({part}) AS an FROM cnt),
    gaps AS (SELECT *, CAST(cp AS DOUBLE) / ap - CAST(cn AS DOUBLE) / an AS gap FROM roc),
    best AS (SELECT {lead}sum(neg * (cp - pos + pos / 2.0)) / (CAST(max(ap) AS DOUBLE) * max(an)) AS auc,
                    greatest(max(gap), 0.0) AS ks,
                    CASE WHEN max(gap) > 0 THEN max_by(score, gap + score * 1e-13) ELSE CAST('Infinity' AS DOUBLE) END AS ks_threshold,
                    max(gap) AS top_gap
             FROM gaps {group})"""


def columns_sql(names: Sequence[str]) -> str:
    return ", ".join(f'"{n}"' for n in names)
