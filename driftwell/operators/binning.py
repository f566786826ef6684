"""Bin numbers of many columns at once.

Comparisons spelled out per break make generated code too large for the JIT on wide tables, so values are
binned by binary search inside the JVM and everything is counted in the long form, where the code does not
grow with the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.numbers import NUMBERS, finite_sql, sql_name

# Sketches and binary searches keep state per column in every task; wider tables take several passes, each
# of which reads only its own columns. Plain moments are small and go further in one pass.
COLUMNS_PER_PASS = 96
MOMENTS_PER_PASS = 512
# Up to this many columns one aggregate row is about twice as fast as the long form; beyond it the generated
# code is too large for the JIT.
NARROW = 12


def column_chunks(columns: Sequence[str], size: int = COLUMNS_PER_PASS) -> list[list[str]]:
    return [list(columns[i:i + size]) for i in range(0, len(columns), size)]


def long_form(df: DataFrame, columns: Sequence[str], *keep: str | Column) -> DataFrame:
    """One row per (row, column): ``slot`` is the column's position, ``value`` its finite value or NULL."""
    cells = ", ".join(finite_sql(c) for c in columns)
    return df.select(*keep, F.expr(f"posexplode(array({cells}))").alias("slot", "value"))


def bucketed(df: DataFrame, splits: Sequence[Sequence[float]], *keep: str | Column) -> DataFrame:
    """Columns ``v0..`` plus ``b0..``: the number of splits at or below each value, NULL for a missing one."""
    cut = [i for i, s in enumerate(splits) if s]
    values = [f"v{i}" for i in range(len(splits))]
    made = df.select(*keep, *values)
    if cut:
        made = Bucketizer(
            inputCols=[f"v{i}" for i in cut],
            outputCols=[f"raw{i}" for i in cut],
            splitsArray=[[-math.inf, *splits[i], math.inf] for i in cut],
            handleInvalid="keep",
        ).transform(made)
    whole = set(cut)
    numbers = [
        F.expr(f"CASE WHEN {v} IS NOT NULL THEN {f'CAST(raw{i} AS INT)' if i in whole else '0'} END AS b{i}")
        for i, v in enumerate(values)
    ]
    return made.select(*keep, *values, *numbers)


def values_as_numbered(df: DataFrame, columns: Sequence[str], *keep: str | Column) -> DataFrame:
    """Finite values as ``v0..``, so that any column name works downstream."""
    return df.select(*keep, *[F.expr(f"{finite_sql(c)} AS v{i}") for i, c in enumerate(columns)])


def above(breaks: Sequence[float]) -> list[float]:
    """Splits that count the breaks strictly below a value: right-closed bins."""
    return sorted({math.nextafter(float(b), math.inf) for b in breaks})


def binned(df: DataFrame, inner_breaks: Mapping[str, Sequence[float]], *keep: str) -> DataFrame:
    """(kept columns, slot, bin) per row and column; the bin is NULL for a missing value."""
    columns = list(inner_breaks)
    numbered = values_as_numbered(df, columns, *keep)
    cut = bucketed(numbered, [above(inner_breaks[c]) for c in columns], *keep)
    cells = ", ".join(f"b{i}" for i in range(len(columns)))
    return cut.select(*keep, F.expr(f"posexplode(array({cells}))").alias("slot", "bin"))


# Statistics of a column: {v} is its finite value, {m} is 1 where it is missing.
MOMENTS = {
    "rows": "count(1)", "missing_count": "sum({m})", "count": "count({v})", "mean": "avg({v})", "min": "min({v})",
    "max": "max({v})", "std": "stddev_samp({v})", "var": "var_samp({v})", "variance": "var_pop({v})",
}


def missing_sql(df: DataFrame, column: str) -> str:
    """SQL test for a missing value; only floats can be NaN."""
    value = sql_name(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return f"({value} IS NULL OR isnan({value}))"
    return f"({value} IS NULL)"


def column_moments(df: DataFrame, columns: Sequence[str], statistics: Sequence[str]) -> DataFrame:
    """(feature, statistics) of any columns in one pass per chunk; columns that are no numbers have no moments."""
    if not columns:
        raise ValueError("no columns to describe")
    made = None
    for chunk in column_chunks(columns, MOMENTS_PER_PASS):
        numeric = [isinstance(df.schema[c].dataType, NUMBERS) for c in chunk]
        values = [finite_sql(c) if n else "CAST(NULL AS DOUBLE)" for c, n in zip(chunk, numeric)]
        gaps = [f"CAST({missing_sql(df, c)} AS INT)" for c in chunk]
        part = (_narrow if len(chunk) <= NARROW else _long)(df, chunk, values, gaps, statistics)
        made = part if made is None else made.unionByName(part)
    return made


def _narrow(df: DataFrame, columns: list[str], values: list[str], gaps: list[str], statistics: Sequence[str]) -> DataFrame:
    staged = df.select(
        *[F.expr(f"{v} AS v{i}") for i, v in enumerate(values)], *[F.expr(f"{m} AS m{i}") for i, m in enumerate(gaps)]
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), *[F.expr(MOMENTS[s].format(v=f"v{i}", m=f"m{i}")).alias(s) for s in statistics])
        for i, c in enumerate(columns)
    ]
    return staged.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _long(df: DataFrame, columns: list[str], values: list[str], gaps: list[str], statistics: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"named_struct('value', {v}, 'missing', {m})" for v, m in zip(values, gaps))
    long = df.select(F.expr(f"posexplode(array({cells}))").alias("slot", "cell")).select("slot", "cell.*")
    found = long.groupBy("slot").agg(*[F.expr(MOMENTS[s].format(v="value", m="missing")).alias(s) for s in statistics])
    return found.select(F.array(*[F.lit(c) for c in columns])[F.col("slot")].alias("feature"), *statistics)
