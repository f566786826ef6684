"""Column expressions on numbers. NULL is the only missing marker."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: added to every ratio's denominator.
RATIO_EPSILON = 1e-6

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    """Names of number columns in schema order; booleans are not numbers."""
    skipped = set(skip)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS) and f.name not in skipped]


def string_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skipped = set(skip)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skipped]


def sql_name(name: str) -> str:
    """Whole column name for SQL text, so that dots and blanks in encoded names are safe."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(sql_name(name))


def finite(value: Column) -> Column:
    """NaN and infinities become NULL; the result is a double."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(math.inf)), number)


def finite_sql(name: str) -> str:
    """``finite`` of a column as SQL text.

    Hundreds of columns are built far faster from text: every step of a Column costs a call to the JVM.
    """
    number = f"CAST({sql_name(name)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({number}) AND abs({number}) <> DOUBLE('Infinity') THEN {number} END"


def double_sql(value: float) -> str:
    """A double literal that reads back as the same number."""
    return f"({float(value)!r}D)"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Drop NaN in every float column: it would sort last and poison ``max`` and ``avg``."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}) if floats else df


def finite_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every float column, which keeps its type."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    kept = {c: F.when(~F.isnan(quoted(c)) & (F.abs(quoted(c)) != F.lit(math.inf)), quoted(c)) for c in floats}
    return df.withColumns(kept) if floats else df


def to_number(value: Column) -> Column:
    """Number held in text, NULL where there is none."""
    return finite(value.try_cast("double"))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / (bottom + epsilon)``; a zero denominator gives NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double") + F.lit(RATIO_EPSILON))


def share(top: Column, bottom: Column) -> Column:
    """Plain ratio, NULL when the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def positive_flag(value: Column) -> Column:
    """1 for a value above zero, else 0; missing counts as 0."""
    return F.coalesce((value > 0).cast("int"), F.lit(0))


def months_to_days(months: Column) -> Column:
    return months * 30


def latest(*days: Column) -> Column:
    """Row-wise maximum that skips missing values."""
    cleaned = [finite(d) for d in days]
    return cleaned[0] if len(cleaned) == 1 else F.greatest(*cleaned)


def bin_index(value: Column, inner_breaks: Sequence[float]) -> Column:
    """Number of breaks strictly below ``value``: the index of its right-closed bin."""
    if not inner_breaks:
        return F.when(value.isNotNull(), F.lit(0))
    return sum(((value > F.lit(float(b))).cast("int") for b in inner_breaks[1:]),
               (value > F.lit(float(inner_breaks[0]))).cast("int"))
