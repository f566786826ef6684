"""Train-only imputation, scaling and one-hot encoding, applied as plain column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.numbers import double_sql, finite_sql, numeric_columns, sql_name, string_columns
from driftwell.operators.binning import column_moments
from driftwell.operators.levels import LevelEncoder
from driftwell.operators.quantiles import exact_quantiles


@dataclass
class NumberScaler:
    """Fill missing numbers from the training rows, then scale.

    ``standard`` uses the population deviation; a constant column is only centred. The moments of the
    filled column follow from those of the seen values, so fitting takes one aggregation.
    """

    strategy: str = "mean"
    scaler: str | None = "standard"
    columns: list[str] = field(default_factory=list)
    fills: dict[str, float] = field(default_factory=dict)
    shifts: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> NumberScaler:
        if self.strategy not in ("mean", "median", "zero"):
            raise ValueError(f"unsupported strategy: {self.strategy}")
        self.columns = list(numeric_columns(df) if columns is None else columns)
        medians = exact_quantiles(df, self.columns, [0.5]) if self.strategy == "median" else {}
        if not self.columns:
            return self
        statistics = ["rows", "count", "mean", "variance", "min", "max"]
        for row in column_moments(df, self.columns, statistics).collect():
            self._learn(row, medians)
        return self

    def _learn(self, row: Row, medians: dict) -> None:
        c, rows, n = row["feature"], row["rows"], row["count"]
        mean, variance, low, high = row["mean"] or 0.0, row["variance"] or 0.0, row["min"], row["max"]
        if self.strategy == "mean":
            fill = mean
        elif self.strategy == "median":
            fill = (medians.get(c) or [0.0])[0]
        else:
            fill = 0.0
        self.fills[c] = fill
        part = n / rows if rows else 0.0
        lows = [v for v in (low, fill if n < rows else None) if v is not None]
        highs = [v for v in (high, fill if n < rows else None) if v is not None]
        if self.scaler == "standard":
            self.shifts[c] = part * mean + (1 - part) * fill
            spread = part * variance + part * (1 - part) * (mean - fill) ** 2
            constant = bool(lows) and min(lows) == max(highs)
            self.scales[c] = 1.0 if constant or spread <= 0.0 else spread ** 0.5
        elif self.scaler == "minmax":
            self.shifts[c] = min(lows) if lows else 0.0
            width = (max(highs) - min(lows)) if lows else 0.0
            self.scales[c] = width if width > 0 else 1.0
        else:
            self.shifts[c], self.scales[c] = 0.0, 1.0

    def expressions(self) -> list[Column]:
        made = []
        for c in self.columns:
            value = f"coalesce({finite_sql(c)}, {double_sql(self.fills[c])})"
            if self.scaler in ("standard", "minmax"):
                value = f"({value} - {double_sql(self.shifts[c])}) / {double_sql(self.scales[c])}"
            made.append(F.expr(f"{value} AS {sql_name(c)}"))
        return made


@dataclass
class Preprocessor:
    """Scaled numbers followed by encoded levels, in one projection."""

    strategy: str = "mean"
    scaler: str | None = "standard"
    missing: str = "Missing"
    min_frequency: int | float | None = 10
    numbers: NumberScaler | None = None
    levels: LevelEncoder | None = None

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> Preprocessor:
        wanted = set(df.columns if columns is None else columns)
        self.numbers = NumberScaler(self.strategy, self.scaler).fit(
            df, [c for c in numeric_columns(df) if c in wanted]
        )
        self.levels = LevelEncoder(self.missing, self.min_frequency).fit(
            df, [c for c in string_columns(df) if c in wanted]
        )
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """A column for each number and each frequent level."""
        return self.levels.attach(df).select(*keep, *self.numbers.expressions(), *self.levels.expressions())

    def transform_sparse(self, df: DataFrame, *keep: str) -> DataFrame:
        """``indices`` and ``values`` of what is not zero, in the order of ``output_columns``: for very many levels."""
        attached = self.levels.attach(df)
        scaled = F.array(*self.numbers.expressions()) if self.numbers.columns else F.array().cast("array<double>")
        numbered = F.transform(scaled, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
        cells = F.filter(numbered, lambda x: x["v"] != 0)
        ones = self.levels.indices(len(self.numbers.columns))
        return attached.select(
            *keep,
            F.concat(F.transform(cells, lambda x: x["i"]), ones).alias("indices"),
            F.concat(F.transform(cells, lambda x: x["v"]), F.transform(ones, lambda _: F.lit(1.0))).alias("values"),
        )

    def output_columns(self) -> list[str]:
        return [*self.numbers.columns, *self.levels.output_columns()]

    def settings(self) -> dict:
        """What was learned as plain values, but for the dictionary of levels (see ``save``)."""
        return {
            "strategy": self.strategy, "scaler": self.scaler, "missing": self.missing,
            "min_frequency": self.min_frequency,
            "number_columns": self.numbers.columns, "fills": self.numbers.fills,
            "shifts": self.numbers.shifts, "scales": self.numbers.scales, "levels": self.levels.settings(),
        }

    @classmethod
    def from_settings(cls, saved: dict, levels: DataFrame | None = None) -> Preprocessor:
        made = cls(saved["strategy"], saved["scaler"], saved["missing"], saved["min_frequency"])
        made.numbers = NumberScaler(
            saved["strategy"], saved["scaler"], saved["number_columns"], saved["fills"], saved["shifts"], saved["scales"]
        )
        made.levels = LevelEncoder.from_settings(saved["missing"], saved["min_frequency"], saved["levels"], levels)
        return made

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings as one row of text and the dictionary as a table, under ``path``."""
        text = json.dumps(self.settings(), sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        self.levels.save(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        saved = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()["value"])
        levels = LevelEncoder.load_table(spark, f"{path}/levels") if saved["levels"]["columns"] else None
        return cls.from_settings(saved, levels)
