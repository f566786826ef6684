"""Text levels as a stored dictionary with codes: one-hot encoding that does not depend on how many levels there are.

Levels are counted once and written as a table (feature, level, rows, code). The frequent levels of a feature are
numbered from 0 in their order, its rare ones share the next number. Levels that hold a large share of the rows, of which
there can only be a few, are spelled out in the expression; rows with another level look their code up in the dictionary.
Rows with a spelled-out level get a join key of their own that meets nothing, so no hot key travels to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.numbers import quoted, string_columns
from driftwell.operators.ordering import dense_numbers
from driftwell.session import small_side, written_table

# Levels with at least this share of the rows are spelled out, and all levels of features that have no more than
# SPELLED of them: at most twice that many for a feature.
SPELLED = 64
# Keys without a partner are dealt over so many values.
STRAYS = 1 << 20


@dataclass
class LevelEncoder:
    """One-hot encoding with rare levels pooled.

    ``min_frequency`` is a row count, or a share of the rows when it is a fraction. Levels not seen in training encode as
    all zeros. There is no bound on the number of levels: ``expressions`` makes a column for each frequent one, ``sparse``
    an index.
    """

    missing: str = "Missing"
    min_frequency: int | float | None = 10
    spelled_out: int = SPELLED
    columns: list[str] = field(default_factory=list)
    # Per column: how many frequent and how many rare levels there are.
    sizes: dict[str, tuple[int, int]] = field(default_factory=dict)
    # Per column: code of the levels that are spelled out.
    spelled: dict[str, dict[str, int]] = field(default_factory=dict)
    table: DataFrame | None = None
    _names: dict[str, list[str]] = field(default_factory=dict, repr=False)
    _lookups: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> LevelEncoder:
        self.columns = list(string_columns(df) if columns is None else columns)
        self.sizes, self.spelled, self._names, self._lookups = {}, {}, {}, {}
        if not self.columns:
            return self
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), self._text(c).alias("level")) for c in self.columns])
        counted = written_table(
            df.select(F.explode(cells).alias("cell")).groupBy("cell.feature", "cell.level").agg(F.count(F.lit(1)).alias("rows"))
        )
        # Every row has one level of each column.
        totals = counted.groupBy("feature").agg(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("levels")).collect()
        total = totals[0]["total"] if totals else 0
        limit = self.min_frequency * total if isinstance(self.min_frequency, float) else self.min_frequency or 0
        frequent = F.col("rows") >= F.lit(limit)
        numbered = written_table(dense_numbers(counted.where(frequent), ["feature", "level"], "place"))
        firsts = {r["feature"]: r for r in numbered.groupBy("feature").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
        levels = {r["feature"]: r["levels"] for r in totals}
        for c in self.columns:
            own = firsts[c]["n"] if c in firsts else 0
            self.sizes[c] = own, levels.get(c, 0) - own
        by_name = lambda values: _choice(F.col("feature"), values)
        coded = numbered.select(
            "feature", "level", "rows", (F.col("place") - by_name({c: r["first"] for c, r in firsts.items()})).cast("int").alias("code")
        ) if firsts else None
        rare = counted.where(~frequent).select("feature", "level", "rows", by_name({c: n for c, (n, _) in self.sizes.items()}).cast("int").alias("code"))
        self.table = written_table(rare if coded is None else coded.unionByName(rare))
        few = [c for c in self.columns if levels.get(c, 0) <= self.spelled_out]
        shown = self.table.where((F.col("rows") * self.spelled_out >= F.lit(total)) | F.col("feature").isin(few)).collect()
        for c in self.columns:
            self.spelled[c] = {r["level"]: r["code"] for r in sorted(shown, key=lambda r: (r["code"], r["level"])) if r["feature"] == c}
        return self

    def _text(self, column: str) -> Column:
        return F.coalesce(quoted(column).cast("string"), F.lit(self.missing))

    def _whole(self, column: str) -> bool:
        """All levels of the column are spelled out."""
        return len(self.spelled[column]) == sum(self.sizes[column])

    def _lookup(self, column: str) -> DataFrame:
        if column not in self._lookups:
            if self.table is None:
                raise ValueError(f"the level dictionary of {column} is not loaded")
            others = self.table.where((F.col("feature") == column) & ~F.col("level").isin(list(self.spelled[column])))
            self._lookups[column] = small_side(others.select(F.concat(F.lit("l"), F.col("level")).alias("_key"), F.col("code").alias("_found")))
        return self._lookups[column]

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_code0`` and so on: the level's code per column, NULL for a level not seen in training."""
        for i, c in enumerate(self.columns):
            text, name = self._text(c), f"_code{i}"
            known = _choice(text, self.spelled[c]).cast("int")
            if self._whole(c):
                df = df.withColumn(name, known)
                continue
            stray = F.concat(F.lit("x"), (F.monotonically_increasing_id() % STRAYS).cast("string"))
            keyed = df.withColumn(name, known).withColumn("_key", F.when(F.col(name).isNull(), F.concat(F.lit("l"), text)).otherwise(stray))
            df = keyed.join(self._lookup(c), "_key", "left").withColumn(name, F.coalesce(name, "_found")).drop("_key", "_found")
        return df

    def pools(self, column: str) -> bool:
        return self.sizes[column][1] > 0

    def width(self, column: str) -> int:
        return self.sizes[column][0] + self.pools(column)

    def levels(self, column: str) -> list[str]:
        """Names of the frequent levels by code: as many as the encoded table has columns."""
        if column not in self._names:
            own = self.sizes[column][0]
            if self._whole(column):
                self._names[column] = [v for v, code in self.spelled[column].items() if code < own]
            else:
                rows = self.table.where((F.col("feature") == column) & (F.col("code") < own)).select("code", "level").collect()
                self._names[column] = [r["level"] for r in sorted(rows)]
        return self._names[column]

    def output_columns(self) -> list[str]:
        # Fixed value: suffix of the pooled column.
        return [name for c in self.columns for name in [f"{c}_{v}" for v in self.levels(c)] + [f"{c}_infrequent_sklearn"] * self.pools(c)]

    def expressions(self) -> list[Column]:
        """One column of 0 and 1 for each frequent level and the pooled ones, over what ``attach`` added."""
        made, names = [], iter(self.output_columns())
        for i, c in enumerate(self.columns):
            for code in range(self.width(c)):
                made.append(F.when(F.col(f"_code{i}") == code, 1.0).otherwise(0.0).alias(next(names)))
        return made

    def indices(self, first: int = 0) -> Column:
        """The places of the ones, over what ``attach`` added: an array, whatever the number of levels."""
        cells = []
        for i, c in enumerate(self.columns):
            cells.append(F.col(f"_code{i}") + F.lit(first))
            first += self.width(c)
        return F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<int>")

    def settings(self) -> dict:
        """What was learned but for the dictionary table, as plain values."""
        return {"columns": self.columns, "sizes": self.sizes, "spelled": self.spelled, "spelled_out": self.spelled_out}

    @classmethod
    def from_settings(cls, missing: str, min_frequency: int | float | None, saved: dict, table: DataFrame | None = None) -> LevelEncoder:
        """``table`` is the saved dictionary; columns whose levels are all spelled out do without."""
        sizes = {c: tuple(n) for c, n in saved["sizes"].items()}
        return cls(missing, min_frequency, saved["spelled_out"], saved["columns"], sizes, saved["spelled"], table)

    def save(self, path: str) -> None:
        if self.table is not None:
            self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load_table(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("feature string, level string, rows long, code int").parquet(path)


def _choice(value: Column, answers: dict) -> Column:
    """The answer that belongs to ``value``, else NULL."""
    if not answers:
        return F.lit(None)
    pairs = [x for name, answer in answers.items() for x in (F.lit(name), F.lit(answer))]
    return F.try_element_at(F.create_map(*pairs), value)
