"""Weight of evidence and information value of features against a binary target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numbers import bin_index, finite, numeric_columns, quoted
from driftwell.operators.binning import binned, column_chunks
from driftwell.operators.joins import spread_join
from driftwell.operators.quantiles import exact_quantiles
from driftwell.session import written_table

MISSING_BIN = "Missing"


@dataclass
class InformationValue:
    """Fit on training rows; keeps features with enough information value.

    Numbers are cut at quantiles (right-closed, distinct edges), every text level is a bin, missing values
    are a bin of their own. ``smoothing`` is added to the counts of an empty good or bad cell.
    """

    bins: int = 10
    min_iv: float = 0.02
    leakage_iv: float = 0.5
    smoothing: float = 0.5
    inner_breaks: dict[str, list[float]] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)
    table: DataFrame | None = None
    bin_table: DataFrame | None = None

    def fit(self, df: DataFrame, target: str, columns: Sequence[str]) -> InformationValue:
        numeric = [c for c in numeric_columns(df) if c in set(columns)]
        quantiles = exact_quantiles(df, numeric, [i / self.bins for i in range(self.bins + 1)])
        self.inner_breaks = {c: sorted(set(q))[1:-1] if q else [] for c, q in quantiles.items()}
        # Written once: the values, the flags and the encoding all read it.
        self.bin_table = written_table(self._bins(df.where(F.col(target).isNotNull()), target, list(columns)))
        self.table = information_values(self.bin_table, self.leakage_iv)
        kept = self.table.where(F.col("iv") >= self.min_iv).select("feature", "iv").collect()
        self.selected = [r["feature"] for r in sorted(kept, key=lambda r: (-r["iv"], r["feature"]))]
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[quoted(c) for c in self.selected])

    def encode(self, df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
        """Replace each value by its bin's weight; a level not seen in training becomes 0.

        Number bins are literals. Text levels are as many as the data has, so they are joined, the most frequent of
        training apart from the others.
        """
        if self.bin_table is None:
            raise ValueError("fit first")
        numbers = [c for c in columns if c in self.inner_breaks]
        weights: dict[tuple[str, str], float] = {
            (r["feature"], r["bin"]): r["woe"]
            for r in self.bin_table.where(F.col("feature").isin(numbers)).select("feature", "bin", "woe").collect()
        }
        encoded = {}
        for c in numbers:
            mapping = {b: w for (f, b), w in weights.items() if f == c}
            pairs = [F.lit(x) for item in mapping.items() for x in item]
            encoded[c] = F.coalesce(F.element_at(F.create_map(*pairs), self._bin(c)), F.lit(0.0))
        result = df.select(key, *[encoded.get(c, quoted(c)).alias(c) for c in columns])
        for c in columns:
            if c not in encoded:
                levels = self.bin_table.where(F.col("feature") == c).select(
                    F.col("bin").alias("_bin"), F.col("woe").alias("_woe"), (F.col("good") + F.col("bad")).alias("_rows")
                )
                joined = spread_join(result.withColumn("_bin", self._bin(c)), levels, ["_bin"], "_rows")
                result = joined.withColumn(c, F.coalesce(F.col("_woe"), F.lit(0.0))).select(key, *columns)
        return result

    def _bin(self, column: str) -> Column:
        """Bin label of one column."""
        if column in self.inner_breaks:
            label = bin_index(finite(quoted(column)), self.inner_breaks[column]).cast("string")
        else:
            label = quoted(column).cast("string")
        return F.coalesce(label, F.lit(MISSING_BIN))

    def _bins(self, df: DataFrame, target: str, columns: list[str]) -> DataFrame:
        """Counts per (feature, bin): numbers by binary search, levels as they are."""
        marked = df.withColumn("_bad", F.col(target).cast("long"))
        parts = []
        for chunk in column_chunks([c for c in columns if c in self.inner_breaks]):
            cells = binned(marked, {c: self.inner_breaks[c] for c in chunk}, "_bad")
            counted = cells.groupBy("slot", "bin").agg(*_good_and_bad())
            parts.append(counted.select(
                F.array(*[F.lit(c) for c in chunk])[F.col("slot")].alias("feature"),
                F.coalesce(F.col("bin").cast("string"), F.lit(MISSING_BIN)).alias("bin"), "bad", "good",
            ))
        for chunk in column_chunks([c for c in columns if c not in self.inner_breaks]):
            cells = F.array(*[F.struct(F.lit(c).alias("feature"), self._bin(c).alias("bin")) for c in chunk])
            long = marked.select("_bad", F.explode(cells).alias("cell")).select("_bad", "cell.feature", "cell.bin")
            parts.append(long.groupBy("feature", "bin").agg(*_good_and_bad()))
        counts = parts[0]
        for part in parts[1:]:
            counts = counts.unionByName(part)
        return evidence_bins(counts, self.smoothing)


def _good_and_bad() -> list[Column]:
    return [F.sum("_bad").alias("bad"), F.sum(1 - F.col("_bad")).alias("good")]


def evidence_bins(counts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Shares, weight of evidence and information value per (feature, bin) from good and bad rows."""
    # Totals per feature are summed apart from the bins: a text column may have very many levels.
    totals = counts.groupBy("feature").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    empty = (F.col("good") == 0) | (F.col("bad") == 0)
    add = F.when(empty, F.lit(smoothing)).otherwise(F.lit(0.0))
    good = F.try_divide(F.col("good") + add, F.col("all_good").cast("double"))
    bad = F.try_divide(F.col("bad") + add, F.col("all_bad").cast("double"))
    woe = F.ln(F.try_divide(good, bad))
    # One row per feature.
    return counts.join(F.broadcast(totals), "feature").select(
        "feature",
        "bin",
        "good",
        "bad",
        good.alias("good_share"),
        bad.alias("bad_share"),
        woe.alias("woe"),
        ((good - bad) * woe).alias("iv"),
        empty.alias("pure"),
    )


def information_values(bins: DataFrame, leakage_iv: float = 0.5) -> DataFrame:
    """Information value per feature, with flags for a suspiciously high value or a pure bin."""
    return (
        bins.groupBy("feature")
        .agg(
            F.sum("iv").alias("iv"),
            F.count(F.lit(1)).alias("bins"),
            F.max("pure").alias("pure_bin"),
        )
        .withColumn("high_iv", F.col("iv") >= leakage_iv)
        .withColumn("leakage_flag", F.col("pure_bin") | F.col("high_iv"))
    )
