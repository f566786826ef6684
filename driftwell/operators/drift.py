"""Population stability: how far a column moved between a reference and a comparison table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.labels import drift_level, psi_flag
from driftwell.operators.binning import binned, column_chunks
from driftwell.operators.quantiles import exact_quantiles

PSI_BINS = 10
PSI_EPSILON = 1e-6


def psi_breaks(reference: DataFrame, columns: Sequence[str], bins: int = PSI_BINS) -> dict[str, list[float]]:
    """Distinct quantiles of the reference per column; empty for a column without values."""
    found = exact_quantiles(reference, columns, [i / bins for i in range(bins + 1)])
    return {c: sorted(set(q)) if q else [] for c, q in found.items()}


def bin_counts(df: DataFrame, breaks: dict[str, list[float]], *keep: str) -> DataFrame:
    """Rows per (kept columns, feature, bin), missing values left out.

    The outer bins are open, so values beyond the reference range are counted. Each task reduces its rows
    to one count per bin before the shuffle.
    """
    made = None
    for chunk in column_chunks([c for c, b in breaks.items() if len(b) >= 2]):
        counted = (
            binned(df, {c: breaks[c][1:-1] for c in chunk}, *keep)
            .where(F.col("bin").isNotNull())
            .groupBy(*keep, "slot", "bin")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        named = counted.withColumn("feature", F.array(*[F.lit(c) for c in chunk])[F.col("slot")]).drop("slot")
        made = named if made is None else made.unionByName(named)
    if made is None:
        empty = {"feature": F.lit(None).cast("string"), "bin": F.lit(None).cast("int"), "rows": F.lit(0).cast("long")}
        return df.select(*keep).limit(0).withColumns(empty)
    return made


def psi_from_counts(counts: DataFrame, keys: Sequence[str] = ("feature",), epsilon: float = PSI_EPSILON) -> DataFrame:
    """PSI per key from ``expected`` and ``actual`` rows per bin; NULL when one side has no rows."""
    side = Window.partitionBy(*keys)
    e = F.try_divide(F.col("expected").cast("double"), F.sum("expected").over(side).cast("double"))
    a = F.try_divide(F.col("actual").cast("double"), F.sum("actual").over(side).cast("double"))
    return (
        counts.withColumns({"e": e, "a": a})
        .groupBy(*keys)
        .agg(F.sum((F.col("e") - F.col("a")) * F.ln((F.col("e") + epsilon) / (F.col("a") + epsilon))).alias("psi"))
    )


def feature_psi(
    reference: DataFrame,
    comparison: DataFrame,
    columns: Sequence[str],
    bins: int = PSI_BINS,
    breaks: dict[str, list[float]] | None = None,
) -> DataFrame:
    """(feature, psi) of every column. Breaks may be given to compare against stored ones."""
    breaks = psi_breaks(reference, columns, bins) if breaks is None else breaks
    both = bin_counts(reference, breaks).withColumn("side", F.lit("e")).unionByName(
        bin_counts(comparison, breaks).withColumn("side", F.lit("a"))
    )
    counts = both.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == "e", F.col("rows")).otherwise(0)).alias("expected"),
        F.sum(F.when(F.col("side") == "a", F.col("rows")).otherwise(0)).alias("actual"),
    )
    names = reference.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    # Feature-count sized on both sides.
    return names.join(psi_from_counts(counts), "feature", "left")


def score_psi(reference: DataFrame, comparison: DataFrame, score: str, bins: int = PSI_BINS) -> float | None:
    """PSI of one score column."""
    return feature_psi(reference, comparison, [score], bins).first()["psi"]


def flagged_psi(psi: DataFrame) -> DataFrame:
    return psi.withColumn("psi_flag", psi_flag(F.col("psi")))


def selected_feature_psi(reference: DataFrame, comparison: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_name, psi, drift_level), largest drift first."""
    return (
        feature_psi(reference, comparison, columns)
        .select(F.col("feature").alias("feature_name"), "psi", drift_level(F.col("psi")).alias("drift_level"))
        .orderBy(F.col("psi").desc_nulls_last(), "feature_name")
    )


def psi_summary(psi: DataFrame) -> DataFrame:
    """One row: mean, maximum, median and the shares of drifted features; missing PSI counts as not drifted."""
    def drifted(limit: float) -> Column:
        return F.avg(F.coalesce((F.col("psi") >= limit).cast("double"), F.lit(0.0)))

    return psi.agg(
        F.avg("psi").alias("selected_feature_psi_mean"),
        F.max("psi").alias("selected_feature_psi_max"),
        F.percentile("psi", F.lit(0.5)).alias("selected_feature_psi_median"),
        drifted(0.25).alias("selected_feature_psi_high_drift_ratio"),
        drifted(0.1).alias("selected_feature_psi_moderate_or_high_drift_ratio"),
    )
