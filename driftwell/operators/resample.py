"""Bootstrap intervals of Gini and KS for stored predictions.

Rows are counted per distinct score and split into score buckets; each task draws Poisson weights for all
replicates of its bucket. Two passes share the draws through their seed: the first gives every bucket's
totals per replicate, the second turns totals of the buckets above into exact running totals. Rows are
never copied per replicate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.numbers import share
from driftwell.operators.ordering import bucket_edges, with_bucket
from driftwell.operators.scoring import score_counts

ROWS_PER_TASK = 20_000
ROWS_PER_DRAW = 4_096


def _weights(pdf: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Poisson weights (replicate x score) of the positives and negatives, a slice of scores at a time.

    The generator depends only on the seed, the bucket and the slice, so a re-run task draws the same.
    """
    bucket = int(pdf["bucket"].iloc[0])
    pos, neg = pdf["pos"].to_numpy(), pdf["neg"].to_numpy()
    for start in range(0, len(pdf), ROWS_PER_DRAW):
        draw = np.random.default_rng([seed, bucket, start])
        part = slice(start, start + ROWS_PER_DRAW)
        shape = (replicates, len(pos[part]))
        yield draw.poisson(pos[part], shape), draw.poisson(neg[part], shape)


def bootstrap_replicates(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    replicates: int = 500,
    seed: int = 42,
    rows_per_bucket: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, replicate, gini, ks); replicates with a single class are left out."""
    edges = bucket_edges(df, [score], rows_per_bucket)[score]
    counts = with_bucket(score_counts(df, label, score, keys), "score", edges, "bucket").withColumns(
        {"bucket": F.col("bucket").cast("int"), "score": F.col("score").cast("double")}
    )
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in keys]
    key_names = list(keys)

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values("score", ascending=False, kind="stable")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        pos, neg = np.zeros(replicates, dtype=np.int64), np.zeros(replicates, dtype=np.int64)
        for p, n in _weights(pdf, replicates, seed):
            pos += p.sum(axis=1)
            neg += n.sum(axis=1)
        return pd.DataFrame({
            **{k: pdf[k].iloc[0] for k in key_names},
            "bucket": int(pdf["bucket"].iloc[0]),
            "replicate": np.arange(replicates),
            "pos": pos,
            "neg": neg,
        })

    sums = counts.groupBy(*keys, "bucket").applyInPandas(
        totals, ", ".join([*key_fields, "bucket int", "replicate long", "pos long", "neg long"])
    )
    above = Window.partitionBy(*keys, "replicate").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "replicate")
    starts = sums.select(
        *keys,
        "bucket",
        "replicate",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    )

    def pieces(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, start = ordered(pdf), start.sort_values("replicate")
        p_seen, n_seen = start["pos_above"].to_numpy(), start["neg_above"].to_numpy()
        p_all = np.maximum(start["all_pos"].to_numpy(), 1)[:, None]
        n_all = np.maximum(start["all_neg"].to_numpy(), 1)[:, None]
        wins, gap = np.zeros(replicates), np.zeros(replicates)
        for p, n in _weights(pdf, replicates, seed):
            cum_p = p_seen[:, None] + np.cumsum(p, axis=1)
            cum_n = n_seen[:, None] + np.cumsum(n, axis=1)
            wins += (n * (cum_p - p / 2.0)).sum(axis=1)
            gap = np.maximum(gap, (cum_p / p_all - cum_n / n_all).max(axis=1))
            p_seen, n_seen = cum_p[:, -1], cum_n[:, -1]
        return pd.DataFrame({
            **{k: pdf[k].iloc[0] for k in key_names},
            "replicate": np.arange(replicates),
            "wins": wins,
            "gap": gap,
            "all_pos": start["all_pos"].to_numpy(),
            "all_neg": start["all_neg"].to_numpy(),
        })

    by = [*keys, "bucket"]
    parts = counts.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(
        pieces,
        ", ".join([*key_fields, "replicate long", "wins double", "gap double", "all_pos long", "all_neg long"]),
    )
    return (
        parts.groupBy(*keys, "replicate")
        .agg(
            F.sum("wins").alias("wins"),
            F.max("gap").alias("gap"),
            F.max("all_pos").alias("p"),
            F.max("all_neg").alias("n"),
        )
        .where((F.col("p") > 0) & (F.col("n") > 0))
        .select(
            *keys,
            "replicate",
            (2 * share(F.col("wins"), F.col("p").cast("double") * F.col("n")) - 1).alias("gini"),
            F.greatest(F.col("gap"), F.lit(0.0)).alias("ks"),
        )
    )


def bootstrap_interval(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """2.5 % and 97.5 % points of the replicates' Gini and KS, one row per group."""
    drawn = bootstrap_replicates(df, label, score, keys, **options)
    # At most one value per replicate and group: an exact percentile is bounded.
    return drawn.groupBy(*keys).agg(*[
        F.percentile(metric, F.lit(p)).alias(f"oot_{metric}_ci_{side}")
        for metric in ("gini", "ks")
        for side, p in (("lower", 0.025), ("upper", 0.975))
    ])
