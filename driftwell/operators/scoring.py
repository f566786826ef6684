"""Exact ranking and threshold metrics of a binary score, per group.

Rows are first counted per distinct score, so everything order-dependent works on that table with bucketed
running totals (see ``ordering``). Nothing is binned: ties count one half, and KS looks at every score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.numbers import share
from driftwell.operators.ordering import ROWS_PER_BUCKET, bucket_edges, running_totals
from driftwell.session import single_row, small_side

# Machine epsilon of a double: scores are kept this far from 0 and 1 in the log loss.
LOG_LOSS_MARGIN = 2.220446049250313e-16

TRACKED_INTERVALS = ("gini", "ks", "psi_feature_mean", "psi_feature_max", "psi_model", "jaccard_similarity")
NORMAL_95 = 1.96


def score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """``pos`` and ``neg`` rows per distinct score."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )


def roc_table(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Score counts with running totals from the highest score down."""
    edges = bucket_edges(df, [score], rows_per_bucket)[score]
    return running_totals(score_counts(df, label, score, keys), keys, "score", ["pos", "neg"], edges, descending=True)


def roc_summary(roc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini, KS and the KS threshold per group, from a ``roc_table``.

    Among equal separations the highest score wins; with no separation above zero the threshold is
    infinite, so that nothing is flagged. AUC, Gini and KS are NULL when a class is absent.
    """
    gap = share(F.col("cum_pos"), F.col("all_pos")) - share(F.col("cum_neg"), F.col("all_neg"))
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)
    best = roc.groupBy(*keys).agg(
        F.sum(wins).alias("wins"),
        F.max("all_pos").alias("positives"),
        F.max("all_neg").alias("negatives"),
        F.max(F.struct(gap.alias("gap"), F.col("score").cast("double").alias("score"))).alias("best"),
    )
    # As doubles: the product of two row counts leaves the range of a long.
    auc = share(F.col("wins"), F.col("positives").cast("double") * F.col("negatives"))
    separated = F.col("best.gap") > 0
    return best.select(
        *keys,
        "positives",
        "negatives",
        auc.alias("auc"),
        (2 * auc - 1).alias("gini"),
        F.when(F.col("best.gap").isNotNull(), F.greatest(F.col("best.gap"), F.lit(0.0))).alias("ks"),
        F.when(separated, F.col("best.score"))
        .when(F.col("best.gap").isNotNull(), F.lit(math.inf))
        .alias("ks_threshold"),
    )


def roc_metrics(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return roc_summary(roc_table(df, label, score, keys), keys)


def decision_threshold(df: DataFrame, label: str, score: str, strategy: str = "ks") -> float:
    """Threshold chosen on training rows."""
    if strategy != "ks":
        raise ValueError(f"unsupported threshold strategy: {strategy}")
    return float(roc_metrics(df, label, score).first()["ks_threshold"])


def flag_at(score: Column, threshold: float | Column) -> Column:
    return (score >= threshold).cast("int")


def _counts(label: Column, flag: Column) -> dict[str, Column]:
    return {
        "tn": F.count_if((label == 0) & (flag == 0)),
        "fp": F.count_if((label == 0) & (flag == 1)),
        "fn": F.count_if((label == 1) & (flag == 0)),
        "tp": F.count_if((label == 1) & (flag == 1)),
    }


def _ratios() -> dict[str, Column]:
    """Ratios of the confusion counts; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(share(top, bottom), F.lit(0.0))

    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "approval_rate": ratio(tn + fn, tn + fp + fn + tp),
        "bad_rate_approved": ratio(fn, tn + fn),
    }


def confusion_metrics(df: DataFrame, label: str, flag: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, approval rate and bad rate among the approved."""
    counted = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(F.col(label), flag).items()])
    return counted.withColumns(_ratios())


def probability_losses(label: str, score: str) -> dict[str, Column]:
    """Aggregates for log loss and Brier score."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    kept = F.least(F.greatest(p, F.lit(LOG_LOSS_MARGIN)), F.lit(1.0 - LOG_LOSS_MARGIN))
    return {
        "log_loss": F.avg(-(y * F.ln(kept) + (1.0 - y) * F.ln(1.0 - kept))),
        "brier": F.avg((p - y) * (p - y)),
    }


def evaluate(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float | None = None,
    flag: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every metric of a score, one row per group.

    Flags come from ``flag``, else from ``threshold``, else from each group's own KS threshold. All of it
    is computed from the per-score counts; the raw rows are shuffled once.
    """
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    flags = [] if flag is None else [flag]
    edges = bucket_edges(scored, [score])[score]
    # Counts are split by the given flag as well, and merged again for the order-dependent part.
    counts = scored.groupBy(*keys, F.col(score).cast("double").alias("score"), *flags).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    merged = counts if flag is None else counts.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    summary = small_side(
        roc_summary(running_totals(merged, keys, "score", ["pos", "neg"], edges, descending=True), keys)
    )
    joined, mark = counts, None
    if flag is not None:
        mark = F.col(flag)
    elif threshold is not None:
        mark = flag_at(F.col("score"), F.lit(float(threshold)))
    elif keys:
        joined = counts.join(summary.select(*keys, "ks_threshold"), list(keys))
        mark = flag_at(F.col("score"), F.col("ks_threshold"))
    else:
        mark = flag_at(F.col("score"), summary.select("ks_threshold").scalar())
    kept = F.least(F.greatest(F.col("score"), F.lit(LOG_LOSS_MARGIN)), F.lit(1.0 - LOG_LOSS_MARGIN))
    rows = F.sum(F.col("pos") + F.col("neg"))
    thresholded = (
        joined.withColumn("mark", mark)
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("mark") == 0, F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(F.col("mark") == 1, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("mark") == 0, F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("mark") == 1, F.col("pos")).otherwise(0)).alias("tp"),
            (-F.sum(F.col("pos") * F.ln(kept) + F.col("neg") * F.ln(1.0 - kept)) / rows).alias("log_loss"),
            (
                F.sum(F.col("pos") * (1.0 - F.col("score")) * (1.0 - F.col("score"))
                      + F.col("neg") * F.col("score") * F.col("score")) / rows
            ).alias("brier"),
        )
        .withColumns(_ratios())
    )
    if keys:
        result = thresholded.join(summary, list(keys))
    else:
        result = single_row(summary, thresholded)
    if flag is not None:
        used = F.lit(None).cast("double")
    else:
        used = F.lit(float(threshold)) if threshold is not None else F.col("ks_threshold")
    return result.withColumn("decision_threshold", used).drop("positives", "negatives")


def lift_and_capture(
    df: DataFrame,
    label: str,
    score: str,
    key: str,
    fractions: Sequence[float] = (0.1, 0.2),
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Lift and share of positives caught in the top fractions, one row per group.

    The top holds ``max(1, ceil(n * fraction))`` rows; rows with equal scores are taken by ascending
    ``key``. Only the rows whose score equals a cut are ordered by key, bucket by bucket.
    """
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    edges = bucket_edges(scored, [score, key], rows_per_bucket)
    roc = running_totals(score_counts(scored, label, score, keys), keys, "score", ["pos", "neg"], edges[score], True)
    upto = F.col("cum_pos") + F.col("cum_neg")
    before = upto - F.col("pos") - F.col("neg")
    cuts = small_side(
        roc.withColumn("cut", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil((F.col("all_pos") + F.col("all_neg")) * F.lit(f))).alias("n_top"))
            for i, f in enumerate(fractions)
        ])))
        .where((F.col("cut.n_top") > before) & (F.col("cut.n_top") <= upto))
        .select(
            *keys,
            "score",
            F.col("cut.i").alias("i"),
            F.col("cut.n_top").alias("n_top"),
            (F.col("cut.n_top") - before).alias("rest"),
            (F.col("cum_pos") - F.col("pos")).alias("pos_above"),
            "all_pos",
            (F.col("all_pos") + F.col("all_neg")).alias("all_rows"),
        )
    )
    tied = scored.select(*keys, F.col(score).alias("score"), F.col(key).alias("_key"), F.col(label).cast("long").alias("pos"))
    at_cut = (
        tied.join(cuts.select(*keys, "score", "i", "rest"), [*keys, "score"])
        .groupBy(*keys, "i", "rest", "_key")
        .agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("rows"))
    )
    placed = running_totals(at_cut, [*keys, "i"], "_key", ["rows"], edges[key])
    taken = placed.where(F.col("cum_rows") <= F.col("rest")).groupBy(*keys, "i").agg(F.sum("pos").alias("pos_tied"))
    top = F.col("pos_above") + F.col("pos_tied")
    merged = cuts.join(taken, [*keys, "i"])
    aggregates = []
    for i, f in enumerate(fractions):
        percent = int(f * 100)
        mine = F.col("i") == i
        rate = share(top, F.col("n_top"))
        aggregates += [
            F.max(F.when(mine, share(rate, share(F.col("all_pos"), F.col("all_rows"))))).alias(f"lift_at_{percent}"),
            F.max(F.when(mine, share(top, F.col("all_pos")))).alias(f"bad_rate_capture_at_{percent}"),
        ]
    return merged.groupBy(*keys).agg(*aggregates)


# ---- Fold tables ----

def fold_rows(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows whose fold is a number: leaves out appended summary rows."""
    return df.where(F.col(fold).cast("string").try_cast("int").isNotNull()).withColumn(
        fold, F.col(fold).cast("string").try_cast("int")
    )


def with_summary_rows(folds: DataFrame, metrics: Sequence[str], fold: str = "fold") -> DataFrame:
    """The fold rows followed by a ``mean`` and a sample ``std`` row."""
    rows = folds.withColumn(fold, F.col(fold).cast("string"))
    mean = folds.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(fold, F.lit("mean"))
    spread = folds.agg(*[F.stddev_samp(m).alias(m) for m in metrics]).withColumn(fold, F.lit("std"))
    return rows.unionByName(mean, allowMissingColumns=True).unionByName(spread, allowMissingColumns=True)


def interval_summary(
    folds: DataFrame, metrics: Sequence[str] = TRACKED_INTERVALS, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean with a normal 95 % interval per metric over the folds; a single fold has no margin."""
    present = [m for m in metrics if m in folds.columns]
    long = folds.select(*keys, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        list(keys), present, "metric", "x"
    )
    grouped = long.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "metric").agg(
        F.avg("x").alias("value"),
        (NORMAL_95 * F.coalesce(F.stddev_samp("x"), F.lit(0.0)) / F.sqrt(F.count("x"))).alias("margin"),
    )
    return grouped.select(
        *keys,
        "metric",
        "value",
        (F.col("value") - F.col("margin")).alias("ci95_lower"),
        (F.col("value") + F.col("margin")).alias("ci95_upper"),
    )
