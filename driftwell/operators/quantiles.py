"""Exact quantiles of many columns in two passes, without sorting or holding a column.

Pass 1 takes a sketch per column and brackets every wanted rank between two sketch values. Pass 2 counts
what lies outside the brackets and ships only the values inside them, already counted per distinct value.
The ranks are then looked up exactly. A bracket that misses (the sketch error is a bound, so none should)
is widened and tried again, so the result never depends on the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.binning import bucketed, column_chunks, long_form, values_as_numbered

# A finer sketch costs more per task and column, a coarser one ships more values in the second pass; here
# both stay at a few percent of the column.
SKETCH_ACCURACY = 4_000
ROWS_PER_PART = 100_000_000
MAX_PARTS = 64


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles per column, missing values left out; None for an empty column."""
    answer: dict[str, list[float] | None] = {}
    for chunk in column_chunks(columns):
        answer |= _quantiles(df, chunk, list(probabilities), accuracy)
    return answer


def _quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int
) -> dict[str, list[float] | None]:
    steps = 2.0 / accuracy
    around = sorted({min(max(p + s, 0.0), 1.0) for p in probabilities for s in (-steps, steps)})
    sketch = {
        r["slot"]: r
        for r in long_form(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("slot")
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.percentile_approx("value", around, accuracy).alias("marks"),
        )
        .collect()
    }
    at = {p: i for i, p in enumerate(around)}
    brackets: dict[int, list[tuple[float, float]]] = {}
    ranks: dict[int, set[int]] = {}
    for slot, row in sketch.items():
        last = row["n"] - 1
        ranks[slot] = {r for p in probabilities for r in (math.floor(last * p) + 1, math.ceil(last * p) + 1)}
        spans = []
        for p in probabilities:
            below, above = max(p - steps, 0.0), min(p + steps, 1.0)
            spans.append((
                row["low"] if below == 0.0 else row["marks"][at[below]],
                row["high"] if above == 1.0 else row["marks"][at[above]],
            ))
        brackets[slot] = _merged(spans)
    # Brackets of long columns are cut further, so that no task ranks a whole bracket.
    parts = {slot: min(MAX_PARTS, 1 + row["n"] // ROWS_PER_PART) for slot, row in sketch.items()}
    values: dict[tuple[int, int], float] = {}
    open_slots = set(sketch)
    while open_slots:
        values |= _lookup(df, columns, {s: brackets[s] for s in open_slots}, {s: ranks[s] for s in open_slots}, parts)
        open_slots = {s for s in open_slots if any((s, r) not in values for r in ranks[s])}
        for s in open_slots:
            brackets[s] = [(sketch[s]["low"], sketch[s]["high"])]
    result: dict[str, list[float] | None] = {}
    for slot, name in enumerate(columns):
        if slot not in sketch:
            result[name] = None
            continue
        last = sketch[slot]["n"] - 1
        quantiles = []
        for p in probabilities:
            place = last * p
            low, high = values[slot, math.floor(place) + 1], values[slot, math.ceil(place) + 1]
            quantiles.append(low + (high - low) * (place - math.floor(place)))
        result[name] = quantiles
    return result


def _cuts(spans: list[tuple[float, float]], parts: int) -> tuple[list[float], list[int]]:
    """Split points of the brackets, each in ``parts`` equal steps, and the segment numbers of the gaps."""
    splits: list[float] = []
    gaps = [0]
    for low, high in spans:
        end = math.nextafter(high, math.inf)
        inner = {low + (high - low) * (k / parts) for k in range(1, parts)}
        splits += [low, *sorted(x for x in inner if low < x < end), end]
        gaps.append(len(splits))
    return splits, gaps


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    joined: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if joined and low <= math.nextafter(joined[-1][1], math.inf):
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    return joined


def _lookup(
    df: DataFrame,
    columns: list[str],
    brackets: dict[int, list[tuple[float, float]]],
    ranks: dict[int, set[int]],
    parts: dict[int, int],
) -> dict[tuple[int, int], float]:
    """Values at the given 1-based ranks, as far as they fall inside the brackets."""
    slots = sorted(brackets)
    cuts = [_cuts(brackets[s], parts[s]) for s in slots]
    cut = bucketed(values_as_numbered(df, [columns[s] for s in slots]), [splits for splits, _ in cuts])
    # Values inside a bracket are kept, those in the gaps are only counted.
    cells = ", ".join(
        f"named_struct('segment', b{i}, 'value', CASE WHEN b{i} NOT IN ({', '.join(map(str, gaps))}) THEN v{i} END)"
        for i, (_, gaps) in enumerate(cuts)
    )
    counted = (
        cut.select(F.expr(f"posexplode(array({cells}))").alias("place", "cell"))
        .select("place", "cell.segment", "cell.value")
        .where(F.col("segment").isNotNull())
        .groupBy("place", "segment", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    earlier = Window.partitionBy("place").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("place", "segment")
        .agg(F.sum("rows").alias("inside"))
        .select("place", "segment", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("offset"))
    )
    upto = Window.partitionBy("place", "segment").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.where(F.col("value").isNotNull())
        .join(offsets, ["place", "segment"])
        .withColumn("upto", F.col("offset") + F.sum("rows").over(upto))
    )
    # One row per wanted rank: two per column and probability.
    wanted = df.sparkSession.createDataFrame(
        [(i, s, r) for i, s in enumerate(slots) for r in sorted(ranks[s])], "place int, slot int, rank long"
    )
    hits = placed.join(F.broadcast(wanted), "place").where(
        (F.col("rank") > F.col("upto") - F.col("rows")) & (F.col("rank") <= F.col("upto"))
    )
    return {(r["slot"], r["rank"]): r["value"] for r in hits.select("slot", "rank", "value").collect()}
