"""Running totals and positional cuts over a global order, without a global sort in one task.

A window without partition keys sends every row to one task. Here rows are first summed per ordering
value, ordering values are cut into buckets at approximate quantiles of the raw rows, and a running total
is the bucket's offset plus the total inside the bucket. Buckets are a plain function of the value, so a
recomputed partition after an executor loss gives the same answer. Quantiles only balance the buckets;
the totals are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import written_table

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 16_384
# Rows that the edges are taken from. They only balance the work, so a sample is as good as all rows and keeps
# the sketches of many tasks small.
EDGE_SAMPLE = 20_000_000
# monotonically_increasing_id() holds the partition above and the row inside it below this many bits.
PARTITION_BITS = 33


def bucket_edges(
    df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[str, list[float]]:
    """Bucket edges per column; none when the rows fit one bucket.

    The driver receives at most ``MAX_BUCKETS`` numbers per column. Nothing is sketched for small tables.
    """
    rows = df.select(F.count(F.lit(1))).first()[0]
    wanted = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if wanted <= 1:
        return {c: [] for c in columns}
    source = df.sample(False, EDGE_SAMPLE / rows, seed=7) if rows > EDGE_SAMPLE else df
    steps = [i / wanted for i in range(1, wanted)]
    found = source.agg(
        *[F.percentile_approx(F.col(c).cast("double"), steps, max(4_096, 4 * wanted)).alias(c) for c in columns]
    ).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add the bucket number of ``column`` (binary search inside the JVM)."""
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *edges, math.inf]
    value = f"{name}_value"
    bucketed = Bucketizer(splits=splits, inputCol=value, outputCol=name).transform(
        df.withColumn(value, F.col(column).cast("double"))
    )
    return bucketed.drop(value)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    edges: Sequence[float] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<v>`` (total up to and including the row) and ``all_<v>`` (total of the key) per value.

    ``df`` holds one row per (keys, order). Work is split by (keys, bucket of ``order``).
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not edges:
        inside = Window.partitionBy(*keys).orderBy(direction).rowsBetween(*upto)
        whole = Window.partitionBy(*keys)
        return df.withColumns(
            {f"cum_{v}": F.sum(v).over(inside) for v in values}
            | {f"all_{v}": F.sum(v).over(whole) for v in values}
        )
    bucketed = with_bucket(df, order, edges, "_bucket")
    by_bucket = [*keys, "_bucket"]
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # (keys x buckets) rows: small however many rows there are.
    totals = bucketed.groupBy(*by_bucket).agg(*[F.sum(v).alias(f"_in_{v}") for v in values])
    offsets = totals.select(
        *by_bucket,
        *[F.coalesce(F.sum(f"_in_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_in_{v}").over(whole).alias(f"all_{v}") for v in values],
    )
    inside = Window.partitionBy(*by_bucket).orderBy(direction).rowsBetween(*upto)
    return (
        bucketed.join(offsets, by_bucket)
        .withColumns({f"cum_{v}": F.col(f"_off_{v}") + F.sum(v).over(inside) for v in values})
        .drop("_bucket", *[f"_off_{v}" for v in values])
    )


def dense_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of ``order``, without a sort in one task.

    Rows are dealt by range and written with (range, place inside it) as one number; what stands before a range is the sum
    of all earlier ranges, of which there are as many as shuffle partitions.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written_table(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PARTITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn(name, F.col("_start") + inside).drop("_place", "_part", "_start")


def values_at(
    df: DataFrame, order: str, tie: str, positions: Sequence[int], rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[int, tuple]:
    """The (order, tie) pair standing at each 1-based position of ``df`` sorted by (order, tie).

    The driver gets one pair per asked position. Ties on ``order`` are cut by ``tie`` with the same
    bucketed totals, so one hot ordering value is not sorted in one task.
    """
    wanted = sorted(set(positions))
    if not wanted:
        return {}
    edges = bucket_edges(df, [order, tie], rows_per_bucket)
    spark = df.sparkSession
    counted = df.groupBy(order).agg(F.count(F.lit(1)).alias("rows"))
    running = running_totals(counted, [], order, ["rows"], edges[order])
    before = F.col("cum_rows") - F.col("rows")
    asked = F.array(*[F.lit(p).cast("long") for p in wanted])
    cuts = running.select(
        order,
        F.explode(F.filter(asked, lambda p: (p > before) & (p <= F.col("cum_rows")))).alias("position"),
        before.alias("before"),
    ).select("position", order, (F.col("position") - F.col("before")).alias("rest"))
    found = {r["position"]: (r[order], r["rest"]) for r in cuts.collect()}
    hits = spark.createDataFrame(
        [(p, v, rest) for p, (v, rest) in found.items()],
        cuts.schema,
    )
    tied = (
        df.join(F.broadcast(hits.select(order).distinct()), order, "left_semi")
        .groupBy(order, tie)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    placed = running_totals(tied, [order], tie, ["rows"], edges[tie])
    chosen = (
        placed.join(F.broadcast(hits), order)
        .where((F.col("rest") > F.col("cum_rows") - F.col("rows")) & (F.col("rest") <= F.col("cum_rows")))
        .select("position", order, tie)
    )
    return {r["position"]: (r[order], r[tie]) for r in chosen.collect()}


def at_or_before(order: str, tie: str, cut: tuple):
    """Predicate: the row stands at or before ``cut`` in (order, tie) order."""
    return (F.col(order) < F.lit(cut[0])) | ((F.col(order) == F.lit(cut[0])) & (F.col(tie) <= F.lit(cut[1])))
