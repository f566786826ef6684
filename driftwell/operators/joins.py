"""Joins of many rows to a table with one row per key, where one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.session import small_side

# Keys with at least this share of the rows, of which there can only be so many, are broadcast.
HOT_KEYS = 64
# Rows that meet nothing are dealt over so many values.
STRAYS = 1 << 20


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str) -> DataFrame:
    """Left join to ``right``, unique in ``on``, whose column ``rows`` counts the rows of ``left`` with that key.

    Rows of hot keys find their partner in a broadcast table of at most ``HOT_KEYS`` rows, and neither they nor rows with a
    NULL key travel to one task: their join key gets a number of its own. ``rows`` is not in the result.
    """
    on = list(on)
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = right.where((F.col(rows) * HOT_KEYS >= F.lit(total)) & (F.col(rows) > 0))
    given = [c for c in right.columns if c not in on and c != rows]
    known = left.sparkSession.createDataFrame(hot.drop(rows).collect(), right.drop(rows).schema)
    marked = left.join(
        F.broadcast(known.select(*on, *[F.col(c).alias(f"_hot_{c}") for c in given], F.lit(True).alias("_hit"))), on, "left"
    )
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    alone = F.lit(1) + F.monotonically_increasing_id() % STRAYS
    dealt = marked.withColumn("_stray", F.when(F.col("_hit").isNotNull() | missing, alone).otherwise(F.lit(0).cast("long")))
    others = right.drop(rows).withColumn("_stray", F.lit(0).cast("long"))
    joined = dealt.join(small_side(others), [*on, "_stray"], "left")
    return joined.select(*left.columns, *[F.coalesce(c, f"_hot_{c}").alias(c) for c in given])
