"""Reproducible shuffle by a Feistel permutation over global row numbers: shard and slot are computed, not sorted.

Rows get their number in key order; a keyed permutation of [0, rows) gives each row its shuffled place; the place
modulo the shards is the shard and the quotient the slot. Any reader can compute where row r lies. All steps are
DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.rows import number_rows, stored, utf8
from driftwell.session import small_side

# A prime under 2**31: products of two remainders fit a signed 64-bit number.
PRIME = 2_147_483_647
ROUNDS = 6
SEED = 20_240_917


class Feistel(NamedTuple):
    """A permutation of [0, rows) on a grid of ``left`` x ``right`` >= rows places."""

    rows: int
    left: int
    right: int
    keys: tuple[tuple[int, int, int], ...]


def feistel(rows: int, seed: int = SEED, rounds: int = ROUNDS) -> Feistel:
    """Grid and round keys for ``rows``. The keys follow a fixed linear congruence, so SQL can state them too."""
    state, found = seed % PRIME or 1, []
    for _ in range(3 * rounds):
        state = state * 48_271 % PRIME
        found.append(state)
    left = max(1, math.isqrt(max(0, rows - 1)) + 1)
    right = max(1, -(-rows // left))
    return Feistel(rows, left, right, tuple(tuple(found[3 * i : 3 * i + 3]) for i in range(rounds)))


def permute_once(df: DataFrame, name: str, f: Feistel) -> DataFrame:
    """Replace place ``name`` by its image on the grid (which may lie beyond ``rows``).

    A round adds a keyed cubic of one half (over a prime field) to the other half, modulo that half's size: one to
    one whatever the function is. Steps used twice are columns of their own, so that generated code stays short.
    """
    df = df.withColumns({"_x": F.expr(f"{name} div {f.right}"), "_y": F.expr(f"{name} % {f.right}")})
    for i, (a, b, c) in enumerate(f.keys):
        half, other, size = ("_y", "_x", f.left) if i % 2 else ("_x", "_y", f.right)
        df = df.withColumn("_t", F.expr(f"({half} % {PRIME} * {a} + {b}) % {PRIME}"))
        cubic = f"(_t * _t % {PRIME} * _t + {c}) % {PRIME}"
        df = df.withColumn(other, F.expr(f"({other} + {cubic}) % {size}"))
    return df.withColumn(name, F.expr(f"_x * {f.right} + _y")).drop("_x", "_y", "_t")


def walked(spark: SparkSession, f: Feistel) -> DataFrame | None:
    """(_from, _to) for every grid place beyond ``rows``: the place under ``rows`` that its walk ends at.

    There are left * right - rows < left such places, about the square root of the rows, and all are walked until
    none is left, so the shuffle is whole without a bound on the steps.
    """
    if not f.rows or f.left * f.right <= f.rows:
        return None
    outside, ended = spark.range(f.rows, f.left * f.right).select(F.col("id").alias("_from"), F.col("id").alias("_to")), []
    while True:
        step = stored(permute_once(outside, "_to", f), "walk")
        ended.append(step.where(F.col("_to") < f.rows))
        # A walk that comes back to its beginning stays outside for ever: no row leads into it.
        outside = step.where((F.col("_to") >= f.rows) & (F.col("_to") != F.col("_from")))
        if not outside.limit(1).count():
            return reduce(DataFrame.union, ended)


def shuffled_place(df: DataFrame, number: str, name: str, f: Feistel) -> DataFrame:
    """Add ``name``: the image of row number ``number`` in [0, rows), by cycle walking."""
    df = permute_once(df.withColumn(name, F.col(number)), name, f)
    ends = walked(df.sparkSession, f)
    if ends is None:
        return df
    joined = df.join(small_side(ends), F.col(name) == F.col("_from"), "left")
    return joined.withColumn(name, F.coalesce("_to", name)).drop("_from", "_to")


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """Add ``row_number``, ``shuffled``, ``shard`` and ``slot`` (law ``rows``: shard counts differ by one at most).

    ``order`` fixes the row numbers, NULLs first; rows equal in all of it may swap places. The same rows, order and
    seed give the same shards. An empty table gives no rows. Columns of ``df`` with these names are replaced.
    """
    df = df.drop("row_number", "shuffled", "shard", "slot")
    numbered = number_rows(df, order, "row_number")
    f = feistel(df.select(F.count(F.lit(1))).first()[0], seed)
    placed = shuffled_place(numbered, "row_number", "shuffled", f)
    return placed.withColumns(
        {"shard": F.expr(f"CAST(shuffled % {shards} AS INT)"), "slot": F.expr(f"shuffled div {shards}")}
    )


def shard_documents(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    A NULL text has size 16 and the checksum of the empty text. Repeated rows each get a slot of their own; ties on
    doc_id are ordered by checksum and size. Texts are read once; what is dealt by range is a few numbers per row.
    """
    raw = utf8(F.col("text"))
    slim = stored(docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "sizes")
    return shard_rows(slim, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
