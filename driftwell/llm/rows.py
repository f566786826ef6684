"""Shared helpers: written tables, Arrow mapping, global row numbers."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from driftwell.session import checkpoint_dir

# monotonically_increasing_id() holds the partition above and the row inside it below this many bits.
PARTITION_BITS = 33


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/driftwell-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a lost executor costs a re-read."""
    path = work_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: Column) -> Column:
    """Bytes of a text; NULL counts as the empty text."""
    return F.coalesce(column.cast("binary"), F.lit(b""))


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


# What a worker keeps from task to task (a compiled vocabulary): one such thing at a time.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept by this worker for later tasks that ask for ``key``."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Forget what an earlier task kept: workers are used again by other operators, which need the memory."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


def give_back() -> None:
    """Return freed memory to the system, since an idle worker counts towards its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(
    df: DataFrame, rows: Callable[[pa.Table], dict], schema: str | StructType, piece: int = 2 << 20, keeps: bool = False
) -> DataFrame:
    """``df`` through ``rows``: a table of at most about ``piece`` bytes in, columns in the order of ``schema`` out.

    Batches are cut by bytes, so very long texts do not pile up in a worker. ``keeps`` says that ``rows`` uses ``kept``.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        for batch in batches:
            parts = max(1, math.ceil(batch.nbytes / piece))
            step = max(1, math.ceil(batch.num_rows / parts))
            for start in range(0, batch.num_rows, step):
                made = rows(pa.Table.from_batches([batch.slice(start, step)]))
                out = pa.table([pa.array(made[f.name], f.type) if not isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else made[f.name].cast(f.type) for f in target], schema=target)
                yield from out.to_batches()
        give_back()

    return df.mapInArrow(run, kind)


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of ``order``, ascending with NULLs first.

    Rows are dealt by range, sorted inside their range and stored with (range, place) as one number; the number
    of a range's first row is the count of all earlier ranges. Ranges are few (one row each), whatever the table.
    Rows equal in all of ``order`` may swap places; a fixed random number parts them, so that a third of all
    rows may be equal.
    """
    salt = f"_{uuid.uuid4().hex[:8]}"
    dealt = df.withColumn(salt, F.rand(11)).repartitionByRange(*order, salt).sortWithinPartitions(*order, salt)
    placed = stored(dealt.drop(salt).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PARTITION_BITS)
    # One row for each non-empty range: as many as shuffle partitions at most.
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), part == F.col("_part"))
        .withColumn(name, F.col("_start") + inside)
        .drop("_place", "_part", "_start")
    )


def grouped_map(df: DataFrame, by: Sequence[str], rows: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """``rows`` on each group of ``by``, as Arrow tables; for groups of a bounded size.

    Rows are dealt and sorted by ``by`` and groups are cut out of the stream of batches, which costs far less per
    group than a grouped Python function when there are very many small groups.
    """
    kind = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = rows(pa.Table.from_batches(parts).combine_chunks())
            if made is not None:
                yield from pa.table([pa.array(made[f.name], f.type) for f in target], schema=target).to_batches()

        drop_kept()
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                here = tuple(c[start].item() for c in columns)
                if here != key and held:
                    yield from done(held)
                    held = []
                key = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield from done(held)
        give_back()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, kind)
