"""Session helpers: where to cut lineage, and how to build a local session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_private_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Only a local master may fall back to a private temporary folder: executors on other machines
    could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private_folders:
        _private_folders[app] = tempfile.mkdtemp(prefix="driftwell-checkpoint-")
    return _private_folders[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor costs a re-read and not a re-run."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints and read back.

    Unlike a checkpoint the table keeps column pruning, pushed filters and partition pruning, which is what
    wide tables that are read many times need.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/driftwell-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def single_row(*frames: DataFrame) -> DataFrame:
    """One row from one-row tables with different columns, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else ``df`` itself.

    For group-sized results that meet row-sized ones: the check runs the small side once and keeps its
    rows, so they are not computed again.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "driftwell") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.log.level", "ERROR")
        # Keeping a Python stack trace per column expression slows down wide tables.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
