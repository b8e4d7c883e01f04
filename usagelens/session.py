"""Session helpers: configuration and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "usagelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    Shuffle partition counts stay with AQE: give `spark.sql.shuffle.partitions`
    a generous value on a cluster and let coalescing shrink it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="usagelens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, never a local disk."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a frame feeds several jobs: the files survive the loss of an
    executor and cut the lineage, which a cached block does not.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the input has fewer splits than cores; results are the same either way.

    For files of one row group, which cannot be split when read. Inputs of real
    size have more splits than that and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Spark hands Python at most so many rows at once.

    Both sides hold a batch of whole texts several times over, for every task that
    runs, and what they held stays with their processes. The setting is the
    session's and is read when a frame runs, so it can't be taken back here.
    """
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(BATCH_ROWS, rows)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out exactly once per row.

    The optimizer copies an expression into every filter and projection that
    uses it, which for long regular expressions multiplies the work. It does
    not look through a generator, so the values come out of a one-row one.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(values)))
