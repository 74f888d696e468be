"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE merges small shuffle partitions up to the advisory size and splits the hot ones, so a high
# first number of partitions serves both a laptop and a large cluster.
INITIAL_PARTITIONS = 8192
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings above; leave ``master`` unset to use the cluster's own.

    Without ``shuffle_partitions``, AQE starts from ``INITIAL_PARTITIONS``: divide the largest shuffle by
    the advisory size to choose another.
    """
    builder = SparkSession.builder.appName("cohortloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; also makes ``checkpoint()`` usable.

    A local folder is made up only when the setting is absent *and* the session is local.
    """
    context = spark.sparkContext
    in_use = context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or in_use
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortloom-")
    if in_use is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def pinned(table: DataFrame) -> DataFrame:
    """A finished, table-sized result read back from the shared folder (``checkpoint``).

    Runs the job so far. For counts that several later steps use: the data behind them is then
    read once, and losing an executor does not bring the work back.
    """
    shared_folder(table.sparkSession)
    return table.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
