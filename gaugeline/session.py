"""Session helpers: settings for local runs and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out below the shared folder, by application.
_SCRATCH: dict[str, list[str]] = {}


def local_session(app: str = "gaugeline", cores: str = "8", memory: str = "8g", split: str = "2m") -> SparkSession:
    """A session for tests and benches, whose small files use all cores. Clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", split)
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle; AQE does not merge those, unlike small but work-heavy ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Where the setting is absent, a session whose driver and executors are one process (tests, one machine) gets a fresh
    folder; on a cluster that folder would be out of the executors' reach, so the call raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Store the rows as Parquet below the shared folder and read them back.

    Lost executors cost no recomputation, and readers prune columns. ``remove_scratch`` deletes the files.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all that this session has stored in the shared folder; call it when a job's results are written."""
    jvm = spark.sparkContext._jvm
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
