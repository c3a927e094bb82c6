"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Rows that one task of a shuffle takes where the number of tasks follows the input.
TASK_ROWS = 250_000


def get_session(app: str = "kairoscope", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; ``master`` only where none is configured."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    return (builder.master(master) if master else builder).getOrCreate()


def _scratch_root(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``, which all executors share."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kairoscope-"))  # one machine: its folders are shared
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/kairoscope/{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for this application's intermediate tables."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that were not written elsewhere go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, name: str, partition_by: str | None = None):
    """Writes ``df`` as Parquet in the shared scratch folder and reads it again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(rows: int) -> int:
    """The number of tasks over which so many rows are dealt, so that the memory of one does not grow with the input."""
    return max(1, -(-rows // TASK_ROWS))
