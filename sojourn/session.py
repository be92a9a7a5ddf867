"""Session settings and the two ways a job cuts its lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on; sizing knobs stay with the cluster.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# A subject's rows lie together and in order when its lists are collected. Spark's hash aggregate for
# lists sorts them twice more, beyond 128 subjects a task, and spills; this one reads them as they lie.
LISTS_IN_ORDER = "spark.sql.execution.useObjectHashAggregateExec"


def local_session(
    app: str = "sojourn", cpus: str | None = None, folder: str | None = None
) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="sojourn-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the one set on the context.

    Every job that cuts its lineage needs a folder that driver and executors share. There is no
    other way to run, so a session that names none is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or current
    if not named:
        raise RuntimeError(
            "this job stores intermediate results: set spark.checkpoint.dir to a folder that the "
            "driver and all executors share"
        )
    if not current:
        context.setCheckpointDir(named)
    return named


def use_local_folder(spark: SparkSession) -> None:
    """Name a scratch folder on a session with a local master that has none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local") and "cluster" not in context.master:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sojourn-"))


def materialise(df: DataFrame) -> DataFrame:
    """Compute a small or medium result once and cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Compute a large result once as a Parquet table in the shared folder.

    Unlike a checkpoint it is compressed and later readers fetch only the columns they use.
    """
    path = new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
