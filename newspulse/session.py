"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "newspulse", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Noting the call site of every expression slows plan building down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings for large tables, to pass to ``build_session``.

    Shuffles start with a few partitions per core, which AQE merges up to the
    advisory size, so one setting serves small and large steps; scan splits
    are sized so that a text partition fits well into an executor.
    """
    return {
        "spark.sql.shuffle.partitions": str(3 * cores),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(3 * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.parquet.aggregatePushdown": "true",
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may name none; a folder is
    then made for the life of the driver. On a cluster a missing setting is an
    error, as executors can't read each other's disks.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share (master is {master})")
    base = getattr(shared_dir, "_fallback", None)
    if base is None:
        base = tempfile.mkdtemp(prefix="newspulse-")
        shared_dir._fallback = base
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/newspulse/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner the true size, so a later join broadcasts the table only when it
    really is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
    otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows of a scan over ``partitions`` tasks; None leaves the scan's own splits.

    For small files on one machine, which a scan reads in one task. On a
    cluster leave it out: large tables have enough splits.
    """
    return df if partitions is None else df.repartition(partitions)
