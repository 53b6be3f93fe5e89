"""Spark session helpers.

Library code never builds its own session; callers pass one in. These helpers are
for tests, the bench and the command-line entry points.
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Tables the driver lands under each scale-factor folder.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "jobmill") -> SparkSession:
    master = master or os.environ.get("JOBMILL_MASTER", "local[8]")
    builder = SparkSession.builder
    event_dir = os.environ.get("JOBMILL_EVENT_LOG_DIR")
    if event_dir:
        # stage/task timings without the web UI: read the event log files afterwards
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole documents go through the SimHash UDF: keep Arrow batches modest
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("JOBMILL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or the one already set on the
    context. Only a single-JVM session (``local[...]``) may do without: it gets a scratch
    folder of its own. On a cluster a machine-local folder would be unreadable elsewhere, so
    a missing setting is an error there."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    local = tempfile.mkdtemp(prefix="jobmill-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there something at ``path``, in whatever file system it names? Read errors rise."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """The shuffle files of what is run inside go when it is done, not when the driver's heap happens
    to be collected: a job of several steps holds the files of one step at a time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df):
    """CPU-heavy text work on a table with fewer input splits than cores: spread it
    round-robin over the cores. A no-op whenever the input already has enough splits
    (always the case on a cluster reading many files)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df
