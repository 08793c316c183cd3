"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pricefold") -> SparkSession:
    """Session for tests and the local bench. On a cluster, use the cluster's session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one BLAS thread per Python worker: the worker count already matches the cores
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.driver.memory", os.environ.get("PRICEFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    On a local master (tests) a scratch folder is made when nothing is configured;
    on a cluster a driver-local folder would be lost on the executors, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="pricefold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def session_key(spark: SparkSession) -> str:
    """Key of tables memoised for a session: the application, never an object id that may be used again."""
    return spark.sparkContext.applicationId


def settle(df):
    """``df`` read from a reliable checkpoint in the shared folder, for tables that hundreds of jobs read.

    Its plan is a single scan and its lineage ends there. A cached table keeps the plans and stages it was made by, and the driver
    holds a copy of all of them for every query and every job that reads it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, settled: bool = False):
    """Keep an expensive intermediate table for reuse.

    ``pricefold.materialize`` = ``cache`` (default): persist in memory, spilling
    to disk; lost blocks are recomputed from lineage. ``checkpoint``: write a
    reliable checkpoint to the shared ``spark.checkpoint.dir`` (cuts the
    lineage, survives executor loss, keeps the hash partitioning), the choice
    for long cluster jobs. A table that is ``settled`` already is not written again.
    """
    from pyspark import StorageLevel

    mode = df.sparkSession.conf.get("pricefold.materialize", "cache")
    if mode == "checkpoint":
        return df if settled else settle(df)
    if mode == "none":
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)
