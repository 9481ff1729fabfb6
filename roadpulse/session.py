"""Spark session helpers.

Cluster settings (executor memory, shuffle partitions, checkpoint dir) come
from the submitting environment; ``get_session`` only fills in what is unset,
so the same code runs under ``spark-submit`` on a cluster and in local tests.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "roadpulse", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one for local use.

    ``master`` defaults to ``local[$ROADPULSE_CPUS or *]`` only when no
    master is configured by the launcher.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or f"local[{os.environ.get('ROADPULSE_CPUS', '*')}]")
    conf = dict(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("ROADPULSE_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the timezone is part of the semantics (S1), never left to the host
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem and is
    used as is.  Only in local mode, where there is one machine, is one
    created when it is unset; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="roadpulse-ckpt-", dir=os.environ.get("ROADPULSE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/roadpulse/{name}"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as Parquet under the shared scratch
    folder and reading it back (one computation, unlike an eager checkpoint
    that computes the plan for the count and again for the files).  Survives
    executor loss: the files live on the shared filesystem."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}_{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
