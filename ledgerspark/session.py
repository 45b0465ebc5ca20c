"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the platform and ``spark.checkpoint.dir`` names a shared
folder; we only read it. ``get_spark`` is for tests, benches and local runs, and sets a
checkpoint folder only when none is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a long-lived session runs thousands of jobs: keep the driver's status store small
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "20000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("LEDGERSPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_KEY = "ledgerspark.local.checkpointDir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` from the session (the cluster's
    shared folder). Unset, it is an error on a cluster; in local mode a local folder is created and
    remembered under a private key because ``spark.checkpoint.dir`` cannot change at runtime."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_KEY, None)
    try:
        ctx = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext on the client (e.g. Spark Connect)
        ctx = None
    if not configured and ctx is not None:
        configured = ctx.getCheckpointDir()
    if not configured:
        if not getattr(ctx, "master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerspark-ckpt-")
        spark.conf.set(_LOCAL_KEY, configured)
    if ctx is not None and not ctx.getCheckpointDir():
        ctx.setCheckpointDir(configured)
    return configured


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written intermediate table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/staging/{name}-{uuid.uuid4().hex}"
