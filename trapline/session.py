"""Local SparkSession for tests, tools and the benchmark."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "trapline",
                  event_log_dir: str | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # rows here are small in bytes but CPU-heavy (string parsing): keep more,
         # smaller partitions after AQE coalescing so every core gets work
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("TRAPLINE_DRIVER_MEMORY", "8g")))
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint dir.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local runs, tests) a local temporary folder is chosen and set.
    """
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the cluster's ``spark.checkpoint.dir`` when set.

    Only when neither the context nor the session names one (local runs,
    tests) a local temporary folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    try:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        base = None
    if not base:  # local runs and tests only: no shared folder is configured
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(a machine-local temporary folder is not visible to the cluster)")
        base = tempfile.mkdtemp(prefix="trapline-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # noqa: BLE001 - a core setting may be read-only at run time
            pass
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def materialize(df):
    """Cut the lineage of a frame that is read several times.

    The frame is written as a Parquet table in a fresh folder under the
    shared checkpoint folder and read back: the written files survive the
    loss of the executors that computed them (``localCheckpoint`` would not),
    Parquet is compact for large frames, and the re-read plan carries real
    size statistics for AQE and join selection.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "materialized")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
