"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (D15), adaptive execution for
# runtime join choice / partition coalescing / skew splitting, and duplicate
# keys allowed in variants so JSON validity follows JavaScript.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def build_session(master: str | None = None, app: str = "ravel",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster use the cluster's session and
    call :func:`configure` instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("RAVEL_DRIVER_MEMORY", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to a shared file system; a local scratch folder is
    picked only on a local master where it is unset (local runs and tests);
    elsewhere an unset folder is an error. Works on classic and on
    Spark Connect sessions (no SparkContext there)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: configuration only
        sc = None
    d = (sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver "
                               f"and all executors share (master {master or 'unknown'})")
        d = tempfile.mkdtemp(prefix="ravel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local
    temp folder on a cluster)."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
