"""Spark session helpers.

The library itself never creates a session inside an operator; callers pass one in.
``get_session`` exists for tests, the bench and scripts: it applies the settings the
queries rely on (UTC session zone for the naive timestamps, AQE on, UI off) and a
checkpoint folder only when the cluster has not named one already.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Fixed settings every query assumes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files of pinned intermediate tables are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "marginmart", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("MARGINMART_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    b = b.config("spark.driver.memory", os.environ.get("MARGINMART_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; pick a scratch one only if none is configured.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as is.  Only a
    session without one (a test or local run) gets a fresh scratch folder, registered with
    ``SparkContext.setCheckpointDir`` (the conf key itself is static).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or None
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="marginmart-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the jobs inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def apply_query_conf(spark: SparkSession) -> None:
    """Session-level settings the queries need for correct results (naive timestamps)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
