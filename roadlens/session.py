"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a local run needs; a cluster submit passes its own through spark-submit.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "roadlens", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. Local runs get UI off, AQE on and a scratch checkpoint dir."""
    master = master or os.environ.get("ROADLENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent *and* the master is local (tests, the bench)
    do we create a scratch folder of our own; on a cluster a missing setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="roadlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df):
    """Write a derived frame that several branches of a plan read (its lineage would
    otherwise be recomputed once per branch - column pruning makes the branches differ,
    so Spark cannot reuse their exchanges) to the shared checkpoint folder.

    ``roadlens.materialize=false`` turns this off (plans then recompute).
    """
    flag = df.sparkSession.conf.get("roadlens.materialize", "true").lower()
    return cut_lineage(df) if flag != "false" else df
