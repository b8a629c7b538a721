"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  Shuffle partitions are a
# starting point: AQE coalesces small stages and splits skewed ones at run
# time, so the same code serves a laptop and a large cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast bounds: the planner broadcasts a side only when its size
    # estimate (for a scan-derived side, the unfiltered input size: an upper
    # bound) is below 32 MB; AQE re-checks the measured size of the
    # materialized stage against the same bound and otherwise keeps a
    # shuffle join, splitting skewed partitions.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Duplicate JSON keys: the last one wins, as in a Go decoder.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (hundreds of TB of updates).  Shuffles start
# with many partitions and AQE coalesces them to ~256 MB each; input splits
# stay at 256 MB; streaming state lives in RocksDB (one row per metric, off
# the JVM heap, checkpointed incrementally).
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gaugeline", extra: dict | None = None,
                cluster: bool = False) -> SparkSession:
    """Return the active session or build one with the package defaults.

    On a cluster the launcher already owns the session; in that case only
    the SQL settings that are safe to change at run time are applied.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        for k, v in {**DEFAULT_CONF, **(CLUSTER_CONF if cluster else {})}.items():
            builder = builder.config(k, v)
        builder = builder.config("spark.driver.memory", os.environ.get("GAUGELINE_DRIVER_MEMORY", "16g"))
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        for k, v in (extra or {}).items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(k, DEFAULT_CONF[k])
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and versioned tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared file
    system there).  Only when it is unset on a local master, as in tests, a
    fresh scratch folder is made and recorded in the session; on a cluster a
    machine-local folder would not survive a lost executor, so it is an
    error instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) for this cluster")
        root = tempfile.mkdtemp(prefix="gaugeline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
