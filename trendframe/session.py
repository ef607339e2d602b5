"""Session construction and cluster-facing settings.

Everything here is plain Spark configuration. On a cluster the session is
normally created by the platform; ``get_spark`` only fills in settings that
are still unset, so cluster-level values (shuffle partitions, checkpoint
directory, memory) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. They are applied only when the running
# session does not define them already.
DEFAULTS = {
    # Adaptive execution: coalesces small shuffle partitions, splits skewed
    # join partitions and turns joins into broadcast joins only after it has
    # measured the real size of a side at runtime.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # All time arithmetic is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed streaming state lives in RocksDB so it can exceed the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # commit only the changes of a micro-batch, not a full state snapshot
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "trendframe", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, creating a local one if none exists.

    The library defaults are applied unless the cluster configuration sets
    the same keys.

    ``master`` and ``shuffle_partitions`` are meant for tests and the bench;
    on a cluster leave them ``None``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    conf = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        # cluster-level settings (spark-defaults, submit options) win
        if not conf.contains(k) and k not in (extra or {}):
            try:
                spark.conf.set(k, v)
            except Exception:  # static settings can only be given at start-up
                pass
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's value is read from the session. A private temporary folder
    is created only for a local master (tests); elsewhere the executors could
    not see it, so a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trendframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Per-query checkpoint location under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", name)
