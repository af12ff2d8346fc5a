"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every analysis assumes.  Dates and timestamps are compared in UTC;
# AQE re-plans joins at run time (broadcast when a side turns out small,
# split skewed partitions otherwise).  forceOptimizeSkewedJoin lets AQE split
# a hot user's partition even when that costs an extra shuffle afterwards,
# which is the trade we want: the following aggregations are all partial.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# At most these sizes; a session's own smaller ones stay.  AQE merges shuffle
# partitions up to the first and splits skewed ones beyond the second.  Both
# count compressed bytes, and narrow rows of keys and counts take some 15 times
# as much in the sorts and hash maps of the task that reads them.
PARTITION_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 64 << 20,
}
BYTE_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40,
              "p": 50, "pb": 50}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "listenflow", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session and call
    :func:`configure` on it instead."""
    master = master or os.environ.get("LISTENFLOW_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("LISTENFLOW_SHUFFLE_PARTITIONS", "8"))
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("LISTENFLOW_DRIVER_MEMORY", "8g"))
         .config("spark.sql.shuffle.partitions", str(parts)))
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the analyses rely on to an existing session."""
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)
    for k, most in PARTITION_BYTES.items():
        if byte_count(spark.conf.get(k)) > most:
            spark.conf.set(k, f"{most}b")
    checkpoint_dir(spark)
    return spark


def byte_count(size: str) -> int:
    """Bytes of a size as Spark's settings write it (``64MB``, ``8m``, ``67108864b``)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << BYTE_UNITS[unit]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it.  Only a local master may leave it unset (tests, local
    runs): then a fresh local folder is taken.  Elsewhere that folder would
    differ between the driver and the executors, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    try:
        conf_dir = conf_dir or spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set anywhere
        conf_dir = None
    if not conf_dir:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="listenflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Write ``df`` as a Parquet table under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage of a frame that is read more than once: later stages
    (and retries after a lost executor) read the shared files instead of
    re-running the upstream jobs.  Parquet rather than an RDD checkpoint, so
    the copy is columnar and compressed and readers prune its columns.
    """
    path = materialize_to_path(df)
    out = df.sparkSession.read.parquet(path)
    out._lf_path = path
    return out


def discard(*frames) -> None:
    """Delete the copies behind frames that :func:`materialize` returned, once
    the last job that reads them has ended."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lf_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize_to_path(df) -> str:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir``; return the folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/listenflow/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def drop_materialized(spark: SparkSession) -> None:
    """Delete every copy :func:`materialize` wrote for this application and
    forget what was kept (see :func:`refresh`)."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/listenflow"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    refresh(spark)


def refresh(spark: SparkSession) -> None:
    """Forget resolved sources, load-step tables and fitted models of this
    application: the next query lists the source files again and derives
    everything afresh."""
    from listenflow.plans import registry
    from listenflow.sources import product, raw
    app = spark.sparkContext.applicationId
    for memo in (raw._RESOLVED, product._LOADED, product._OBSERVED, registry._FITTED):
        for key in [k for k in memo if k[0] == app]:
            del memo[key]
    product._OPENED.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Remove the copies written inside the block when it ends."""
    try:
        yield
    finally:
        drop_materialized(spark)
