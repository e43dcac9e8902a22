"""Session factory and the few session settings the library relies on."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

LOG = logging.getLogger(__name__)

#: Used where spark-submit sets nothing else. Shuffles start with many partitions and are merged
#: at run time to about 128 MB each, so one setting serves small and very large inputs.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # recording the Python call site of every expression is slow for plans with hundreds of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "gaugewise", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the plans assume: UTC, AQE, and skew-join splitting.

    On a cluster leave ``master`` unset and let spark-submit decide it.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    submitted = SparkConf()
    for key, value in DEFAULTS.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, app: str = "gaugewise-local", **conf) -> SparkSession:
    defaults = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(cpus),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    }
    return session(app, master=f"local[{cpus}]", **{**defaults, **conf})


def require_utc(spark: SparkSession) -> None:
    """Series time is kept as TIMESTAMP_NTZ and converted to epoch microseconds
    through the session zone, so that zone has to be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, found {zone!r}")


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in the machine's own file system, where it may or may not be a shared mount."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch one only where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="gaugewise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    elif not sc.master.startswith("local") and is_local(spark, configured):
        LOG.warning("spark.checkpoint.dir has to be mounted on every machine: %s", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured
