"""Result tables: append per batch, resume, run metadata, summaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_hash(settings: Mapping) -> str:
    """Stable key of a configuration: the same settings resume the same results."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha1(text.encode("utf-8")).hexdigest()[:16]


def batch_path(root: str, settings: Mapping, batches: int) -> str:
    """Results of one configuration; batch boundaries depend on the number of batches, so it is part of the key."""
    return f"{root.rstrip('/')}/{config_hash(settings)}_b{batches}"


def with_batch(points: DataFrame, batches: int, key: str = "gpi") -> DataFrame:
    """Assigns every point to one of ``batches`` batches, the same one on every run."""
    return points.withColumn("batch_id", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))


def pending_points(points: DataFrame, finished: DataFrame, key: str = "gpi") -> DataFrame:
    """Points without a result yet."""
    return points.join(finished.select(key).distinct(), key, "left_anti")


def write_batch(results: DataFrame, path: str, batch_id: int, compression: str = "zstd") -> None:
    """Writes one batch as its own partition; a repeated batch replaces itself.

    The commit protocol publishes a batch whole or not at all, so a crashed batch leaves
    nothing to repair.
    """
    results.write.mode("overwrite").option("compression", compression).parquet(f"{path}/batch_id={batch_id}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


def finished_batches(spark: SparkSession, path: str) -> set[int]:
    """Batches whose success marker exists."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/_SUCCESS")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return {int(status.getPath().getParent().getName().split("=")[1]) for status in found}


def write_results(wide: DataFrame, path: str, compression: str = "zstd") -> None:
    """The wide result table, compressed; repeated runs replace it."""
    wide.write.mode("overwrite").option("compression", compression).parquet(path)


def write_table(frame: DataFrame, path: str, **options) -> None:
    """A small result table (summary, metadata, status) as a single file, replacing an earlier one."""
    frame.coalesce(1).write.mode("overwrite").options(**options).parquet(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """Statistics table: one row per combination and metric, so one file."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stored statistics table; all columns as text, without the ``Group`` column if there is one."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).drop("Group")
