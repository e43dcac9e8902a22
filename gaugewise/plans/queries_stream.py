"""Queries that run as a stream of point batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugewise.functions.timing import epoch_us
from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_long
from gaugewise.operators.skew import settle
from gaugewise.plans import canonical as c
from gaugewise.plans.queries_match import METRICS_SQL
from gaugewise.plans.registry import query, r6
from gaugewise.session import checkpoint_dir
from gaugewise.sinks.results import read_results
from gaugewise.streaming.incremental import IncrementalValidation
from gaugewise.streaming.results import point_stream, stream_results

POINT_FILES = 5


@query("stream_batch_results", METRICS_SQL)
def stream_batch_results(spark, d):
    """Points arrive file by file; each micro-batch is validated and appended as a finished batch."""
    root = f"{checkpoint_dir(spark)}/gaugewise/{uuid.uuid4().hex}"
    points = c.table(spark, d, "supplier").select(F.col("s_suppkey").alias("gpi"))
    points.repartition(POINT_FILES, "gpi").write.parquet(f"{root}/points")
    observations = c.observations(spark, d)

    def process(batch):
        rows = observations.join(batch.select("gpi"), "gpi", "left_semi")
        matched = match_datasets(rows, "A", ["N", "R"], c.MATCH_HALF_US, unique=True)
        return metrics_long(matched, "A", ["N", "R"])

    stream = point_stream(spark, f"{root}/points", points.schema)
    stream_results(stream, process, f"{root}/results", f"{root}/checkpoint").awaitTermination()
    return read_results(spark, f"{root}/results").select("gpi", "combo", "metric", r6("value"))


#: Arrivals of observations, and how many days after its time an observation may come.
TIME_FILES, LATE_DAYS = 5, 40


@query("stream_incremental", METRICS_SQL)
def stream_incremental(spark, d):
    """Observations arrive by time in five parts, a third of each part's last weeks in the one after it."""
    root = f"{checkpoint_dir(spark)}/gaugewise/{uuid.uuid4().hex}"
    rows = settle(c.observations(spark, d).select("dataset", "gpi", "ts", "value"))
    span = rows.agg(F.min(epoch_us()).alias("a"), F.max(epoch_us()).alias("b")).first()
    width = max(1, ((span.b or 0) - (span.a or 0)) // TIME_FILES + 1)
    offset = epoch_us() - F.lit(span.a)
    late = (offset % width >= width - 30 * c.DAY) & (F.pmod(F.xxhash64("dataset", "gpi", "ts"), F.lit(3)) == 0)
    filed = rows.withColumn("_file", F.least(F.floor(offset / width) + late.cast("int"), F.lit(TIME_FILES - 1)))
    run = IncrementalValidation(spark, root, "A", ("N", "R"), c.MATCH_HALF_US, LATE_DAYS * c.DAY, unique=True)
    stream = spark.readStream.schema(rows.schema)
    for k in range(TIME_FILES):
        # written by as many tasks as read it, and worked off before the next part arrives
        filed.where(F.col("_file") == k).drop("_file").write.mode("append").parquet(f"{root}/observations")
        query_ = run.start(stream.parquet(f"{root}/observations"), f"{root}/checkpoint")
        query_.awaitTermination()
    return run.metrics(query_.lastProgress.batchId).select("gpi", "combo", "metric", r6("value"))
