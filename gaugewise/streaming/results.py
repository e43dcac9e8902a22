"""Validation as a stream of point batches: every micro-batch of points becomes a finished result batch."""

from __future__ import annotations

import logging
from collections.abc import Callable
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from gaugewise.sinks.results import write_batch

LOG = logging.getLogger(__name__)

#: Sessions whose streams are logged.
_logged: WeakSet[SparkSession] = WeakSet()


def point_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1, pattern: str | None = None
) -> DataFrame:
    """Files of points as a stream; new files join the stream as they appear."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def stream_results(
    points: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Runs ``process`` on every micro-batch of points and writes its result as one batch.

    The checkpoint remembers finished batches; a batch repeated after a crash replaces its
    own output, so each result appears once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(process(batch), output, batch_id)

    spark = points.sparkSession
    if spark not in _logged:
        spark.streams.addListener(ProgressLogger())
        _logged.add(spark)
    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class ProgressLogger(StreamingQueryListener):
    """Logs rows and duration of every finished micro-batch."""

    def onQueryStarted(self, event):
        LOG.info("stream %s started", event.id)

    def onQueryProgress(self, event):
        p = event.progress
        LOG.info("batch %d: %d points in %.1f s", p.batchId, p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        LOG.info("stream %s ended%s", event.id, f" with {event.exception}" if event.exception else "")
