"""Validation of observations that arrive in micro-batches: the state is moments, not rows.

A reference observation is final once nothing can arrive any more that would lie within its matching
window: then it is matched and adds to the moments of its location. What is kept from batch to batch is
one row of moments a location and the observations around the edge of the data; rows that are done
are never read again. State of a batch is written under its number, from that of the batch before
alone, so a batch that is repeated after a crash gives the same state and counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugewise.functions import stats
from gaugewise.functions.timing import epoch_us
from gaugewise.operators import moments
from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_of_moments, moment_groups

_ROWS = ["dataset", "gpi", "ts", "value"]


@dataclass(frozen=True)
class IncrementalValidation:
    """Pairs and triples of ``reference`` with ``others`` over a stream of (dataset, gpi, ts, value).

    An observation may come up to ``lateness_us`` after the latest one seen; one that comes later still
    counts as far as references are concerned that are not final yet. State lies under ``root``.
    """

    spark: SparkSession
    root: str
    reference: str
    others: tuple[str, ...]
    half_window_us: int
    lateness_us: int
    unique: bool = False
    triples: bool = False

    @property
    def groups(self):
        return moment_groups(self.reference, self.others, self.triples)

    def start(self, observations: DataFrame, checkpoint: str) -> StreamingQuery:
        """Works off what has arrived, in micro-batches, and stops."""
        writer = observations.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*_ROWS)
        earlier = self._read(batch_id - 1, "pending") if batch_id else None
        if earlier is not None:
            rows = rows.unionByName(earlier)
        rows = self._write(rows, batch_id, "rows")
        latest = rows.agg(F.max(epoch_us()).alias("us")).first().us
        if batch_id:
            before = self._read(batch_id - 1, "mark").first().us
            latest = max((us for us in (latest, before) if us is not None), default=None)
        self._write(self.spark.createDataFrame([(latest,)], "us long"), batch_id, "mark")
        self._advance(rows, batch_id, None if latest is None else latest - self.lateness_us)
        if batch_id > 1:
            self._drop(batch_id - 2)

    def _advance(self, rows: DataFrame, batch_id: int, mark_us: int | None) -> None:
        us, is_ref = epoch_us(), F.col("dataset") == self.reference
        final = F.lit(False) if mark_us is None else us + self.half_window_us <= mark_us
        found = self._moments_of(rows.where(~is_ref | final)).withColumn("_batch", F.lit(batch_id))
        if batch_id:
            found = found.unionByName(self._read(batch_id - 1, "moments").withColumn("_batch", F.lit(-1)))
        self._write(moments.merge_moments(found, self.groups, ["gpi"], ["_batch"]), batch_id, "moments")
        # a candidate serves references that are not final: those later than the mark less half a window
        needed = F.lit(True) if mark_us is None else us >= mark_us - 2 * self.half_window_us
        self._write(rows.where((is_ref & ~final) | (~is_ref & needed)), batch_id, "pending")

    def _moments_of(self, rows: DataFrame) -> DataFrame:
        matched = match_datasets(rows, self.reference, self.others, self.half_window_us, unique=self.unique)
        return matched.groupBy("gpi").agg(*map(F.expr, moments.row_moments(self.groups)))

    def metrics(self, batch_id: int, min_obs: int = stats.MIN_OBS, pair_metrics: Sequence[str] = stats.PAIR_METRICS) -> DataFrame:
        """Tidy metrics after batch ``batch_id``, references that are not final counting with what is there so far."""
        rest = self._moments_of(self._read(batch_id, "pending")).withColumn("_batch", F.lit(1))
        known = self._read(batch_id, "moments").withColumn("_batch", F.lit(0))
        merged = moments.merge_moments(known.unionByName(rest), self.groups, ["gpi"], ["_batch"])
        return metrics_of_moments(merged, self.reference, self.others, ["gpi"], self.triples, min_obs, pair_metrics)

    def _path(self, batch_id: int, name: str = "") -> str:
        return f"{self.root}/state/{batch_id}/{name}"

    def _read(self, batch_id: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(batch_id, name))

    def _write(self, frame: DataFrame, batch_id: int, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self._path(batch_id, name))
        return self._read(batch_id, name)

    def _drop(self, batch_id: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._path(batch_id))
        path.getFileSystem(conf).delete(path, True)
