"""Handling of groups that hold a large share of all rows.

A group counts as hot when it holds more than 1/PARTS of all rows and more than FLOOR rows;
that size is the threshold, and a hot group is split into pieces of about that size. By the
pigeonhole principle fewer than PARTS groups can be hot and all their pieces number at most
2 * PARTS, so lists of them are small whatever the data volume and may be broadcast. Whether there are any is checked before the
plan is built: the usual case gets the plain plan, the skewed case the one that splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.session import checkpoint_dir

PARTS = 16_384
FLOOR = 1_000_000
#: Copies of one row that travel together.
CHUNK = 100_000
#: Ranges that a hot group is cut into at most; a range is looked up among every BLOCK-th cut first.
RANGES, BLOCK = 1024, 32
#: Bytes of a row at least, by which the planner's estimate of a size becomes one of rows.
ROW_BYTES = 16


def settle(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared checkpoint folder and read back.

    Used where a result feeds several consumers: lost executors then cost a re-read, not
    another run of everything upstream, and the planner knows the true size.
    """
    if getattr(frame, "_settled", False):
        return frame
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/gaugewise/{uuid.uuid4().hex}"
    open_ = _written.get()
    if open_ is not None:
        open_.append(path)
    frame.write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored._settled = True
    return stored


#: Folders written inside the innermost open ``intermediate_results`` of this thread or task.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def intermediate_results(spark):
    """Removes what ``settle`` wrote inside, once the results that needed it are written."""
    written_here: list[str] = []
    token = _written.set(written_here)
    try:
        yield
    finally:
        _written.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for written in written_here:
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)


@dataclass(frozen=True)
class Crowding:
    """Total rows, rows of the largest group, and the size from which a group is hot."""

    total: int
    largest: int
    threshold: float

    @property
    def any_hot(self) -> bool:
        return self.largest > self.threshold


def crowding(counts: DataFrame, count_col: str = "n", parts: int | None = None, floor: int | None = None) -> Crowding:
    """Looks at group sizes (one row per group); a single row reaches the driver."""
    parts, floor = parts or PARTS, FLOOR if floor is None else floor
    row = counts.agg(F.sum(count_col).alias("total"), F.max(count_col).alias("largest")).first()
    total, largest = int(row["total"] or 0), int(row["largest"] or 0)
    return Crowding(total, largest, max(total / parts, floor))


def may_crowd(frame: DataFrame) -> bool:
    """Whether ``frame`` may have more than FLOOR rows, by the planner's own estimate of its size.

    Spares small inputs the pass that counts their groups. An estimate that is too low only means that
    one task may get a few times FLOOR rows.
    """
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) > FLOOR * ROW_BYTES


def cut_ranges(rows: DataFrame, keys: Sequence[str], value: str, sizes: DataFrame, crowd: Crowding) -> DataFrame:
    """``rows`` plus ``_sub``: 0, or for rows of a hot group the number of their range of ``value``.

    ``sizes`` has ``n`` rows of every group. A hot group is cut at its approximate quantiles into about
    as many ranges as it exceeds the threshold, RANGES at most. Equal values share a range.
    """
    keys = list(keys)
    probabilities = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    # fewer than PARTS groups are hot and their ranges number at most 2 * PARTS, so the list of cuts is bounded
    hot = F.broadcast(sizes.where(F.col("n") > crowd.threshold).select(*keys, F.col("n").alias("_n")))
    step = f"greatest(1, floor({RANGES} * {crowd.threshold!r}D / _n))"
    cuts = (
        rows.select(*keys, F.col(value).alias("_v"))
        .join(hot, keys)
        .groupBy(*keys, "_n")
        .agg(F.expr(f"approx_percentile(_v, array({probabilities}), 10000)").alias("_all"))
        .withColumn("_cuts", F.expr(f"array_distinct(filter(_all, (c, i) -> (i + 1) % {step} = 0))"))
        .withColumn("_blocks", F.expr(f"filter(_cuts, (c, i) -> (i + 1) % {BLOCK} = 0)"))
        .select(*keys, "_cuts", "_blocks")
    )
    v = f"`{value}`"
    return (
        rows.join(F.broadcast(cuts), keys, "left")
        .withColumn("_block", F.expr(f"CASE WHEN _cuts IS NULL THEN 0 ELSE {BLOCK} * size(filter(_blocks, c -> c < {v})) END"))
        .withColumn(
            "_sub",
            F.expr(
                "CASE WHEN _cuts IS NULL THEN 0 "
                f"ELSE _block + size(filter(slice(_cuts, _block + 1, {BLOCK - 1}), c -> c < {v})) END"
            ),
        )
        .drop("_cuts", "_blocks", "_block")
    )


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    count_col: str = "n",
    how: str = "inner",
) -> DataFrame:
    """``rows`` joined with the ``stats`` rows of their key (usually one).

    ``stats`` carries in ``count_col`` how many rows the key has; that column is dropped.
    Rows of a hot key are spread over several salts in proportion to its share, and its
    statistics are repeated once per salt. The salt comes from the content of the row, so
    a task that runs twice gives every row the same one; exact copies of a row, which
    would share a salt, are merged first and travel as counted chunks.
    """
    keys = list(keys)
    stats = settle(stats)
    crowd = crowding(stats, count_col)
    if not crowd.any_hot:
        return rows.join(stats.drop(count_col), keys, how)
    hot = F.broadcast(
        stats.where(F.col(count_col) > crowd.threshold)
        .groupBy(*keys)
        .agg(F.max(F.ceil(F.col(count_col) / crowd.threshold)).cast("int").alias("_splits"))
    )
    splits = F.coalesce("_splits", F.lit(1))
    chunks = (
        rows.groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) DIV {CHUNK}"))))
        .withColumn("_size", F.least(F.lit(CHUNK), F.col("_copies") - F.col("_chunk") * CHUNK))
    )
    salted_rows = chunks.join(hot, keys, "left").select(
        *rows.columns,
        "_size",
        F.pmod(F.pmod(F.xxhash64(*rows.columns), splits) + F.col("_chunk"), splits).cast("int").alias("_salt"),
    )
    salted_stats = (
        stats.drop(count_col)
        .join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    joined = salted_rows.join(salted_stats, [*keys, "_salt"], how).drop("_salt")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_size")))).drop("_copy", "_size")
