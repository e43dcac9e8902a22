"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.session import checkpoint_dir

#: White space of every word rule here: space, tab to carriage return. Java and Python agree on it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows turned into Python objects at once inside a task.
ROWS_AT_ONCE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the cluster's shared checkpoint folder and read back.

    Cuts lineage: an executor lost later costs a read of this table, not another run.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/gaugewise-llm/{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Folders written inside the innermost open ``intermediate``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def intermediate(spark: SparkSession):
    """Removes in the end what ``stored`` wrote inside; what is still to be read has to be stored outside."""
    here: list[str] = []
    token = _written.set(here)
    try:
        yield
    finally:
        _written.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for written in here:
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)


def stored_last(make, spark: SparkSession, name: str) -> DataFrame:
    """The frame that ``make`` returns, stored; all that ``make`` stored on the way is removed."""
    with intermediate(spark):
        frame = make()
        outer = _written.set(None)
        try:
            return stored(frame, name)
        finally:
            _written.reset(outer)


def bounded(frame: DataFrame, key: Column, most: int, seed: int = 17) -> DataFrame:
    """About ``most`` rows chosen by a hash of ``key`` (all rows, if there are no more).

    For fitting on a bounded sample only. Repeats of a key are chosen together, the choice does
    not depend on the partitioning, and no sort is needed.
    """
    n = frame.count()
    if n <= most:
        return frame
    cut = int(most / n * (1 << 30))
    return frame.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(cut))


def row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as Python lists, a few hundred rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield [column.to_pylist() for column in part.columns]


def before(frame: DataFrame, keys: list[str], index: Column, values: dict[str, str], how=F.sum, width: int = 4096) -> DataFrame:
    """``frame`` plus, under each name of ``values``, ``how`` of that column over the key's rows of lower ``index``.

    Two levels: blocks of ``width`` index values are combined first, then the blocks before a block, then
    the rows before a row inside its block. So no task holds a whole key, only one row for each of its
    blocks. Rows of one key have different indexes; where nothing comes before, the value is 0.
    """
    blocked = frame.withColumn("_at", index).withColumn("_block", F.floor(F.col("_at") / width))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocked.groupBy(*keys, "_block").agg(*(how(column).alias(f"_in_{name}") for name, column in values.items()))
    blocks = blocks.select(*keys, "_block", *(how(f"_in_{name}").over(earlier).alias(f"_to_{name}") for name in values))
    inside = W.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    found = blocked.join(blocks, [*keys, "_block"])

    def joined(name: str, column: str) -> Column:
        kind = frame.schema[column].dataType
        near, far = F.coalesce(how(column).over(inside), F.lit(0)), F.coalesce(f"_to_{name}", F.lit(0))
        return (near.bitwiseXOR(far) if how is F.bit_xor else near + far).cast(kind).alias(name)

    return found.select(*frame.columns, *(joined(name, column) for name, column in values.items()))
