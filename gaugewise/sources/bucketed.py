"""A store of series whose files are dealt by location and time, so that merging needs no shuffle.

Every file holds the rows of one bucket of (location, time), sorted. Base and extension with the same
number of buckets are merged file against file; a location of very many rows lies in all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("gpi", "ts")


def write_bucketed(series: DataFrame, path: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Writes ``series`` under ``path`` in ``buckets`` buckets and reads it back; one task and file a bucket."""
    name = f"bucketed_{uuid.uuid4().hex}"
    # dealt out as the buckets are, so that no task writes into several of them
    dealt = series.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return series.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A store written earlier, perhaps by another session, with its buckets known to the planner."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{location}') "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS"
    )
    return spark.table(name)


def extend_bucketed(base: DataFrame, extension: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Base and extension as one, as of ``series.extend``; for stores of equal buckets without an exchange.

    Rows that repeat a key are merged within each store (the largest stays), then the stores are joined
    bucket by bucket; a row of the extension wins. Rows that lack a key stay, from either store.
    """
    keys = list(keys)
    payload = [c for c in base.columns if c not in keys]

    def newest(store: DataFrame, name: str) -> DataFrame:
        return store.groupBy(*keys).agg(F.max(F.struct(*payload)).alias(name))

    merged = newest(base, "_base").join(newest(extension, "_extension"), keys, "full_outer")
    row = F.coalesce("_extension", "_base")
    return merged.select(*keys, row.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in payload]).select(*base.columns)
