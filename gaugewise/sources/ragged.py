"""Ragged layouts as Spark tables: locations of cells, and observations that know only their row in the cell.

``locations``: cell, position (from 0, its place in the cell), gpi and, in the contiguous layout, row_size.
``observations``: cell, data columns, and either row (from 0; the contiguous layout, where a location's rows
follow those of the location before it) or location_index (a position; the indexed layout).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions and rows of a cell that travel together; a cell of any size is cut at their multiples.
POSITIONS, ROWS = 4096, 1 << 16


def prefix_sums(frame: DataFrame, by: str, place: str, value: str, alias: str, width: int | None = None) -> DataFrame:
    """``frame`` with the sum of ``value`` over the rows of one ``by`` at smaller places, which differ within it.

    Sums of blocks of ``width`` places come first, then the blocks before a block, then the rows in it: a task
    holds a block's rows, or one short row for each block of a ``by``, however many rows that has.
    """
    width = width or POSITIONS
    blocked = frame.withColumn("_block", F.floor(F.col(place) / width))
    blocks = blocked.groupBy(by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(by, "_block").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return blocked.join(blocks, [by, "_block"]).withColumn(alias, total.cast("bigint")).select(*frame.columns, alias)


def _data(observations: DataFrame, *structure: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in observations.columns if c not in structure]


def expand_contiguous(locations: DataFrame, observations: DataFrame) -> DataFrame:
    """gpi and the data columns of every observation.

    Locations become ranges of rows by prefix sums of their sizes. Ranges are laid into the blocks of ROWS rows that
    they touch, and in each block the observations take the last location that began: one exchange and sort,
    no join by ranges, and no task above a block. Locations without rows, or with a null size, have
    no observations; observations beyond the last location's rows belong to none and are left out.
    """
    sized = locations.select("cell", "position", "gpi", F.coalesce(F.col("row_size").cast("bigint"), F.lit(0)).alias("row_size"))
    ranges = prefix_sums(sized, "cell", "position", "row_size", "start").filter("row_size > 0")
    ranges = ranges.withColumn("end", F.expr("start + row_size"))
    blocks = F.explode(F.sequence(F.floor(F.col("start") / ROWS), F.floor((F.col("end") - 1) / ROWS)))
    data = _data(observations, "cell", "row")
    payload = F.struct(F.lit(0).alias("_"), *data)
    begins = ranges.select("cell", blocks.alias("block"), "start", F.struct("gpi", "end").alias("at"))
    begins = begins.select("cell", "block", F.greatest("start", F.col("block") * ROWS).alias("row"), F.lit(0).alias("kind"), "at")
    rows = observations.filter("row >= 0").select(
        "cell", F.floor(F.col("row") / ROWS).alias("block"), F.col("row").cast("bigint").alias("row"), F.lit(1).alias("kind"), payload.alias("data")
    )
    run = begins.unionByName(rows, allowMissingColumns=True)
    order = W.partitionBy("cell", "block").orderBy("row", "kind").rowsBetween(W.unboundedPreceding, 0)
    placed = run.withColumn("at", F.last("at", ignorenulls=True).over(order)).filter("kind = 1 AND row < at.end")
    return placed.select("at.gpi", *(F.col(f"data.`{c}`") for c in observations.columns if c not in ("cell", "row")))


def expand_indexed(locations: DataFrame, observations: DataFrame) -> DataFrame:
    """gpi and the data columns of every observation whose index names a location of its cell."""
    data = _data(observations, "cell", "location_index")
    at = locations.select("cell", F.col("position").alias("location_index"), "gpi")
    # one row on the side of the locations, so that Spark can split a location of very many observations
    return observations.join(at, ["cell", "location_index"]).select("gpi", *data)


def expand(locations: DataFrame, observations: DataFrame) -> DataFrame:
    """Series of a store whose columns tell its layout."""
    if "location_index" in observations.columns:
        return expand_indexed(locations, observations)
    if "row" in observations.columns and "row_size" in locations.columns:
        return expand_contiguous(locations, observations)
    raise ValueError("observations need location_index, or row together with row_size of the locations")


def as_contiguous(series: DataFrame, cell: Column) -> tuple[DataFrame, DataFrame]:
    """locations and observations of a series (gpi, ts, data) in the contiguous layout, in order of gpi and ts."""
    sizes = series.groupBy("gpi").agg(F.count("*").alias("row_size")).withColumn("cell", cell)
    positioned = sizes.withColumn("position", F.row_number().over(W.partitionBy("cell").orderBy("gpi")) - 1)
    starts = prefix_sums(positioned, "cell", "position", "row_size", "start")
    rows = series.withColumn("n", F.row_number().over(W.partitionBy("gpi").orderBy("ts")) - 1).join(starts, "gpi")
    data = _data(series, "gpi")
    return positioned.select("cell", "position", "gpi", "row_size"), rows.select("cell", F.expr("start + n").alias("row"), *data)


def as_indexed(series: DataFrame, cell: Column) -> tuple[DataFrame, DataFrame]:
    """The same in the indexed layout, whose observations may come in any order."""
    located = series.select("gpi").distinct().withColumn("cell", cell)
    located = located.withColumn("position", F.row_number().over(W.partitionBy("cell").orderBy("gpi")) - 1)
    rows = series.join(located, "gpi").withColumnRenamed("position", "location_index")
    return located.select("cell", "position", "gpi"), rows.select("cell", "location_index", *_data(series, "gpi"))
