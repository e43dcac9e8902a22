"""Temporal matching: nearest neighbour in time within a tolerance.

All series of all datasets travel through one exchange on (location, time tile). The
tile bounds how much of a long or dense series one task sees; a candidate close to a tile
border is repeated in the neighbouring tile it can still serve, so results do not depend
on the tiling. Inside a tile one sort and a pair of null-skipping lag/lead functions find
the candidates on both sides of every reference row: no pairs are formed, and the work
stays linear after the sort however many candidates lie within the tolerance.

A tile that holds a large share of all rows, be they references or candidates, is cut into
ranges of time, however short. Candidates are then not repeated: the last and the first
candidate of every piece are passed on over the pieces after and before it, so a piece needs
none of its neighbours' rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.functions.timing import DAY_US, epoch_us, tile_of
from gaugewise.operators.skew import attach, crowding, cut_ranges, may_crowd, settle


def unique_times(series: DataFrame, keys: Sequence[str] = ("gpi",)) -> DataFrame:
    """One value per location and time (the smallest), merged map-side before the shuffle."""
    return series.groupBy(*keys, "ts").agg(F.min("value").alias("value"))


def match_nearest(
    reference: DataFrame,
    others: Mapping[str, DataFrame],
    half_window_us: int,
    keys: Sequence[str] = ("gpi",),
    unique: bool = False,
    ref_name: str = "ref",
    **options,
) -> DataFrame:
    """Match the series in ``others`` (name -> ``keys``, ``ts``, ``value``) to ``reference``."""

    def tagged(name, series):
        return series.select(*keys, "ts", F.col("value").cast("double").alias("value"), F.lit(name).alias("dataset"))

    series = tagged(ref_name, reference)
    for name, other in others.items():
        series = series.unionByName(tagged(name, other))
    return match_datasets(series, ref_name, list(others), half_window_us, keys, unique, **options)


def match_datasets(
    series: DataFrame,
    reference: str,
    others: Sequence[str],
    half_window_us: int,
    keys: Sequence[str] = ("gpi",),
    unique: bool = False,
    tile_us: int | None = None,
    combined: bool = True,
    keep_times: bool = False,
) -> DataFrame:
    """Match datasets held in one long table (``dataset``, ``keys``, ``ts``, ``value``).

    The result has ``keys``, ``ts`` (of the reference), and one value column per dataset.
    ``combined`` keeps only reference rows matched in every other dataset. Ties in
    distance go to the earlier candidate. ``unique`` says that no dataset repeats a
    (location, time); otherwise such repeats are merged (smallest value) for candidates,
    while every reference row is kept.
    """
    keys, others = list(keys), list(others)
    tile_us = tile_us or tile_width(half_window_us)
    series = series.where(F.col("dataset").isin(reference, *others) & F.col("value").isNotNull())
    if not unique:
        candidates = unique_times(series.where(F.col("dataset") != reference), ["dataset", *keys])
        # read for the distinct times and for the match
        rows = settle(series.where(F.col("dataset") == reference).select(*candidates.columns))
        times = settle(rows.groupBy("dataset", *keys, "ts").agg(F.count(F.lit(1)).alias("n")))
        crowd = crowding(times)
        if crowd.any_hot and crowd.largest > 1:
            # match the distinct times, with their row counts in place of values, and join the rows back
            distinct = times.withColumn("value", F.col("n").cast("double")).select(*candidates.columns)
            found = match_datasets(
                distinct.unionByName(candidates), reference, others, half_window_us, keys, True, tile_us, combined,
                keep_times,
            )
            rows = rows.select(*keys, "ts", F.col("value").cast("double").alias(reference))
            return attach(rows, found.withColumnRenamed(reference, "n"), [*keys, "ts"]).select(*found.columns)
        series = rows.unionByName(candidates)

    is_ref, us = F.col("dataset") == reference, F.col("_us")
    value = F.col("value").cast("double")
    tagged = series.withColumn("_us", epoch_us()).select(
        *keys,
        "ts",
        "_us",
        is_ref.alias("_is_ref"),
        F.when(is_ref, value).alias("_ref"),
        *[
            F.when(F.col("dataset") == name, F.struct(us.alias("us"), value.alias("value"))).alias(f"_c_{i}")
            for i, name in enumerate(others)
        ],
    )
    tagged, tile = _tiled(tagged, keys, len(others), tile_us, half_window_us)
    over = f"OVER (PARTITION BY {', '.join([*keys, *tile])} ORDER BY _us, _is_ref)"
    found = tagged.select(
        *keys,
        "ts",
        "_us",
        "_is_ref",
        "_ref",
        *[F.expr(f"lag(_c_{i}) IGNORE NULLS {over}").alias(f"_p_{i}") for i in range(len(others))],
        *[F.expr(f"lead(_c_{i}) IGNORE NULLS {over}").alias(f"_n_{i}") for i in range(len(others))],
    ).where("_is_ref")

    matched = found.select(
        *keys,
        "ts",
        F.col("_ref").alias(reference),
        *[_closer(i, half_window_us).alias(f"_m_{i}") for i in range(len(others))],
    )
    if combined:
        for i in range(len(others)):
            matched = matched.where(F.col(f"_m_{i}").isNotNull())
    columns = [F.col(f"_m_{i}.value").alias(name) for i, name in enumerate(others)]
    if keep_times:
        columns += [
            F.timestamp_micros(f"_m_{i}.us").cast("timestamp_ntz").alias(f"{name}_ts") for i, name in enumerate(others)
        ]
    return matched.select(*keys, "ts", reference, *columns)


def tile_width(half_window_us: int) -> int:
    """Width of the time tiles: wide against the tolerance, so that few candidates are repeated, yet
    narrow enough to split a location that holds a large share of all rows."""
    return max(min(64 * half_window_us, max(8 * half_window_us, 30 * DAY_US)), 1)


def _tiled(tagged: DataFrame, keys: list[str], n: int, tile_us: int, half_window_us: int) -> tuple[DataFrame, list[str]]:
    """``tagged`` with every candidate in all tiles it can serve, and the columns that number the tiles."""
    us = F.col("_us")
    own = tile_of(us, tile_us)
    if may_crowd(tagged):
        # read for the sizes of the tiles, for the cuts and for the match
        tagged = settle(tagged)
        placed = tagged.withColumn("_tile", own)
        sizes = settle(placed.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("n")))
        crowd = crowding(sizes)
        if crowd.any_hot:
            return _pieces(cut_ranges(placed, [*keys, "_tile"], "_us", sizes, crowd), keys, n), ["_tile", "_sub"]
    served = F.sequence(tile_of(us - half_window_us, tile_us), tile_of(us + half_window_us, tile_us))
    return tagged.withColumn("_tile", F.explode(F.when(F.col("_is_ref"), F.array(own)).otherwise(served))), ["_tile"]


def _pieces(placed: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``placed`` plus, in every piece, the nearest candidates of each dataset before and after the piece.

    One row a piece is passed along its location: a location has as many as its time range has tiles,
    and a bounded number of cuts more.
    """
    piece = ["_tile", "_sub"]
    ends = placed.groupBy(*keys, *piece).agg(
        *[F.max(f"_c_{i}").alias(f"_l_{i}") for i in range(n)], *[F.min(f"_c_{i}").alias(f"_f_{i}") for i in range(n)]
    )
    # both from the start of the order: a frame that ends at its end would be walked anew for every row
    onward = W.partitionBy(*keys).orderBy(*piece).rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in piece]).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        *piece,
        *[F.last(f"_l_{i}", ignorenulls=True).over(onward).alias(f"_b_{i}") for i in range(n)],
        *[F.last(f"_f_{i}", ignorenulls=True).over(back).alias(f"_a_{i}") for i in range(n)],
    )
    entries = ", ".join(f"struct({i} AS _i, _{side}_{i} AS _c)" for i in range(n) for side in "ba")
    carried = carried.selectExpr(*[f"`{k}`" for k in keys], *piece, f"inline(array({entries}))").where("_c IS NOT NULL")
    rows = carried.selectExpr(
        *[f"`{k}`" for k in keys],
        "CAST(NULL AS TIMESTAMP_NTZ) AS ts",
        "_c.us AS _us",
        "false AS _is_ref",
        "CAST(NULL AS DOUBLE) AS _ref",
        *[f"CASE WHEN _i = {i} THEN _c END AS _c_{i}" for i in range(n)],
        *piece,
    )
    return placed.unionByName(rows)


def _closer(i: int, half_window_us: int) -> Column:
    before, after = F.col(f"_p_{i}"), F.col(f"_n_{i}")
    gap_before = F.col("_us") - before["us"]
    gap_after = after["us"] - F.col("_us")
    before_ok = gap_before <= half_window_us
    after_ok = gap_after <= half_window_us
    take_before = before_ok & (~F.coalesce(after_ok, F.lit(False)) | (gap_before <= gap_after))
    return F.when(take_before, before).when(after_ok, after)
