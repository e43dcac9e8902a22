"""Shaping of raw series: cleaning, extension data sets, moving averages and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.timing import DAY_US, epoch_us, tile_of
from gaugewise.operators.skew import attach, crowding, cut_ranges, may_crowd, settle

# Quality columns whose gaps mean "nothing reported".
QUALITY_COLUMNS = (
    "Chi_2_P",
    "M_AVA0",
    "N_RFI_X",
    "N_RFI_Y",
    "RFI_Prob",
    "Science_Flags",
)


def clean(series: DataFrame, ts: str = "ts") -> DataFrame:
    """Drop rows without a time, a measurement or an acquisition time; gaps in quality columns become 0."""
    present = series.columns
    cleaned = series.where(F.col(ts).isNotNull())
    quality = [c for c in QUALITY_COLUMNS if c in present]
    if quality:
        cleaned = cleaned.fillna(0, subset=quality)
    required = [c for c in ("Soil_Moisture", "acquisition_time") if c in present]
    return cleaned.dropna(subset=required) if required else cleaned


def extend(base: DataFrame, extension: DataFrame | None, keys: Sequence[str] = ("gpi", "ts")) -> DataFrame:
    """Base and extension series as one; where both have a time, the extension row wins.

    Copies of a (location, time) are merged map-side by a maximum instead of being ranked
    in a window, so a heavily repeated time stays cheap.
    """
    if extension is None:
        return base
    keys = list(keys)
    payload = [c for c in base.columns if c not in keys]
    both = base.withColumn("_src", F.lit(0)).unionByName(
        extension.select(*base.columns).withColumn("_src", F.lit(1))
    )
    newest = both.groupBy(*keys).agg(F.max(F.struct("_src", *payload)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload]).select(*base.columns)


def moving_mean(
    series: DataFrame,
    window_days: float,
    keys: Sequence[str] = ("gpi",),
    unique: bool = False,
    tile_us: int | None = None,
) -> DataFrame:
    """Adds ``mean``: the average of all values within half a window before and after each row.

    Prefix sums instead of a sliding frame: every row asks for the running sum at the two
    edges of its window, so the work per row does not depend on how many values the window
    holds. Location and time tile form the partition; values near a tile border are also
    sent to the neighbour that needs them. If a tile holds a large share of all rows, tiles
    are cut into ranges of time instead, and what lies before a piece comes from the sums of
    the pieces before it.
    """
    keys = list(keys)
    half = int(window_days * DAY_US / 2)
    tile_us = tile_us or 8 * half
    series = series.where(F.col("value").isNotNull()).select(*keys, "ts", F.col("value").cast("double").alias("value"))
    if unique:
        merged = series.withColumn("_copies", F.lit(1).cast("bigint"))
    else:
        merged = series.groupBy(*keys, "ts", "value").agg(F.count(F.lit(1)).alias("_copies"))
    merged = merged.withColumn("_us", epoch_us())
    if may_crowd(merged):
        merged = settle(merged)  # read for the sizes of the tiles, for the cuts and for the sums
        events = _window_events(merged, half).withColumn("_tile", tile_of(F.col("_at"), tile_us))
        sizes = settle(events.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("n")))
        crowd = crowding(sizes)
        if crowd.any_hot:
            running = _sums_over_pieces(cut_ranges(events, [*keys, "_tile"], "_at", sizes, crowd), keys)
        else:
            running = _sums_in_tiles(merged, keys, half, tile_us)
    else:
        running = _sums_in_tiles(merged, keys, half, tile_us)
    pieces = [c for c in ("_tile",) if c in running.columns]
    at_edges = (
        running.where("_edge <> 0")
        .groupBy(*keys, *pieces, "_us", "ts", "value", "_copies")
        .agg(
            F.expr("max(CASE WHEN _edge = 1 THEN _sum END) - max(CASE WHEN _edge = -1 THEN _sum END)").alias("_s"),
            F.expr("max(CASE WHEN _edge = 1 THEN _count END) - max(CASE WHEN _edge = -1 THEN _count END)").alias("_c"),
            F.max("_level").alias("_level"),
        )
    )
    result = at_edges.selectExpr(*keys, "ts", "value", "_level + _s / _c AS mean", "_copies")
    if not unique:
        result = result.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy")
    return result.drop("_copies")


def _window_events(merged: DataFrame, half: int) -> DataFrame:
    """Every value where it stands (edge 0), and the two edges of its window."""
    return merged.selectExpr(
        "*", f"inline(array(struct(_us AS _at, 0 AS _edge), struct(_us - {half} AS _at, -1 AS _edge), struct(_us + {half} AS _at, 1 AS _edge)))"
    )


def _running(keys: list[str], *tile: str) -> str:
    names = ", ".join(f"`{k}`" for k in [*keys, *tile])
    return f"OVER (PARTITION BY {names} ORDER BY _at, _edge ROWS UNBOUNDED PRECEDING)"


def _sums_in_tiles(merged: DataFrame, keys: list[str], half: int, tile_us: int) -> DataFrame:
    """Running sum and count at all events, values being sent to every tile whose windows reach them."""
    us = F.col("_us")
    placed = merged.select(
        "*",
        tile_of(us, tile_us).alias("_own"),
        tile_of(us - half, tile_us).alias("_first"),
        tile_of(us + half, tile_us).alias("_last"),
    )
    value_events = placed.withColumn("_tile", F.explode(F.sequence("_first", "_last"))).selectExpr(
        *keys, "ts", "value", "_copies", "_us", "_tile", "_us AS _at", "0 AS _edge"
    )
    edge_events = placed.selectExpr(
        *keys,
        "ts",
        "value",
        "_copies",
        "_us",
        "_own AS _tile",
        f"inline(array(struct(_us - {half} AS _at, -1 AS _edge), struct(_us + {half} AS _at, 1 AS _edge)))",
    )
    over = _running(keys, "_tile")
    return value_events.unionByName(edge_events).selectExpr(
        "*",
        f"coalesce(sum(CASE WHEN _edge = 0 THEN value * _copies END) {over}, 0D) AS _sum",
        f"coalesce(sum(CASE WHEN _edge = 0 THEN _copies END) {over}, 0) AS _count",
        "0D AS _level",
    )


def _sums_over_pieces(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running sum and count at all events: those of the pieces before, then those inside the piece.

    Values are taken against the location's mean (``_level``), so that sums over a long series stay
    small. The windows over pieces see one row a piece: the tiles of a location's time range and a
    bounded number of cuts.
    """
    piece = [*keys, "_tile", "_sub"]
    totals = events.groupBy(*piece).agg(
        F.expr("coalesce(sum(CASE WHEN _edge = 0 THEN value * _copies END), 0D)").alias("_v"),
        F.expr("coalesce(sum(CASE WHEN _edge = 0 THEN _copies END), 0)").alias("_n"),
    )
    group = ", ".join(f"`{k}`" for k in keys)
    levelled = totals.selectExpr("*", f"sum(_v) OVER (PARTITION BY {group}) / sum(_n) OVER (PARTITION BY {group}) AS _level")
    earlier = f"OVER (PARTITION BY {group} ORDER BY _tile, _sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = levelled.selectExpr(
        *[f"`{k}`" for k in piece],
        "_level",
        f"coalesce(sum(_v - _n * _level) {earlier}, 0D) AS _v0",
        f"coalesce(sum(_n) {earlier}, 0) AS _n0",
    )
    over = _running(keys, "_tile", "_sub")
    return events.join(offsets, piece).selectExpr(
        *[f"`{k}`" for k in keys],
        "ts",
        "value",
        "_copies",
        "_us",
        "_edge",
        "_level",
        f"_v0 + coalesce(sum(CASE WHEN _edge = 0 THEN (value - _level) * _copies END) {over}, 0D) AS _sum",
        f"_n0 + coalesce(sum(CASE WHEN _edge = 0 THEN _copies END) {over}, 0) AS _count",
    )


def moving_anomaly(series: DataFrame, window_days: float = 35, keys=("gpi",), unique: bool = False) -> DataFrame:
    """Deviation of every value from its centred moving average (``value`` is replaced)."""
    averaged = moving_mean(series, window_days, keys, unique)
    return averaged.select(*keys, "ts", (F.col("value") - F.col("mean")).alias("value"))


def climatology(
    series: DataFrame,
    baseline_from=None,
    baseline_to=None,
    keys: Sequence[str] = ("gpi",),
    smooth_days: int | None = None,
) -> DataFrame:
    """``keys``, ``doy``, ``clim`` (mean of the baseline for this day of the year), ``n`` (rows of the whole series).

    ``smooth_days`` averages the yearly cycle over a centred window that wraps around the
    turn of the year.
    """
    keys = list(keys)
    ts = F.col("ts")
    in_baseline = F.lit(True)
    if baseline_from is not None:
        in_baseline = in_baseline & (ts >= F.lit(baseline_from).cast("timestamp_ntz"))
    if baseline_to is not None:
        in_baseline = in_baseline & (ts <= F.lit(baseline_to).cast("timestamp_ntz"))
    cycle = series.groupBy(*keys, F.dayofyear("ts").alias("doy")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(in_baseline, F.col("value"))).alias("clim")
    )
    if not smooth_days:
        return cycle
    # one location has at most 366 rows here
    half = int(smooth_days // 2)
    key_list = ", ".join(f"`{k}`" for k in keys)
    wrapped = cycle.selectExpr("*", "explode(array(doy - 366, doy, doy + 366)) AS _at")
    return (
        wrapped.selectExpr(
            *keys,
            "doy",
            "n",
            "_at",
            f"avg(clim) OVER (PARTITION BY {key_list} ORDER BY _at RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
            " AS clim",
        )
        .where("_at = doy")
        .drop("_at")
    )


def climatology_anomaly(
    series: DataFrame,
    baseline_from=None,
    baseline_to=None,
    keys: Sequence[str] = ("gpi",),
    smooth_days: int | None = None,
) -> DataFrame:
    """Deviation of every value from the climatology of its day of the year (``value`` is replaced)."""
    cycle = climatology(series, baseline_from, baseline_to, keys, smooth_days)
    rows = series.select(*keys, "ts", "value").withColumn("doy", F.dayofyear("ts"))
    joined = attach(rows, cycle, [*keys, "doy"])
    return joined.select(*keys, "ts", (F.col("value") - F.col("clim")).alias("value"))
