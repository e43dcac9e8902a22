"""Averaging of point measurements that fall under one reference point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.stats import pearson
from gaugewise.operators.skew import attach, settle
from gaugewise.operators.spatial import nearest


def lookup_table(reference_points: DataFrame, other_points: DataFrame) -> DataFrame:
    """``ref_gpi, gpi, lon, lat``: every other point under its nearest reference point.

    One row per point, not one array per reference point: a reference point may collect
    any number of them.
    """
    hits = nearest(other_points, reference_points, point_id="gpi", candidate_id="ref_gpi")
    return other_points.join(hits.select("gpi", "ref_gpi"), "gpi").select("ref_gpi", "gpi", "lon", "lat")


def upscale(
    series: DataFrame,
    lut: DataFrame,
    temporal_stability: bool = False,
    sizes: DataFrame | None = None,
    r_min: float = 0.6,
    see_max: float = 0.05,
    min_stations: int = 4,
) -> DataFrame:
    """Mean of the points under each reference point and time: ``gpi`` (the reference), ``ts``, ``value``.

    With ``temporal_stability`` a reference point with more than ``min_stations`` points
    drops those that follow the mean badly: correlation below ``r_min`` or standard error
    of the regression above ``see_max``. ``sizes`` (gpi, n) tells roughly how long each
    series is, where a cheaper source than ``series`` knows it.
    """
    if sizes is None:
        sizes = series.groupBy("gpi").agg(F.count(F.lit(1)).alias("n"))
    mapping = lut.select("gpi", "ref_gpi").join(sizes, "gpi")
    placed = attach(series.select("gpi", "ts", "value"), mapping, ["gpi"])
    if temporal_stability:
        placed = settle(placed)  # for the means, the fits and the result
        stable = stable_points(placed, r_min, see_max, min_stations)
        placed = attach(placed, stable, ["ref_gpi", "gpi"])
    return placed.groupBy(F.col("ref_gpi").alias("gpi"), "ts").agg(F.avg("value").alias("value"))


def stable_points(placed: DataFrame, r_min: float, see_max: float, min_stations: int) -> DataFrame:
    """``ref_gpi, gpi, n`` of the points that pass the temporal stability test."""
    means = placed.groupBy("ref_gpi", "ts").agg(F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("n"))
    fit = (
        attach(placed, means, ["ref_gpi", "ts"])
        .groupBy("ref_gpi", "gpi")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"{pearson('_mean', 'value')}").alias("_r"),
            F.expr("stddev_pop(value)").alias("_s"),
        )
    )
    per_reference = fit.groupBy("ref_gpi").agg(F.count(F.lit(1)).alias("_stations"))
    # standard error of estimate of value regressed on the mean
    see = "_s * sqrt(greatest(1 - _r * _r, 0D)) * sqrt(n / greatest(n - 2, 1))"
    return (
        fit.join(per_reference, "ref_gpi")
        .where(f"_stations <= {int(min_stations)} OR (_r >= {r_min!r}D AND {see} <= {see_max!r}D)")
        .select("ref_gpi", "gpi", "n")
    )
