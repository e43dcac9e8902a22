"""Trend of yearly metrics: Theil-Sen slope per decade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.stats import SLOPE_METRICS
from gaugewise.operators.subwindows import BULK


def theil_sen(yearly: DataFrame, by: Sequence[str]) -> DataFrame:
    """``slope`` per decade of ``value`` over the integer ``year``; NULL with fewer than two years.

    A group holds one row per calendar year, so its array stays small however long the
    underlying series are; the slopes are formed inside that array.
    """
    points = (
        yearly.where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy(*by)
        .agg(F.expr("array_sort(collect_list(struct(year, value)))").alias("_p"))
    )
    slopes = """flatten(transform(_p, a -> transform(filter(_p, b -> b.year > a.year),
                b -> (b.value - a.value) / (b.year - a.year))))"""
    return (
        points.selectExpr(*by, f"array_sort({slopes}) AS _s")
        .selectExpr(*by, "_s", "size(_s) AS _n")
        .selectExpr(
            *by,
            "CASE WHEN _n > 0 THEN 10 * (get(_s, CAST(floor((_n - 1) / 2) AS INT)) "
            "+ get(_s, CAST(floor(_n / 2) AS INT))) / 2 END AS slope",
        )
    )


def stability_slopes(metrics: DataFrame, key: str = "gpi") -> DataFrame:
    """Slope rows (``slopeR``, ``slopeBIAS``, ``slopeURMSD`` of window ``bulk``) from metrics with yearly windows."""
    yearly = metrics.where(F.col("metric").isin(*SLOPE_METRICS) & F.col("tsw").rlike("^[0-9]+$")).withColumn(
        "year", F.col("tsw").cast("int")
    )
    names = F.when(F.col("metric") == "urmsd", "slopeURMSD").otherwise(F.concat(F.lit("slope"), "metric"))
    return theil_sen(yearly, [key, "combo", "metric"]).select(
        key, F.lit(BULK).alias("tsw"), "combo", names.alias("metric"), F.col("slope").alias("value")
    )
