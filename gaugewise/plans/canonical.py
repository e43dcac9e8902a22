"""Observation, point and sensor tables derived from the given star-schema tables.

The tables hold no soil moisture, so suppliers stand for locations, return flags for
datasets, ship dates for observation times, and parts for sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASETS = ("A", "N", "R")
DAY = 86_400_000_000
MATCH_HALF_US = 3 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, gpi, ts, value: one value per dataset, location and day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("dataset"),
            F.col("l_suppkey").alias("gpi"),
            F.col("l_shipdate").alias("ts"),
        )
        .agg(F.avg("l_quantity").alias("value"))
    )


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One dataset's series; the filter on the name reaches the scan."""
    return observations(spark, sf_dir).where(F.col("dataset") == name).select("gpi", "ts", "value")


def triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpi, ts, x, y, z: three correlated series with known scaling (1, 0.8, 1.1) and known errors."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("gpi"), F.col("l_shipdate").alias("ts"))
        .agg(
            F.avg("l_quantity").alias("s"),
            (100 * F.avg("l_discount")).alias("e1"),
            (100 * F.avg("l_tax")).alias("e2"),
            F.avg("l_linenumber").alias("e3"),
        )
        .selectExpr("gpi", "ts", "s + e1 AS x", "0.8D * s + e2 AS y", "1.1D * s + 2 * e3 AS z")
    )


# Where a key lies on the globe: a fixed spread over longitudes and latitudes.
def _lon(key: str, step: int) -> str:
    return f"(({key} * {step}) % 3600) / 10.0D - 180"


def _lat(key: str, step: int) -> str:
    return f"(({key} * {step}) % 1700) / 10.0D - 85"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpi, lon, lat, network: the reference grid."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey AS gpi", f"{_lon('s_suppkey', 1237)} AS lon", f"{_lat('s_suppkey', 617)} AS lat", "n_name AS network"
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpi, lon, lat, network, depth_from, depth_to: point sensors."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS gpi",
        f"{_lon('p_partkey', 1453)} AS lon",
        f"{_lat('p_partkey', 733)} AS lat",
        "p_brand AS network",
        "(p_size - 1) / 20.0D AS depth_from",
        "p_size / 20.0D AS depth_to",
    )


def frm_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpi, frm_class for the sensors of some types; the others are unclassified."""
    return (
        table(spark, sf_dir, "part")
        .where("p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO')")
        .selectExpr(
            "p_partkey AS gpi",
            "CASE p_size % 3 WHEN 0 THEN 'very representative' WHEN 1 THEN 'representative' "
            "ELSE 'not representative' END AS frm_class",
        )
    )


def sensor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpi (sensor), ts, value: series of the sensors."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("gpi"), F.col("l_shipdate").alias("ts"))
        .agg(F.avg("l_quantity").alias("value"))
    )


# Quality columns named as the filters expect them, computed from line items.
QUALITY_EXPRESSIONS = {
    "soil_moisture": "l_quantity",
    "soil_moisture_flag": "CASE l_returnflag WHEN 'A' THEN 'G' ELSE l_returnflag END",
    "flag": "l_linenumber % 4",
    "mode": "1 + l_linenumber % 2",
    "SWE_inst": "l_discount / 50",
    "sat_id": "2 + l_linenumber % 4",
    "ssf": "l_linenumber - 1",
    "surface_flag": "l_linenumber % 5",
    "conf_flag": "l_linenumber % 3",
    "proc_flag": "l_partkey % 2",
    "processing_flag": "l_partkey % 3",
    "Quality_Flag": "l_orderkey % 2",
    "RFI_Prob": "l_discount * 4",
    "N_RFI_X": "l_linenumber",
    "N_RFI_Y": "l_linenumber % 3",
    "M_AVA0": "l_quantity - 1",
    "Processing_Flags": "CAST(l_quantity AS BIGINT)",
    "Scene_Flags": "l_suppkey",
    "Science_Flags": "(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % 268435456",
    "Overpass": "1 + l_linenumber % 3",
    "t": "270 + l_quantity / 5",
    "swvl_t": "269 + l_quantity / 5",
    "SoilMoi": "l_quantity - 10",
    "SoilTMP": "l_tax * 25",
    "gapmask": "l_suppkey % 2",
    "frozenmask": "l_suppkey % 3",
    "Ratio_RFI": "l_discount",
    "Chi_2_P": "l_tax",
    "vegetation_water_content": "l_quantity / 10",
    "static_water_body_fraction": "l_discount",
    "subsurface_scattering_probability": "l_tax",
    "surface_soil_moisture_sensitivity": "l_quantity / 20",
}


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one raw observation with its quality columns."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS gpi",
        "l_shipdate AS ts",
        "l_orderkey AS orderkey",
        "l_linenumber AS linenumber",
        *[f"{expression} AS `{name}`" for name, expression in QUALITY_EXPRESSIONS.items()],
    )


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, gpi, ts, value with microsecond times: the event table."""
    return table(spark, sf_dir, "events").selectExpr("event_type AS dataset", "user_id AS gpi", "ts", "value")
