"""Station data: sensor metadata, classification file, network grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Class of a sensor that the classification file does not list, names of the depth columns.
UNCLASSIFIED = "undeducible"
CLASS_FILE = "frm_classification.csv"
DEPTH_FROM, DEPTH_TO = "instrument_depthfrom", "instrument_depthto"


def attach_frm_classes(sensors: DataFrame, classes: DataFrame | None, key: str = "gpi") -> DataFrame:
    """Adds ``frm_class``; without a classification table the column stays absent."""
    if classes is None:
        return sensors
    known = classes.groupBy(key).agg(F.min("frm_class").alias("frm_class"))
    return sensors.join(known, key, "left").withColumn("frm_class", F.coalesce("frm_class", F.lit(UNCLASSIFIED)))


def networks_with_sensors(sensors: DataFrame) -> DataFrame:
    """Per network the number of sensors and its first sensor; the sensors themselves stay one row each."""
    return sensors.groupBy("network").agg(F.count(F.lit(1)).alias("points"), F.min("gpi").alias("first_gpi"))


def parse_sensor_metadata(sensors: DataFrame, keys: Sequence[str], instrument: str = "instrument") -> DataFrame:
    """Flat columns from ``metadata`` (key -> array of value, depth_from, depth_to).

    Each key contributes its first value; the depths come from the instrument entry.
    """
    first = {key: F.get(F.element_at("metadata", F.lit(key)), F.lit(0)) for key in [*keys, instrument]}
    return sensors.select(
        *[c for c in sensors.columns if c != "metadata"],
        *[first[key]["value"].alias(key) for key in keys],
        first[instrument]["depth_from"].alias(DEPTH_FROM),
        first[instrument]["depth_to"].alias(DEPTH_TO),
    )
