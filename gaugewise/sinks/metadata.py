"""Run attributes stored next to the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewise.config import RunConfig, actual_interval

# Grid spacing in degrees of datasets on irregular grids.
GRID_STEPS = {
    "SMAP_L3": 0.35,
    "SMOS_L3": 0.25,
    "SMOS_IC": 0.25,
    "ASCAT": 0.1,
    "SMOS_L2": 0.135,
    "SMOS_SBPCA": 0.135,
    "SMAP_L2": 0.35,
}
NOT_AVAILABLE = "N/A"


def _minute(moment) -> str:
    return moment.strftime("%Y-%m-%d %H:%M") if moment else NOT_AVAILABLE


def run_attributes(run: RunConfig) -> dict[str, str]:
    """Attribute name -> text. Dataset attributes end in the number of the dataset."""
    found = {
        "val_is_scattered_data": str(run.spatial_ref.is_scattered_data) if run.spatial_ref else NOT_AVAILABLE,
        "val_interval_from": _minute(run.interval_from),
        "val_interval_to": _minute(run.interval_to),
        "val_scaling_method": run.scaling_method,
        "val_anomalies": run.anomalies,
    }
    if run.anomalies == "climatology":
        found["val_anomalies_from"] = _minute(run.anomalies_from)
        found["val_anomalies_to"] = _minute(run.anomalies_to)
    if None not in run.bbox:
        found["val_spatial_subset"] = "[" + ", ".join(str(limit) for limit in run.bbox) + "]"
    for config in run.datasets:
        number = run.name_of(config).split("-", 1)[0]
        label = f"val_dc_dataset{number}"
        active = [*config.filter_descriptions, *(f"{name} {value}" for name, value in config.parametrised_filters)]
        start, end = actual_interval(run, config)
        found |= {
            label: config.short_name,
            f"val_dc_version{number}": config.version,
            f"val_dc_variable{number}": config.variable_pretty_name,
            f"val_dc_unit{number}": config.unit,
            f"val_dc_dataset_pretty_name{number}": config.pretty_name,
            f"val_dc_version_pretty_name{number}": config.version_pretty_name,
            f"val_dc_variable_pretty_name{number}": config.variable.name,
            f"val_dc_filters{number}": "; ".join(active) or NOT_AVAILABLE,
            f"val_dc_actual_interval_from{number}": start,
            f"val_dc_actual_interval_to{number}": end,
            f"{label}_grid_stepsize": str(GRID_STEPS.get(config.short_name, "nan")),
        }
        if run.spatial_ref and config.id == run.spatial_ref.id:
            found["val_ref"] = label
            if isinstance(config.resolution, dict):
                found["val_resolution"] = str(config.resolution.get("value"))
                found["val_resolution_unit"] = str(config.resolution.get("unit"))
        if run.scaling_ref and config.id == run.scaling_ref.id:
            found["val_scaling_ref"] = label
    return found


def attributes(spark: SparkSession, run: RunConfig) -> DataFrame:
    """``name, value`` of all run attributes and counters."""
    counters = {
        "total_points": run.total_points,
        "ok_points": run.ok_points,
        "error_points": run.error_points,
        "progress": run.progress,
    }
    rows = [(name, str(value)) for name, value in {**run_attributes(run), **counters}.items()]
    return spark.createDataFrame(rows, "name string, value string")
