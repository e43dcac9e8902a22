"""Dataset loaders: points and raw series of a dataset as DataFrames.

Canonical layout of a dataset folder: ``series/`` (Parquet: gpi, ts and the data columns,
optionally partitioned by cell), ``points/`` (Parquet: gpi, lon, lat, optionally cell and
station metadata), an optional ``extension/`` with newer series, and for stations an optional
classification CSV. A store in a ragged layout has ``locations/`` and ``observations/`` instead (see
``ragged``). Folders with NetCDF time series go through a Python data source when its library is
installed. What a folder holds decides, not the name of the reader.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.config import DatasetConfig
from gaugewise.operators.series import clean, extend
from gaugewise.sources.netcdf import GRID_FILE, netcdf_source
from gaugewise.sources.ragged import expand
from gaugewise.sources.stations import CLASS_FILE, attach_frm_classes


@dataclass(frozen=True)
class Source:
    points: DataFrame
    series: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def _parquet_source(spark: SparkSession, config: DatasetConfig) -> Source:
    root = config.storage_path.rstrip("/")
    if _exists(spark, f"{root}/locations"):
        locations = spark.read.parquet(f"{root}/locations")
        series = expand(locations, spark.read.parquet(f"{root}/observations"))
        return Source(locations.drop("position", "row_size"), series)
    if not _exists(spark, f"{root}/series"):
        points, series = netcdf_source(spark, root)
        return Source(points, series)
    series = spark.read.parquet(f"{root}/series")
    if _exists(spark, f"{root}/extension"):
        series = extend(series, spark.read.parquet(f"{root}/extension"))
    return Source(spark.read.parquet(f"{root}/points"), series)


def load_gridded(spark: SparkSession, config: DatasetConfig) -> Source:
    return _parquet_source(spark, config)


def load_cleaned(spark: SparkSession, config: DatasetConfig) -> Source:
    """Gridded data whose gaps in quality columns mean "nothing reported"."""
    source = _parquet_source(spark, config)
    return Source(source.points, clean(source.series))


def load_stations(spark: SparkSession, config: DatasetConfig) -> Source:
    """Station data; a classification file adds the class of each sensor."""
    source = _parquet_source(spark, config)
    class_file = f"{config.storage_path.rstrip('/')}/{CLASS_FILE}"
    classes = None
    if _exists(spark, class_file):
        classes = spark.read.option("header", True).csv(class_file).select(F.col("gpi").cast("bigint"), "frm_class")
    return Source(attach_frm_classes(source.points, classes), source.series)


# Reader names that configurations use. The last two clean as they read.
LOADERS: dict[str, Callable[[SparkSession, DatasetConfig], Source]] = {
    "ISMN_Interface": load_stations,
    "SMAPTs": load_gridded,
    "SMAPL3_V9Reader": load_gridded,
    "GriddedNcOrthoMultiTs": load_gridded,
    "GriddedNcContiguousRaggedTs": load_gridded,
    "SBPCAReader": load_cleaned,
    "SMOSL2Reader": load_cleaned,
}
STATION_READERS = ("ISMN_Interface",)
GRID_READERS = ("SMAPTs",)


def register_loader(reader: str, loader: Callable[[SparkSession, DatasetConfig], Source]) -> None:
    """Makes a further reader name usable in configurations."""
    LOADERS[reader] = loader


def load(spark: SparkSession, config: DatasetConfig) -> Source:
    if config.reader not in LOADERS:
        raise ValueError(f"no reader {config.reader!r} for dataset {config.short_name!r}")
    return LOADERS[config.reader](spark, config)


def check_storage(configs) -> None:
    """Every local dataset folder has to exist; remote locations are checked by Spark on reading."""
    for config in configs:
        if "://" in config.storage_path and not config.storage_path.startswith("file://"):
            continue
        path = Path(config.storage_path.removeprefix("file://"))
        if not path.exists():
            raise FileNotFoundError(f"storage path of {config.short_name} is missing: {path}")
        if not path.is_dir():
            raise NotADirectoryError(f"storage path of {config.short_name} is not a folder: {path}")
        if config.reader in GRID_READERS and not any((path / name).exists() for name in ("points", "locations", GRID_FILE)):
            raise FileNotFoundError(f"{config.short_name} needs points/ or {GRID_FILE} in {path}")
