"""NetCDF time series as a Spark data source: one partition per cell file.

Needs the ``netCDF4`` package on the executors; without it, reading raises an error that
names the package. Three layouts are recognised from the file itself: orthogonal
(location x time), contiguous ragged (``row_size``) and indexed ragged (``locationIndex``).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GRID_FILE = "grid.nc"
_FORMAT = "gaugewise_netcdf"


def cell_files(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*.nc") if p.name != GRID_FILE)


def _open(path: str):
    try:
        import netCDF4
    except ImportError as error:
        raise ImportError("reading NetCDF series needs the netCDF4 package on all workers") from error
    return netCDF4.Dataset(path, "r")


def layout(variables) -> str:
    """Layout of a file from its variable names: ``indexed``, ``contiguous`` or ``orthogonal``."""
    if "locationIndex" in variables:
        return "indexed"
    if "row_size" in variables:
        return "contiguous"
    return "orthogonal"


def series_batches(dataset, columns):
    """Arrow batches (gpi, lon, lat, ts, columns) of one open cell file."""
    import numpy as np
    import pyarrow as pa

    def values(name):
        return np.ma.filled(dataset.variables[name][:].astype(float), np.nan)

    ids = np.asarray(dataset.variables["location_id"][:]).astype("int64")
    lon, lat = values("lon"), values("lat")
    time = dataset.variables["time"]
    unit, _, origin = time.units.partition(" since ")
    scale = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000}[unit]
    base = np.datetime64(origin.strip().replace(" ", "T").removesuffix("Z"), "us")
    ts = base + np.round(np.ma.filled(time[:].astype(float), 0.0) * scale).astype("timedelta64[us]")
    kind = layout(dataset.variables)
    if kind == "orthogonal":
        located = np.repeat(np.arange(len(ids)), len(ts))
        ts = np.tile(ts, len(ids))
        data = [values(c).reshape(-1) for c in columns]
    else:
        if kind == "contiguous":
            located = np.repeat(np.arange(len(ids)), np.asarray(dataset.variables["row_size"][:]))
        else:
            located = np.asarray(dataset.variables["locationIndex"][:])
        data = [values(c) for c in columns]
    arrays = [ids[located], lon[located], lat[located], ts]
    yield pa.RecordBatch.from_arrays(
        [pa.array(a) for a in arrays] + [pa.array(d, from_pandas=True) for d in data],
        names=["gpi", "lon", "lat", "ts", *columns],
    )


class _CellFile(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, folder, columns):
        self.folder, self.columns = folder, columns

    def partitions(self):
        return [_CellFile(path) for path in cell_files(self.folder)]

    def read(self, partition):
        with _open(partition.value) as dataset:
            yield from series_batches(dataset, self.columns)


class NetcdfSeries(DataSource):
    """Options: ``path`` (folder of cell files)."""

    @classmethod
    def name(cls):
        return _FORMAT

    def _columns(self):
        files = cell_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no NetCDF cell files in {self.options['path']}")
        structural = {"location_id", "lon", "lat", "alt", "time", "row_size", "locationIndex", "location_description"}
        with _open(files[0]) as dataset:
            return [name for name in dataset.variables if name not in structural]

    def schema(self):
        data = "".join(f", `{name}` double" for name in self._columns())
        return f"gpi bigint, lon double, lat double, ts timestamp_ntz{data}"

    def reader(self, schema):
        fixed = ("gpi", "lon", "lat", "ts")
        return _Reader(self.options["path"], [f.name for f in schema.fields if f.name not in fixed])


def netcdf_source(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Points and series of a folder of NetCDF cell files."""
    spark.dataSource.register(NetcdfSeries)
    rows = spark.read.format(_FORMAT).option("path", folder).load()
    return rows.select("gpi", "lon", "lat").distinct(), rows.drop("lon", "lat")
