import sys
import types
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.config import parse_run
from gaugewise.sources import loaders, netcdf, ragged
from gaugewise.functions.timing import within_period
from gaugewise.sources.timestamps import adapt_timestamps, raw_period, time_rule
from gaugewise.streaming.results import point_stream, stream_results


def config(path, reader, filters=(), parametrised=()):
    return parse_run(
        {
            "dataset_configurations": [
                {
                    "id": 1,
                    "dataset": {"short_name": "S", "storage_path": str(path), "reader": reader},
                    "version": {"short_name": "v"},
                    "variable": {"short_name": "soil_moisture"},
                    "filters": list(filters),
                    "parametrised_filters": list(parametrised),
                }
            ]
        }
    ).datasets[0]


def test_stations_with_classes(spark, tmp_path):
    spark.sql("SELECT id AS gpi, 1D AS lon, 1D AS lat, 'X' AS network, 0D AS depth_from, 0.1D AS depth_to FROM range(3)").write.parquet(
        str(tmp_path / "points")
    )
    spark.sql("SELECT 1L AS gpi, TIMESTAMP_NTZ'2000-01-01' AS ts, 0.1D AS soil_moisture").write.parquet(str(tmp_path / "series"))
    plain = loaders.load(spark, config(tmp_path, "ISMN_Interface"))
    assert "frm_class" not in plain.points.columns
    (tmp_path / "frm_classification.csv").write_text("gpi,frm_class\n1,representative\n")
    source = loaders.load(spark, config(tmp_path, "ISMN_Interface"))
    assert {r.gpi: r.frm_class for r in source.points.collect()} == {0: "undeducible", 1: "representative", 2: "undeducible"}


def test_extension_folder_and_cleaning(spark, tmp_path):
    spark.sql("SELECT 1L AS gpi, 1D AS lon, 1D AS lat").write.parquet(str(tmp_path / "points"))
    columns = "gpi, ts, Soil_Moisture, Science_Flags"
    spark.sql(
        f"SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2000-01-01', 0.1D, 4L), (1L, TIMESTAMP_NTZ'2000-01-02', NULL, 4L) AS t({columns})"
    ).write.parquet(str(tmp_path / "series"))
    spark.sql(f"SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2000-01-01', 0.3D, NULL) AS t({columns})").write.parquet(
        str(tmp_path / "extension")
    )
    rows = loaders.load(spark, config(tmp_path, "SMOSL2Reader")).series.collect()
    assert [(r.Soil_Moisture, r.Science_Flags) for r in rows] == [(0.3, 0)]


def test_unknown_reader(spark, tmp_path):
    with pytest.raises(ValueError):
        loaders.load(spark, config(tmp_path, "NoSuchReader"))


def test_storage_check(tmp_path):
    file = tmp_path / "file"
    file.write_text("")
    loaders.check_storage([config(tmp_path, "ISMN_Interface"), config("s3a://bucket/x", "SMAPTs")])
    with pytest.raises(FileNotFoundError, match="grid.nc"):
        loaders.check_storage([config(tmp_path, "SMAPTs")])
    with pytest.raises(FileNotFoundError):
        loaders.check_storage([config(tmp_path / "missing", "SMAPTs")])
    with pytest.raises(NotADirectoryError):
        loaders.check_storage([config(file, "SMAPTs")])


@pytest.mark.parametrize(
    "dataset, version, row, expected",
    [
        ("SMOS_L3", "any", "1D AS Mean_Acq_Time_Days, 3600D AS Mean_Acq_Time_Seconds", datetime(2000, 1, 2, 1)),
        ("SMOS_IC", "any", "2 AS Days, 61 AS UTC_Seconds, 5 AS UTC_Microseconds", datetime(2000, 1, 3, 0, 1, 1, 5)),
        ("SMAP_L2", "any", "60L AS acquisition_time", datetime(2000, 1, 1, 12, 1)),
        ("SMOS_SBPCA", "SMOS_SBPCA_v724", "60L AS acquisition_time", datetime(2000, 1, 1, 0, 1)),
        ("SMOS_SBPCA", "other", "60L AS acquisition_time", datetime(1990, 1, 1)),
        ("ERA5", "any", "60L AS acquisition_time", datetime(1990, 1, 1)),
        ("SMAP_L2", "any", "CAST(NULL AS BIGINT) AS acquisition_time", None),
    ],
)
def test_exact_times(spark, dataset, version, row, expected):
    rows = spark.sql(f"SELECT TIMESTAMP_NTZ'1990-01-01' AS ts, {row}")
    assert adapt_timestamps(rows, dataset, version).first().ts == expected
    assert (time_rule(dataset, version) is None) == (expected == datetime(1990, 1, 1))


def test_period_reaches_the_stored_offset(spark):
    rows = spark.sql("SELECT id * 3600L AS acquisition_time FROM range(100)")
    rule = time_rule("SMAP_L2", "any")
    start, end = datetime(2000, 1, 2), datetime(2000, 1, 3)
    coarse = adapt_timestamps(rows.where(raw_period(rule, start, end)), "SMAP_L2", "any").where(
        within_period(F.col("ts"), start, end)
    )
    exact = adapt_timestamps(rows, "SMAP_L2", "any").where(within_period(F.col("ts"), start, end))
    assert coarse.collect() == exact.collect() and exact.count() == 25


class _Variable:
    def __init__(self, data, **attributes):
        self.data = np.ma.asarray(data)
        self.__dict__.update(attributes)

    def __getitem__(self, key):
        return self.data[key]


@pytest.mark.parametrize("kind", ["orthogonal", "contiguous", "indexed"])
def test_netcdf_layouts(kind):
    shared = {"location_id": _Variable([7, 8]), "lon": _Variable([1.0, 2.0]), "lat": _Variable([3.0, 4.0])}
    if kind == "orthogonal":
        variables = {
            "time": _Variable([0, 1], units="days since 2000-01-01 00:00:00"),
            "sm": _Variable(np.ma.masked_invalid([[0.1, np.nan], [0.3, 0.4]])),
        }
        expected = [(7, 1, 0.1), (7, 2, None), (8, 1, 0.3), (8, 2, 0.4)]
    else:
        variables = {"time": _Variable([0, 1, 0], units="days since 2000-01-01"), "sm": _Variable([0.1, 0.2, 0.3])}
        extra = {"contiguous": ("row_size", [2, 1]), "indexed": ("locationIndex", [0, 0, 1])}[kind]
        variables[extra[0]] = _Variable(extra[1])
        expected = [(7, 1, 0.1), (7, 2, 0.2), (8, 1, 0.3)]
    dataset = types.SimpleNamespace(variables={**shared, **variables})
    assert netcdf.layout(dataset.variables) == kind
    rows = [row for batch in netcdf.series_batches(dataset, ["sm"]) for row in batch.to_pylist()]
    assert [(r["gpi"], r["ts"].day, r["sm"]) for r in rows] == expected


@pytest.mark.skipif("netCDF4" in sys.modules, reason="library present")
def test_netcdf_needs_its_library(tmp_path):
    try:
        import netCDF4  # noqa: F401

        pytest.skip("library present")
    except ImportError:
        pass
    (tmp_path / "0001.nc").write_bytes(b"")
    with pytest.raises(ImportError, match="netCDF4"):
        netcdf.NetcdfSeries({"path": str(tmp_path)}).schema()


def test_stream_resumes_and_writes_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(0, 5).withColumnRenamed("id", "gpi").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    seen = []

    def process(batch):
        seen.append(batch.count())
        return batch

    stream_results(point_stream(spark, source, schema), process, out, state).awaitTermination()
    spark.range(5, 8).withColumnRenamed("id", "gpi").coalesce(1).write.mode("append").parquet(source)
    stream_results(point_stream(spark, source, schema), process, out, state).awaitTermination()
    from gaugewise.sinks.results import finished_batches, read_results

    assert sum(seen) == 8 and finished_batches(spark, out) == {0, 1}
    assert sorted(r.gpi for r in read_results(spark, out).collect()) == list(range(8))


@pytest.mark.parametrize("kind", ["int", "double"])
def test_day_columns_reach_the_scan(spark, tmp_path, kind):
    start, end = datetime(2001, 3, 1, 6), datetime(2001, 3, 20)
    rows = spark.range(800).selectExpr(
        "id AS gpi", f"CAST(id AS {kind}) AS Mean_Acq_Time_Days", "id * 97 % 86400 AS Mean_Acq_Time_Seconds", "1.0D AS v"
    )
    rows.write.parquet(f"{tmp_path}/rows")
    rule, stored = time_rule("SMOS_L3", "any"), spark.read.parquet(f"{tmp_path}/rows")
    coarse = stored.where(raw_period(rule, start, end))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = coarse._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(Mean_Acq_Time_Days" in plan and "LessThanOrEqual(Mean_Acq_Time_Days" in plan

    def exact(frame):
        return {r.gpi for r in adapt_timestamps(frame, "SMOS_L3", "any").where(F.col("ts").between(F.lit(start), F.lit(end))).collect()}

    assert exact(coarse) == exact(stored) and 15 < len(exact(stored)) <= coarse.count() < 30


def test_bucketed_stores_merge_without_exchange(spark, tmp_path):
    from gaugewise.operators.series import extend
    from gaugewise.sources.bucketed import extend_bucketed, open_bucketed, write_bucketed

    def rows(start, n, source):
        return [(k % 5, datetime(2020, 1, 1) + timedelta(hours=k // 5 * 3), float(k * source), f"s{source}") for k in range(start, start + n)]

    schema = "gpi bigint, ts timestamp_ntz, value double, flag string"
    base = spark.createDataFrame(rows(0, 300, 1) + rows(0, 5, 3) + [(None, None, 1.0, None)], schema)
    newer = spark.createDataFrame(rows(200, 200, 2), schema)
    write_bucketed(base, f"{tmp_path}/base", 4)
    write_bucketed(newer, f"{tmp_path}/newer", 4)
    merged = extend_bucketed(*(open_bucketed(spark, f"{tmp_path}/{n}", 4) for n in ("base", "newer")))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    wanted = sorted(map(repr, map(tuple, extend(base, newer).collect())))
    assert sorted(map(repr, map(tuple, merged.collect()))) == wanted and merged.columns == base.columns
    assert len([p for p in (tmp_path / "base").iterdir() if p.suffix == ".parquet"]) <= 4


@pytest.mark.parametrize("positions, rows", [(4096, 1 << 16), (3, 5)])
def test_ragged_layouts(spark, tmp_path, monkeypatch, positions, rows):
    monkeypatch.setattr(ragged, "POSITIONS", positions)
    monkeypatch.setattr(ragged, "ROWS", rows)
    draw = np.random.default_rng(3)
    located, observed, wanted = [], [], []
    for cell in range(3):
        row = 0
        for position in range(20 * cell):  # the first cell is empty
            gpi = 1000 * cell + position
            size = None if position == 4 else int(draw.choice([0, 1, 2, 40]))
            located.append((cell, position, gpi, float(cell), float(position), size))
            for _ in range(size or 0):
                observed.append((cell, row, position, f"v{cell}-{row}"))
                wanted.append((gpi, f"v{cell}-{row}"))
                row += 1
        observed.append((cell, row, 99, "beyond the last location"))
    draw.shuffle(observed)
    locations = spark.createDataFrame(located, "cell int, position int, gpi long, lon double, lat double, row_size int")
    observations = spark.createDataFrame([(int(c), int(r), int(p), str(v)) for c, r, p, v in observed], "cell int, row int, location_index int, value string")
    assert len(wanted) > 200
    found = ragged.expand(locations, observations.drop("location_index"))
    assert found.columns == ["gpi", "value"] and sorted(map(tuple, found.collect())) == sorted(wanted)
    assert sorted(map(tuple, ragged.expand(locations.drop("row_size"), observations.drop("row")).collect())) == sorted(wanted)
    assert ragged.expand(locations.limit(0), observations.drop("location_index")).count() == 0
    with pytest.raises(ValueError):
        ragged.expand(locations.drop("row_size"), observations.drop("location_index"))
    # prefix sums against a plain loop
    totals = {(r.cell, r.position): r.start for r in ragged.prefix_sums(locations, "cell", "position", "row_size", "start").collect()}
    for cell, position, *_ in located:
        assert totals[cell, position] == sum(x[5] or 0 for x in located if x[0] == cell and x[1] < position)
    # a folder in this layout is a dataset of any gridded reader
    locations.write.parquet(f"{tmp_path}/locations")
    observations.drop("location_index").write.parquet(f"{tmp_path}/observations")
    source = loaders.load(spark, config(tmp_path, "SMAPTs"))
    assert sorted(map(tuple, source.series.collect())) == sorted(wanted) and source.points.columns == ["cell", "gpi", "lon", "lat"]
