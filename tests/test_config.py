import json
import zipfile
from datetime import datetime

import pytest

from gaugewise import config as cfg
from gaugewise.cli import build_parser, main
from gaugewise.functions import scalar
from gaugewise.functions.geo import longitude_ranges
from gaugewise.sinks import reports
from gaugewise.sinks.metadata import run_attributes
from gaugewise.sinks.results import batch_path, config_hash


def dataset(number, name, **dataset_fields):
    return {
        "id": number,
        "dataset": {"short_name": name, "reader": "SMAPL3_V9Reader", "storage_path": "/data", **dataset_fields},
        "version": {"short_name": "v1", "time_range_start": "2019-01-01", "time_range_end": "2020-06-30"},
        "variable": {"short_name": "sm", "unit": "m3/m3"},
    }


def payload(**fields):
    run = {
        "id": 10001,
        "name_tag": "demo",
        "interval_from": "2020-01-01",
        "interval_to": "2020-12-31",
        "spatial_reference_configuration": 101,
        "temporal_reference_configuration": {"id": 101},
        "scaling_ref": 102,
        "dataset_configurations": [dataset(102, "OTHER"), dataset(101, "REF"), dataset(103, "THIRD")],
    }
    return {"validation_run": {**run, **fields}}


def test_references_and_names():
    run = cfg.parse_run(payload())
    assert run.spatial_ref.id == 101 and run.temporal_ref.id == 101 and run.scaling_ref.id == 102
    assert run.names == {102: "1-OTHER", 101: "0-REF", 103: "2-THIRD"}
    assert run.config_id == 10001 and run.id != 10001
    assert run.temporal_matching == 12 and run.scaling_method == "none" and run.plots_save_metadata == "threshold"


def test_defaults():
    run = cfg.parse_run({"dataset_configurations": [dataset(5, "ONLY")]})
    assert run.spatial_ref.id == 5 and run.temporal_ref is None and run.period is None
    assert run.name_tag.startswith("validation-")
    assert cfg.parse_run({"validation_run": {"id": 1}}).spatial_ref is None


def test_bad_reference():
    with pytest.raises(ValueError):
        cfg.parse_run(payload(scaling_ref=["101"]))


def test_filters_as_text_or_object():
    entry = dataset(1, "A")
    entry["filters"] = ["FIL_ISMN_GOOD", {"name": "FIL_C3S_FLAG_0", "description": "no flag"}]
    entry["parametrised_filters"] = [
        {"filter": {"name": "FIL_ISMN_DEPTH"}, "parameters": "0,1"},
        {"name": "FIL_ISMN_NETWORKS", "parameters": "X"},
    ]
    run = cfg.parse_run({"dataset_configurations": [entry]})
    assert run.datasets[0].filters == ("FIL_ISMN_GOOD", "FIL_C3S_FLAG_0")
    assert run.datasets[0].parametrised_filters == (("FIL_ISMN_DEPTH", "0,1"), ("FIL_ISMN_NETWORKS", "X"))
    entry["filters"] = [3]
    with pytest.raises(ValueError):
        cfg.parse_run({"dataset_configurations": [entry]})


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2020-01-02", datetime(2020, 1, 2)),
        ("2020-01-02 03:04", datetime(2020, 1, 2, 3, 4)),
        ("2020-01-02 03:04:05", datetime(2020, 1, 2, 3, 4, 5)),
        ("2020-01-02T03:04:05Z", datetime(2020, 1, 2, 3, 4, 5)),
        ("2020-01-02T03:04:05+02:00", datetime(2020, 1, 2, 1, 4, 5)),
        (None, None),
        ("", None),
    ],
)
def test_datetimes(text, expected):
    assert cfg.parse_datetime(text) == expected


@pytest.mark.parametrize("value", ["yesterday", 5])
def test_bad_datetimes(value):
    with pytest.raises(ValueError):
        cfg.parse_datetime(value)


def test_actual_interval():
    run = cfg.parse_run(payload())
    assert cfg.actual_interval(run, run.datasets[0]) == ("2020-01-01", "2020-06-30")
    open_run = cfg.parse_run(payload(interval_to=None))
    assert cfg.actual_interval(open_run, open_run.datasets[0])[0] == "1978-01-01"


def test_hash_depends_on_settings_only():
    first, second = cfg.parse_run(payload()), cfg.parse_run(payload(name_tag="renamed", total_points=9))
    changed = cfg.parse_run(payload(temporal_matching=24))
    assert config_hash(first.settings()) == config_hash(second.settings()) != config_hash(changed.settings())
    assert batch_path("/x", first.settings(), 2) != batch_path("/x", first.settings(), 3)


def test_attributes():
    run = cfg.parse_run(payload(min_lat=1, min_lon=2, max_lat=3, max_lon=4))
    found = run_attributes(run)
    assert found["val_dc_dataset0"] == "REF" and found["val_ref"] == "val_dc_dataset0"
    assert found["val_scaling_ref"] == "val_dc_dataset1" and found["val_spatial_subset"] == "[1, 2, 3, 4]"
    assert found["val_interval_from"] == "2020-01-01 00:00" and found["val_dc_filters2"] == "N/A"
    assert found["val_dc_dataset0_grid_stepsize"] == "nan"


@pytest.mark.parametrize(
    "resolution, metres",
    [({"value": 25, "unit": "km"}, 25_000), ({"value": 0.25, "unit": "deg"}, 25_000), (None, 30_000),
     ({"value": 3}, 30_000), ({"unit": "km"}, 30_000), ({"value": 1, "unit": "mile"}, 30_000)],
)
def test_resolution(resolution, metres):
    assert scalar.resolution_in_m(resolution) == pytest.approx(metres)


@pytest.mark.parametrize(
    "limits, ranges",
    [
        ((-90, 60), [(-90, 60)]),
        ((170, 190), [(170, 180), (-180, -170)]),
        ((190, 200), [(-170, -160)]),
        ((-200, -190), [(160, 170)]),
        ((-190, -170), [(170, 180), (-180, -170)]),
        ((-200, 200), [(-180, 180)]),
    ],
)
def test_longitude_ranges(limits, ranges):
    assert longitude_ranges(*limits) == ranges


@pytest.mark.parametrize("text, expected", [("7", 7), ("-3", 1), ("many", 100), (None, 100)])
def test_env_numbers(monkeypatch, text, expected):
    monkeypatch.delenv("GAUGEWISE_TEST", raising=False)
    if text is not None:
        monkeypatch.setenv("GAUGEWISE_TEST", text)
    assert cfg.env_number("GAUGEWISE_TEST", 100, 1) == expected


def test_parser():
    args = build_parser().parse_args([])
    assert not args.dry_run and args.log_level == "INFO" and args.max_workers is None and args.log_file is None
    args = build_parser().parse_args(["x.json", "--max-workers", "4", "--log-level", "DEBUG"])
    assert args.config == "x.json" and args.max_workers == 4 and args.log_level == "DEBUG"


def test_dry_runs(tmp_path, capsys):
    assert main(["--dry-run"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["datasets"] and told["spatial_reference"] in [d["name"] for d in told["datasets"]]
    empty, broken = tmp_path / "empty.json", tmp_path / "broken.json"
    empty.write_text(json.dumps({"validation_run": {"id": 1}}))
    broken.write_text("{no json")
    assert main([str(empty), "--dry-run"]) == 0
    assert main([str(broken), "--dry-run", "--log-level", "CRITICAL"]) == 1
    with pytest.raises(SystemExit) as stop:
        main(["/no/such.json"])
    assert stop.value.code == 2


def test_statistics_archive(tmp_path):
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "stats.csv").write_text("metric\n")
    archive = reports.collect_statistics(tmp_path)
    assert zipfile.ZipFile(archive).namelist() == ["bulk/stats.csv"]
