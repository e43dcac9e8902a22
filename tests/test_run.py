"""End to end: dataset folders and a JSON configuration in, result tables out."""

import json
from pathlib import Path

import pytest

from gaugewise.config import parse_run
from gaugewise.plans import canonical as c
from gaugewise.plans import queries_run
from gaugewise.plans.validation import ValidationPlan, run_validation
from gaugewise.sinks import results as sink


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """Three gridded datasets on the same points."""
    root = tmp_path_factory.mktemp("datasets")
    points = c.points(spark, sf_dir).select("gpi", "lon", "lat", "network")
    rows = c.quality_rows(spark, sf_dir)
    for name, flag in (("A", "G"), ("N", "N"), ("R", "R")):
        points.write.parquet(f"{root}/{name}/points")
        rows.where(f"soil_moisture_flag = '{flag}'").write.parquet(f"{root}/{name}/series")
    return root


def config(folders, **fields):
    def dataset(number, name, **extra):
        return {
            "id": number,
            "dataset": {
                "short_name": name,
                "storage_path": f"{folders}/{name}",
                "reader": "GriddedNcOrthoMultiTs",
                "resolution": {"value": 1, "unit": "km"},
            },
            "version": {"short_name": "v1"},
            "variable": {"short_name": "soil_moisture", "min_value": 0, "max_value": 48},
            "filters": ["FIL_ALL_VALID_RANGE"],
            **extra,
        }

    return {
        "validation_run": {
            "id": 7,
            "temporal_matching": 144,
            "spatial_reference_configuration": 1,
            "temporal_reference_configuration": 1,
            "scaling_ref": 1,
            "dataset_configurations": [dataset(1, "A"), dataset(2, "N"), dataset(3, "R")],
            **fields,
        }
    }


def brute_force(spark, folders, half_days=3):
    """Matched values (gpi, a, n, r) by comparing every pair of rows."""
    import duckdb

    return duckdb.sql(f"""
        WITH s AS (
          SELECT 'A' AS d, gpi, ts, soil_moisture AS v FROM read_parquet('{folders}/A/series/*.parquet')
          UNION ALL SELECT 'N', gpi, ts, min(soil_moisture) FROM read_parquet('{folders}/N/series/*.parquet')
            WHERE soil_moisture BETWEEN 0 AND 48 GROUP BY gpi, ts
          UNION ALL SELECT 'R', gpi, ts, min(soil_moisture) FROM read_parquet('{folders}/R/series/*.parquet')
            WHERE soil_moisture BETWEEN 0 AND 48 GROUP BY gpi, ts),
        refs AS (SELECT row_number() OVER () AS id, gpi, ts, v FROM s WHERE d = 'A' AND v BETWEEN 0 AND 48),
        cand AS (SELECT refs.id, refs.gpi, refs.v AS a, s.d, s.v AS y, row_number() OVER (PARTITION BY refs.id, s.d
            ORDER BY abs(epoch_us(s.ts) - epoch_us(refs.ts)), s.ts) AS k
          FROM refs JOIN s ON refs.gpi = s.gpi AND s.d <> 'A'
            AND abs(epoch_us(s.ts) - epoch_us(refs.ts)) <= {half_days} * 86400000000)
        SELECT gpi, a, max(y) FILTER (WHERE d = 'N') AS n, max(y) FILTER (WHERE d = 'R') AS r
        FROM cand WHERE k = 1 GROUP BY id, gpi, a HAVING count(*) = 2""").df()


def test_full_run(spark, folders, tmp_path):
    run = parse_run(config(folders, tcol=True))
    result = run_validation(spark, run, str(tmp_path))
    expected = brute_force(spark, folders)
    got = {r["gpi"]: r.asDict() for r in spark.read.parquet(result.table).collect()}
    assert result.total == 10 and result.ok + result.error == 10
    assert set(expected.gpi) <= set(got)
    for gpi, group in expected.groupby("gpi"):
        row = got[gpi]
        assert row["n_obs_between_0-A_and_1-N"] == len(group)
        assert row["R_between_0-A_and_1-N"] == pytest.approx(group.a.corr(group.n))
        assert row["BIAS_between_0-A_and_2-R"] == pytest.approx(group.a.mean() - group.r.mean())
        assert row["network"].startswith("NATION_")
        assert row["rho_between_0-A_and_1-N"] == pytest.approx(group.a.rank().corr(group.n.rank()))
    assert result.table.endswith("0-A.soil_moisture_with_1-N.soil_moisture_with_2-R.soil_moisture")
    assert "snr_0-A_between_0-A_and_1-N_and_2-R" in got[0]
    stored = dict(spark.read.parquet(f"{result.path}/run_metadata").collect())
    assert stored["val_dc_dataset0"] == "A" and stored["val_ref"] == "val_dc_dataset0"
    assert stored["total_points"] == "10" and stored["progress"] == "100"
    summary = sink.read_summary_csv(spark, f"{result.path}/summary")
    assert summary.where("metric = 'R' AND combo = '0-A_and_1-N'").count() == 1
    assert dict(summary.dtypes)["mean"] == "string"


def test_run_with_every_group_hot(spark, folders, crowded):
    run = parse_run(config(folders, scaling_method="mean_std", min_lat=-89, min_lon=-180, max_lat=89, max_lon=180))
    plan = ValidationPlan(spark, run)
    points = plan.reference_points()
    got = {(r.gpi, r.combo, r.metric): r.value for r in plan.metrics(plan.matched(points)).collect()}
    expected = brute_force(spark, folders)
    for gpi, group in expected.groupby("gpi"):
        assert got[gpi, "0-A_and_1-N", "n_obs"] == len(group)
        assert got[gpi, "0-A_and_1-N", "R"] == pytest.approx(group.a.corr(group.n))
        assert got[gpi, "0-A_and_2-R", "rho"] == pytest.approx(group.a.rank().corr(group.r.rank()))
        assert got[gpi, "0-A_and_1-N", "BIAS"] == pytest.approx(0, abs=1e-9)


def test_batches_resume(spark, folders, tmp_path, monkeypatch):
    run = parse_run(config(folders))
    written = []
    original = sink.write_batch

    def interrupted(results, path, batch_id, **options):
        if written:
            raise RuntimeError("executor lost for good")
        written.append(batch_id)
        original(results, path, batch_id, **options)

    monkeypatch.setattr(sink, "write_batch", interrupted)
    with pytest.raises(RuntimeError):
        run_validation(spark, run, str(tmp_path), batches=3)
    repeated = []

    def counted(results, path, batch_id, **options):
        repeated.append(batch_id)
        original(results, path, batch_id, **options)

    monkeypatch.setattr(sink, "write_batch", counted)
    again = parse_run(config(folders))
    assert again.id != run.id
    result = run_validation(spark, again, str(tmp_path), batches=3)
    assert written and not set(written) & set(repeated) and len(written + repeated) == 3
    metrics = sink.read_results(spark, result.path)
    assert metrics.select("gpi").distinct().count() == 10
    assert metrics.groupBy("gpi", "combo", "metric").count().where("count > 1").count() == 0


@pytest.mark.parametrize(
    "fields",
    [
        {"scaling_method": "mean_std"},
        {"scaling_method": "cdf_beta_match"},
        {"anomalies": "moving_avg_35_d", "interval_from": "1996-01-01", "interval_to": "2000-12-31"},
        {"anomalies": "climatology", "anomalies_from": "1996-01-01", "anomalies_to": "1999-12-31"},
        {"upscaling_method": "average", "temporal_stability": True},
        {"intra_annual_metrics": True, "intra_annual_type": "Seasonal", "intra_annual_overlap": 20},
        {"stability_metrics": True, "interval_from": "1996-01-01", "interval_to": "2000-12-31"},
        {"tcol": True, "bootstrap_tcol_cis": True},
        {"min_lat": -80, "min_lon": -170, "max_lat": 80, "max_lon": 200},
    ],
    ids=lambda f: next(iter(f)) + "_" + str(next(iter(f.values()))),
)
def test_options_run(spark, folders, tmp_path, fields):
    run = parse_run(config(folders, **fields))
    plan = ValidationPlan(spark, run)
    points = plan.reference_points()
    metrics = plan.metrics(plan.matched(points))
    wide = plan.wide(metrics, points)
    rows = wide.collect()
    assert len(rows) == points.count()
    windows = plan.windows(metrics)
    prefix = "bulk|" if windows else ""
    assert any(r[f"{prefix}n_obs_between_0-A_and_1-N"] for r in rows)
    if fields.get("stability_metrics"):
        assert "bulk|slopeURMSD_between_0-A_and_2-R" in wide.columns and "1996|R_between_0-A_and_1-N" in wide.columns
    if fields.get("bootstrap_tcol_cis"):
        lower, upper = "snr_ci_lower_0-A_between_0-A_and_1-N_and_2-R", "snr_ci_upper_0-A_between_0-A_and_1-N_and_2-R"
        assert all(r[lower] <= r[upper] for r in rows if r[lower] is not None)


def station_config(**fields):
    entries = queries_run._entry(1, "A"), queries_run._entry(2, "S", "ISMN_Interface", km=20_000, **fields.pop("stations", {}))
    return parse_run({"validation_run": {
        "id": 1, "temporal_matching": 144, "spatial_reference_configuration": 1, "temporal_reference_configuration": 1,
        "dataset_configurations": list(entries), **fields}})


def station_sources(spark, sf_dir):
    return {1: queries_run._grid(spark, sf_dir, "A"), 2: queries_run._sensors(spark, sf_dir)}


def test_batches_do_not_change_upscaled_results(spark, sf_dir, tmp_path):
    run = station_config(upscaling_method="average")
    found = []
    for batches in (1, 3, 7):
        result = run_validation(spark, run, str(tmp_path), batches, station_sources(spark, sf_dir))
        rows = sink.read_results(spark, result.path).where("metric IN ('n_obs', 'BIAS', 'R', 'status')").select("gpi", "combo", "metric", "value")
        found.append(sorted((r.gpi, r.combo, r.metric, None if r.value is None else round(r.value, 9)) for r in rows.collect()))
    assert found[0] == found[1] == found[2] and any(value for *_, value in found[0])


def test_unknown_network_leaves_nothing(spark, sf_dir):
    none = {"parametrised_filters": [{"filter": {"name": "FIL_ISMN_NETWORKS"}, "parameters": "no such network"}]}
    plan = ValidationPlan(spark, station_config(stations=none), station_sources(spark, sf_dir))
    assert plan.matched(plan.reference_points()).count() == 0


def test_intermediate_results_are_removed(spark, sf_dir, tmp_path):
    from gaugewise.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark)) / "gaugewise"
    before = set(folder.iterdir()) if folder.exists() else set()
    run_validation(spark, station_config(), str(tmp_path), 2, station_sources(spark, sf_dir))
    assert set(folder.iterdir()) <= before


def test_unknown_filters_are_logged(monkeypatch):
    from gaugewise.config import Variable
    from gaugewise.operators import filters

    said = []
    monkeypatch.setattr(filters.LOG, "warning", lambda text, *values: said.append(text % values))
    filters.keep(Variable("value", 0, 1), ["FIL_NO_SUCH", filters.FRM], [(filters.NETWORKS, "x")])
    assert said == ["no filter 'FIL_NO_SUCH'; it is left out"]


def test_exclusive_options(spark, folders):
    run = parse_run(
        config(folders, intra_annual_metrics=True, intra_annual_type="Monthly", stability_metrics=True)
    )
    with pytest.raises(ValueError):
        ValidationPlan(spark, run)
    for wrong in ({"scaling_method": "magic"}, {"upscaling_method": "x"}, {"intra_annual_metrics": True}):
        with pytest.raises(ValueError, match="has to be one of"):
            ValidationPlan(spark, parse_run(config(folders, **wrong)))
    one = config(folders)
    del one["validation_run"]["dataset_configurations"][1:]
    with pytest.raises(ValueError, match="two"):
        ValidationPlan(spark, parse_run(one))


def test_cli_run(spark, folders, tmp_path):
    from gaugewise.cli import main

    file = tmp_path / "run.json"
    file.write_text(json.dumps(config(folders)))
    assert main([str(file), "--output", str(tmp_path / "out"), "--log-level", "ERROR"]) == 0
    assert list(tmp_path.glob("out/*/statistics.zip"))
    broken = config(folders)
    broken["validation_run"]["dataset_configurations"][0]["dataset"]["storage_path"] = "/no/such/place"
    file.write_text(json.dumps(broken))
    assert main([str(file), "--output", str(tmp_path / "out"), "--log-level", "CRITICAL"]) == 1
