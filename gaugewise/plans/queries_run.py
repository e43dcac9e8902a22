"""Configured runs: from a run's JSON fields to its metrics, over sources derived from the tables."""

from __future__ import annotations

from gaugewise.config import parse_run
from gaugewise.functions import stats
from gaugewise.operators import filters as flt
from gaugewise.operators.subwindows import MONTHS
from gaugewise.plans import canonical as c
from gaugewise.plans.queries_match import MATCHED, SQL_R
from gaugewise.plans.queries_results import _LUT, _SENSOR_SERIES, _nearest_sql
from gaugewise.plans.queries_scan import OBS, POINTS, SENSORS
from gaugewise.plans.queries_series import SLOPES_SQL, TC_SQL, TRIPLE, YEARS_SQL, intervals_sql, long_sql, recurring_sql
from gaugewise.plans.registry import query, r6, s6
from gaugewise.plans.validation import ValidationPlan
from gaugewise.sources.loaders import Source

BRANDS = ("Brand#11", "Brand#13", "Brand#22", "Brand#25", "Brand#5")
STATIONS = [
    {"filter": {"name": flt.NETWORKS}, "parameters": ", ".join(BRANDS)},
    {"filter": {"name": flt.DEPTH}, "parameters": "0.2,2.0"},
]


def _entry(number: int, name: str, reader: str = "GriddedNcOrthoMultiTs", km: float = 1, **extra) -> dict:
    return {
        "id": number,
        "dataset": {"short_name": name, "reader": reader, "storage_path": "", "resolution": {"value": km, "unit": "km"}},
        "version": {"short_name": "v1"},
        "variable": {"short_name": "value"},
        **extra,
    }


def _metrics(spark, entries, sources, **fields):
    """All metrics of the run."""
    run = parse_run(
        {
            "validation_run": {
                "id": 1,
                "temporal_matching": 144,
                "spatial_reference_configuration": 1,
                "temporal_reference_configuration": 1,
                "dataset_configurations": entries,
                **fields,
            }
        }
    )
    plan = ValidationPlan(spark, run, sources)
    tidy = plan.metrics(plan.matched(plan.reference_points()))
    return tidy.select(*[c for c in ("gpi", "tsw", "combo", "metric") if c in tidy.columns], r6("value"))


def _grid(spark, d, name):
    return Source(c.points(spark, d), c.dataset(spark, d, name))


def _sensors(spark, d):
    return Source(c.sensors(spark, d), c.sensor_series(spark, d))


def _rho_sql(by: str, pairs: str = "pairs") -> str:
    """Rank correlation of every ``by`` and combo of ``pairs``, ties sharing their average rank."""
    group = f"PARTITION BY {by}, combo"

    def rank(v):
        return f"rank() OVER ({group} ORDER BY {v}) + (count(*) OVER ({group}, {v}) - 1) / 2.0 AS {v}"

    return f"""SELECT {by}, combo, 'rho' AS metric, CASE WHEN count(*) >= {stats.MIN_OBS} THEN {SQL_R} END AS value
      FROM (SELECT {by}, combo, {rank('x')}, {rank('y')} FROM {pairs}) GROUP BY {by}, combo"""


#: All metrics of the rows (gpi, combo, x, y) of ``pairs``.
_LONG = f"{long_sql('gpi')} UNION ALL {_rho_sql('gpi')}"


def _against_reference(other: str, combo: str, where: str = "true") -> str:
    """Nearest match in time of ``other`` (gpi, ts, value) to dataset A at the chosen points."""
    return f"""ref AS (SELECT o.gpi, o.ts, o.value FROM obs o JOIN points p USING (gpi) WHERE dataset = 'A' AND {where}),
      cand AS (SELECT r.gpi, r.ts, r.value AS x, o.value AS y, row_number() OVER (PARTITION BY r.gpi, r.ts
          ORDER BY abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts, o.value) AS k
        FROM ref r JOIN {other} o ON r.gpi = o.gpi AND abs(epoch_us(o.ts) - epoch_us(r.ts)) <= {c.MATCH_HALF_US}),
      pairs AS (SELECT gpi, ts, '{combo}' AS combo, x, y FROM cand WHERE k = 1),
      long AS ({_LONG}) SELECT gpi, combo, metric, {s6('value')} FROM long"""


@query(
    "run_gridded",
    f"""WITH {MATCHED}, pairs AS (SELECT gpi, ts, '0-A_and_1-N' AS combo, A AS x, N AS y FROM matched
        UNION ALL SELECT gpi, ts, '0-A_and_2-R', A, R FROM matched), long AS ({_LONG})
        SELECT gpi, combo, metric, {s6('value')} FROM long""",
)
def run_gridded(spark, d):
    """Three gridded datasets, each placed by its nearest grid point."""
    entries = [_entry(1, "A"), _entry(2, "N"), _entry(3, "R")]
    return _metrics(spark, entries, {k: _grid(spark, d, n) for k, n in ((1, "A"), (2, "N"), (3, "R"))})


_UPSCALED = f"""WITH {OBS}, {POINTS}, {SENSORS}, {_LUT.replace('pairs', 'placed')}, {_SENSOR_SERIES},
  averaged AS (SELECT ref_gpi AS gpi, ts, avg(value) AS value FROM sensor_series JOIN lut USING (gpi) GROUP BY 1, 2),"""


def _upscaled(spark, d, **fields):
    entries = [_entry(1, "A"), _entry(2, "S", "ISMN_Interface", parametrised_filters=[STATIONS[1] | {"parameters": "0,100"}])]
    return _metrics(spark, entries, {1: _grid(spark, d, "A"), 2: _sensors(spark, d)}, upscaling_method="average", **fields)


@query("run_upscaled", f"{_UPSCALED} {_against_reference('averaged', '0-A_and_1-S')}")
def run_upscaled(spark, d):
    """Stations averaged under their nearest point of the reference grid."""
    return _upscaled(spark, d)


@query("run_upscaled_bbox", f"{_UPSCALED} {_against_reference('averaged', '0-A_and_1-S', 'p.lat BETWEEN -60 AND 60')}")
def run_upscaled_bbox(spark, d):
    """A bounding box chooses reference points; it does not move stations to other points."""
    return _upscaled(spark, d, min_lat=-60, max_lat=60, min_lon=-180, max_lon=180)


@query(
    "run_station_filters",
    f"""WITH {OBS}, {POINTS}, {SENSORS}, {_SENSOR_SERIES}, chosen AS (SELECT * FROM sensors
          WHERE network IN ({', '.join(f"'{b}'" for b in BRANDS)}) AND depth_from >= 0.2 AND depth_to <= 2.0),
        {_nearest_sql('points', 'chosen').replace('pairs', 'placed')},
        near AS (SELECT h.gpi, s.ts, s.value FROM hits h JOIN sensor_series s ON s.gpi = h.other WHERE dist <= 3000000),
        {_against_reference('near', '0-A_and_1-S')}""",
)
def run_station_filters(spark, d):
    """The nearest station of some networks and depths, where the stations are not the reference."""
    entries = [_entry(1, "A"), _entry(2, "S", "ISMN_Interface", km=3000, parametrised_filters=STATIONS)]
    return _metrics(spark, entries, {1: _grid(spark, d, "A"), 2: _sensors(spark, d)})


# --- sub-windows, triples and intervals of a run -----------------------------------------------

_SIDES = {"x": "0-A", "y": "1-N", "z": "2-R"}
_TRIPLE_COMBO = "0-A_and_1-N_and_2-R"


def _windowed(spark, d, **fields):
    """Three correlated gridded datasets with triple collocation."""
    entries = [_entry(1, "A"), _entry(2, "N"), _entry(3, "R")]
    triple = c.triple(spark, d)
    sources = {
        k: Source(c.points(spark, d), triple.selectExpr("gpi", "ts", f"{side} AS value")) for k, side in enumerate("xyz", start=1)
    }
    return _metrics(spark, entries, sources, tcol=True, **fields)


def _windowed_sql(labelled: str, more: str, extra: str) -> str:
    by = "gpi, tsw"
    metrics = " UNION ALL ".join(
        f"SELECT {by}, '{_TRIPLE_COMBO}', '{m}_{_SIDES[side]}', CASE WHEN n >= {stats.MIN_OBS} THEN {sql} END FROM spreads"
        for m, sides in TC_SQL.items()
        for side, sql in sides.items()
    )
    return f"""WITH {TRIPLE}, {labelled},
      pairs AS (SELECT {by}, '0-A_and_1-N' AS combo, x, y FROM labelled
        UNION ALL SELECT {by}, '0-A_and_2-R', x, z FROM labelled),
      spreads AS (SELECT {by}, count(*) AS n, var_samp(x) AS qxx, var_samp(y) AS qyy, var_samp(z) AS qzz, covar_samp(x, y) AS qxy,
        covar_samp(x, z) AS qxz, covar_samp(y, z) AS qyz FROM labelled GROUP BY {by}){more},
      long AS ({long_sql(by)} UNION ALL {_rho_sql(by)} UNION ALL {metrics}
        UNION ALL SELECT {by}, '{_TRIPLE_COMBO}', 'status', CASE WHEN n >= {stats.MIN_OBS} THEN 0 ELSE 1 END FROM spreads {extra})
      SELECT gpi, tsw, combo, metric, {s6('value')} FROM long"""


_CASE = "CASE dataset " + " ".join(f"WHEN '{side}' THEN '{name}'" for side, name in _SIDES.items()) + " END"


@query(
    "run_windows_triples_ci",
    _windowed_sql(
        recurring_sql(MONTHS, 10),
        ", " + intervals_sql("labelled", "gpi, tsw"),
        " ".join(
            f"UNION ALL SELECT gpi, tsw, '{_TRIPLE_COMBO}', metric || '_ci_{bound}_' || {_CASE}, {bound} FROM intervals"
            for bound in ("lower", "upper")
        ),
    ),
)
def run_windows_triples_ci(spark, d):
    """Monthly windows with overlap: all pairs, triples and their bootstrap intervals."""
    return _windowed(
        spark, d, intra_annual_metrics=True, intra_annual_type="Monthly", intra_annual_overlap=10, bootstrap_tcol_cis=True
    )


@query(
    "run_stability",
    _windowed_sql(
        YEARS_SQL,
        f""", timed AS (SELECT gpi, ts, '0-A_and_1-N' AS combo, x, y FROM triple
          UNION ALL SELECT gpi, ts, '0-A_and_2-R', x, z FROM triple), {SLOPES_SQL}""",
        "UNION ALL SELECT gpi, tsw, combo, metric, value FROM trend",
    ),
)
def run_stability(spark, d):
    """Yearly windows with the slopes of their metrics."""
    return _windowed(spark, d, stability_metrics=True)
