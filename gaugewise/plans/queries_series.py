"""Queries over anomalies, scaling, sub-windows, stability and triple collocation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugewise.functions import stats
from gaugewise.operators import bootstrap
from gaugewise.operators.metrics import window_metrics
from gaugewise.operators.moments import recurring_cells, yearly_cells
from gaugewise.operators.scaling import CDF_PERCENTILES, scale
from gaugewise.operators.series import climatology_anomaly, moving_anomaly, moving_mean
from gaugewise.operators.stability import stability_slopes
from gaugewise.operators.subwindows import MONTHS, SEASONS
from gaugewise.plans import canonical as c
from gaugewise.plans.queries_match import MATCHED, SQL_PAIR, SQL_R, matched_three
from gaugewise.plans.queries_scan import OBS
from gaugewise.plans.registry import e6, query, r6, s6, sql_time_text, time_text

TRIPLE = """triple AS (SELECT gpi, ts, s + e1 AS x, 0.8 * s + e2 AS y, 1.1 * s + 2 * e3 AS z FROM (
  SELECT l_suppkey AS gpi, l_shipdate AS ts, avg(l_quantity) AS s, 100 * avg(l_discount) AS e1,
    100 * avg(l_tax) AS e2, avg(l_linenumber) AS e3 FROM lineitem GROUP BY 1, 2))"""


# --- anomalies --------------------------------------------------------------------------------


@query(
    "moving_average_35d",
    f"""WITH {OBS} SELECT dataset, gpi, {sql_time_text('ts')}, {s6('''avg(value) OVER (PARTITION BY dataset, gpi
        ORDER BY ts RANGE BETWEEN INTERVAL 420 HOUR PRECEDING AND INTERVAL 420 HOUR FOLLOWING)''', 'mean')} FROM obs""",
)
def moving_average_35d(spark, d):
    averaged = moving_mean(c.observations(spark, d), 35, ["dataset", "gpi"], unique=True)
    return averaged.select("dataset", "gpi", time_text(), r6("mean"))


@query(
    "anomaly_ma35",
    f"""WITH {OBS} SELECT dataset, gpi, {sql_time_text('ts')}, {s6('''value - avg(value) OVER (
        PARTITION BY dataset, gpi ORDER BY ts
        RANGE BETWEEN INTERVAL 420 HOUR PRECEDING AND INTERVAL 420 HOUR FOLLOWING)''', 'anomaly')} FROM obs""",
)
def anomaly_ma35(spark, d):
    anomalies = moving_anomaly(c.observations(spark, d), 35, ["dataset", "gpi"], unique=True)
    return anomalies.select("dataset", "gpi", time_text(), r6("value", "anomaly"))


@query(
    "anomaly_ma_irregular",
    f"""SELECT user_id AS gpi, event_type AS dataset, {sql_time_text('ts')}, {s6('''value - avg(value) OVER (
        PARTITION BY user_id, event_type ORDER BY ts
        RANGE BETWEEN INTERVAL 84 HOUR PRECEDING AND INTERVAL 84 HOUR FOLLOWING)''', 'anomaly')} FROM events""",
)
def anomaly_ma_irregular(spark, d):
    """Seven-day moving average of series with microsecond times."""
    anomalies = moving_anomaly(c.irregular(spark, d), 7, ["dataset", "gpi"])
    return anomalies.select("gpi", "dataset", time_text(), r6("value", "anomaly"))


_BASELINE = ("1996-01-01", "1999-12-31")
_CLIM_SQL = f"""clim AS (SELECT dataset, gpi, dayofyear(ts) AS doy, avg(value) FILTER (WHERE
    ts >= TIMESTAMP '{_BASELINE[0]}' AND ts <= TIMESTAMP '{_BASELINE[1]}') AS clim FROM obs GROUP BY 1, 2, 3)"""


@query(
    "anomaly_climatology",
    f"""WITH {OBS}, {_CLIM_SQL} SELECT o.dataset, o.gpi, {sql_time_text('o.ts', 'ts')},
        {s6('o.value - c.clim', 'anomaly')} FROM obs o JOIN clim c
        ON o.dataset = c.dataset AND o.gpi = c.gpi AND dayofyear(o.ts) = c.doy""",
)
def anomaly_climatology(spark, d):
    anomalies = climatology_anomaly(c.observations(spark, d), *_BASELINE, keys=["dataset", "gpi"])
    return anomalies.select("dataset", "gpi", time_text(), r6("value", "anomaly"))


@query(
    "anomaly_climatology_smoothed",
    f"""WITH {OBS}, {_CLIM_SQL},
        wrapped AS (SELECT dataset, gpi, doy, clim, doy + s AS pos, s FROM clim, (VALUES (-366), (0), (366)) v(s)),
        smooth AS (SELECT * FROM (SELECT dataset, gpi, doy, s, avg(clim) OVER (PARTITION BY dataset, gpi ORDER BY pos
          RANGE BETWEEN 17 PRECEDING AND 17 FOLLOWING) AS clim FROM wrapped) WHERE s = 0)
        SELECT o.dataset, o.gpi, {sql_time_text('o.ts', 'ts')}, {s6('o.value - c.clim', 'anomaly')}
        FROM obs o JOIN smooth c ON o.dataset = c.dataset AND o.gpi = c.gpi AND dayofyear(o.ts) = c.doy""",
)
def anomaly_climatology_smoothed(spark, d):
    """Climatology averaged over 35 days of the year, across the turn of the year."""
    anomalies = climatology_anomaly(c.observations(spark, d), *_BASELINE, keys=["dataset", "gpi"], smooth_days=35)
    return anomalies.select("dataset", "gpi", time_text(), r6("value", "anomaly"))


# --- scaling ----------------------------------------------------------------------------------

_SCALE_SQL = {
    "min_max": "({y} - min({y}) OVER g) / nullif(max({y}) OVER g - min({y}) OVER g, 0)"
    " * (max(A) OVER g - min(A) OVER g) + min(A) OVER g",
    "mean_std": "({y} - avg({y}) OVER g) / nullif(stddev_pop({y}) OVER g, 0) * stddev_pop(A) OVER g + avg(A) OVER g",
    "linreg": "CASE WHEN var_pop({y}) OVER g > 0 THEN avg(A) OVER g + covar_pop(A, {y}) OVER g"
    " / var_pop({y}) OVER g * ({y} - avg({y}) OVER g) END",
}


def _register_scaling(name, method):
    def run(spark, d):
        scaled = scale(matched_three(spark, d), method, "A", ["N", "R"])
        return scaled.select("gpi", time_text(), r6("A"), r6("N"), r6("R"))

    columns = ", ".join(s6(_SCALE_SQL[method].format(y=y), y) for y in ("N", "R"))
    query(
        name,
        f"WITH {MATCHED} SELECT gpi, {sql_time_text('ts')}, {s6('A')}, {columns} FROM matched "
        "WINDOW g AS (PARTITION BY gpi)",
    )(run)


for _name, _method in [("scale_min_max", "min_max"), ("scale_mean_std", "mean_std"), ("scale_linreg", "linreg")]:
    _register_scaling(_name, _method)

_PROBS = "[" + ", ".join(str(p / 100) for p in CDF_PERCENTILES) + "]"
_LAST = len(CDF_PERCENTILES) - 1


def _cdf_sql(y):
    fits = f"list_filter(range(1, {_LAST + 1}), lambda k: q{y}[k + 1] > q{y}[k] AND {y} <= q{y}[k + 1])"
    wide = f"list_filter(range(1, {_LAST + 1}), lambda k: q{y}[k + 1] > q{y}[k])"
    return f"coalesce(({fits})[1], ({wide})[-1])"


@query(
    "scale_cdf_percentile",
    f"""WITH {MATCHED}, q AS (SELECT gpi, quantile_cont(A, {_PROBS}) AS qA, quantile_cont(N, {_PROBS}) AS qN,
          quantile_cont(R, {_PROBS}) AS qR FROM matched GROUP BY gpi),
        k AS (SELECT m.*, qA, qN, qR, {_cdf_sql('N')} AS kN, {_cdf_sql('R')} AS kR FROM matched m JOIN q USING (gpi))
        SELECT gpi, {sql_time_text('ts')}, {s6('A')},
          {s6('qA[kN] + (N - qN[kN]) / (qN[kN + 1] - qN[kN]) * (qA[kN + 1] - qA[kN])', 'N')},
          {s6('qA[kR] + (R - qR[kR]) / (qR[kR + 1] - qR[kR]) * (qA[kR + 1] - qA[kR])', 'R')} FROM k""",
)
def scale_cdf_percentile(spark, d):
    scaled = scale(matched_three(spark, d), "cdf_match", "A", ["N", "R"])
    return scaled.select("gpi", time_text(), r6("A"), r6("N"), r6("R"))


# The distribution function by Simpson's rule on each half of [0, 1], over v = x^(a / m) with a whole m that leaves
# no singular end (and the same from the other side): another integration than the operator's.
_CELLS = 8000


def _beta_density(j):
    return f"pow(({j}) * h, m - 1) * pow(1 - pow(({j}) * h, g), b - 1)"


def _beta_newton(u):
    return f"{u} - (c0 * {u} + c1 * {u} * {u} / 2 + c2 * {u} * {u} * {u} / 3 - r) / (c0 + c1 * {u} + c2 * {u} * {u})"


_PIECES = [((p1 - p0) / 100, k) for k, (p0, p1) in enumerate(zip(CDF_PERCENTILES, CDF_PERCENTILES[1:]), start=1)]
_UNIT_MEAN = " + ".join(f"{w!r} * (u[{k}] + u[{k + 1}]) / 2" for w, k in _PIECES)
_UNIT_SQUARE = " + ".join(f"{w!r} * (u[{k}] * u[{k}] + u[{k}] * u[{k + 1}] + u[{k + 1}] * u[{k + 1}]) / 3" for w, k in _PIECES)
_REPEATS = " OR ".join(f"q[{k + 1}] <= q[{k}]" for _, k in _PIECES)
_BETA_SQL = f"""points AS (SELECT gpi, 'A' AS s, quantile_cont(A, {_PROBS}) AS q FROM matched GROUP BY gpi
      UNION ALL SELECT gpi, 'N', quantile_cont(N, {_PROBS}) FROM matched GROUP BY gpi
      UNION ALL SELECT gpi, 'R', quantile_cont(R, {_PROBS}) FROM matched GROUP BY gpi),
    units AS (SELECT *, list_transform(q, lambda v: (v - q[1]) / (q[{_LAST + 1}] - q[1])) AS u FROM points
      WHERE q[{_LAST + 1}] > q[1] AND ({_REPEATS})),
    spreads AS (SELECT *, {_UNIT_MEAN} AS m, {_UNIT_SQUARE} AS sq FROM units),
    fits AS (SELECT *, m * (m * (1 - m) / (sq - m * m) - 1) AS a, (1 - m) * (m * (1 - m) / (sq - m * m) - 1) AS b
      FROM spreads WHERE sq > m * m AND m * (1 - m) > sq - m * m),
    sides AS (SELECT gpi, s, 'lo' AS side, b, ceil(6 * a) AS m, ceil(6 * a) / a AS g FROM fits
      UNION ALL SELECT gpi, s, 'hi', a, ceil(6 * b), ceil(6 * b) / b FROM fits),
    halves AS (SELECT *, pow(0.5, 1 / g) / {_CELLS} AS h FROM sides),
    cells AS (SELECT *, {_beta_density('k')} AS f0, {_beta_density('k + 0.5')} AS fm, {_beta_density('k + 1')} AS f1,
        h * g * ({_beta_density('k')} + 4 * {_beta_density('k + 0.5')} + {_beta_density('k + 1')}) / 6 AS mass
      FROM halves, range({_CELLS}) t(k)),
    summed AS (SELECT *, sum(mass) OVER (PARTITION BY gpi, s, side ORDER BY k) AS upto, sum(mass) OVER (PARTITION BY gpi, s) AS total
      FROM cells),
    asked AS (SELECT *, CASE side WHEN 'lo' THEN p ELSE 1 - p END * total - upto + mass AS rest
      FROM summed, (SELECT unnest({_PROBS}) AS p) WHERE p > 0 AND p < 1),
    -- inside a cell the density is the parabola through its three values; three steps of Newton's method
    hits AS (SELECT gpi, s, side, p, g, h, k, rest / h / g AS r, f0 AS c0, 4 * fm - 3 * f0 - f1 AS c1, 2 * f0 + 2 * f1 - 4 * fm AS c2,
      rest / mass AS u0 FROM asked WHERE rest > 0 AND rest <= mass),
    once AS (SELECT *, {_beta_newton('u0')} AS u1 FROM hits),
    twice AS (SELECT *, {_beta_newton('u1')} AS u2 FROM once),
    thrice AS (SELECT *, {_beta_newton('u2')} AS u3 FROM twice),
    ends AS (SELECT gpi, s, side, p, pow((k + {_beta_newton('u3')}) * h, g) AS x FROM thrice),
    placed AS (SELECT gpi, s, p, CASE side WHEN 'lo' THEN x ELSE 1 - x END AS x FROM ends),
    fitted AS (SELECT gpi, s, list(q[1] + x * (q[{_LAST + 1}] - q[1]) ORDER BY p) AS f FROM (SELECT gpi, s, p, x FROM placed
        UNION ALL SELECT gpi, s, 0, 0 FROM fits UNION ALL SELECT gpi, s, 1, 1 FROM fits) JOIN fits USING (gpi, s) GROUP BY gpi, s),
    even AS (SELECT gpi, s, list_transform({_PROBS}, lambda p: q[1] + p * (q[{_LAST + 1}] - q[1])) AS f FROM spreads
      WHERE (gpi, s) NOT IN (SELECT (gpi, s) FROM fits)),
    final AS (SELECT gpi, s, coalesce(fitted.f, even.f, q) AS q FROM points LEFT JOIN fitted USING (gpi, s) LEFT JOIN even USING (gpi, s))"""


def _beta_query(source):
    return f"""WITH {source}, {_BETA_SQL}, q AS (SELECT gpi, max(q) FILTER (WHERE s = 'A') AS qA,
          max(q) FILTER (WHERE s = 'N') AS qN, max(q) FILTER (WHERE s = 'R') AS qR FROM final GROUP BY gpi),
        k AS (SELECT m.*, qA, qN, qR, {_cdf_sql('N')} AS kN, {_cdf_sql('R')} AS kR FROM matched m JOIN q USING (gpi))
        SELECT gpi, {sql_time_text('ts')}, {s6('A')},
          {s6('qA[kN] + (N - qN[kN]) / (qN[kN + 1] - qN[kN]) * (qA[kN + 1] - qA[kN])', 'N')},
          {s6('qA[kR] + (R - qR[kR]) / (qR[kR + 1] - qR[kR]) * (qA[kR + 1] - qA[kR])', 'R')} FROM k"""


@query("scale_cdf_beta", _beta_query(MATCHED))
def scale_cdf_beta(spark, d):
    """Percentile matching where repeated percentiles come from a fitted beta distribution."""
    scaled = scale(matched_three(spark, d), "cdf_beta_match", "A", ["N", "R"])
    return scaled.select("gpi", time_text(), r6("A"), r6("N"), r6("R"))


#: Values cut off below, so that percentiles repeat at every location.
_COARSE = "greatest({0}, 12)"


@query(
    "scale_cdf_beta_coarse",
    _beta_query(f"{MATCHED.replace('matched AS', 'fine AS')}, matched AS (SELECT gpi, ts, A, {_COARSE.format('N')} AS N, "
                f"{_COARSE.format('R')} AS R FROM fine)"),
)
def scale_cdf_beta_coarse(spark, d):
    """The same over values cut off below, where every location needs the fit."""
    clipped = matched_three(spark, d).selectExpr("gpi", "ts", "A", *[f"{_COARSE.format(n)} AS {n}" for n in ("N", "R")])
    scaled = scale(clipped, "cdf_beta_match", "A", ["N", "R"])
    return scaled.select("gpi", time_text(), r6("A"), r6("N"), r6("R"))


# --- sub-windows and stability ----------------------------------------------------------------

def long_sql(by, pairs="pairs", metrics=SQL_PAIR):
    """All metrics and the status of every ``by`` and combo of ``pairs`` (combo, x, y), as SQL."""
    wide = ", ".join(f"CAST({sql} AS DOUBLE) AS {m}" for m, sql in metrics.items())
    values = ", ".join(
        f"{{'metric': '{m}', 'value': {m if m == 'n_obs' else f'CASE WHEN n_obs >= {stats.MIN_OBS} THEN {m} END'}}}" for m in metrics
    )
    status = f"{{'metric': 'status', 'value': CASE WHEN n_obs >= {stats.MIN_OBS} THEN 0::DOUBLE ELSE 1 END}}"
    return f"""SELECT {by}, combo, e.metric AS metric, e.value AS value FROM (
        SELECT *, unnest([{values}, {status}]) AS e FROM (SELECT {by}, combo, {wide} FROM {pairs} GROUP BY {by}, combo))"""


def _tsw_run(cells):
    def run(spark, d):
        metrics = window_metrics(c.triple(spark, d), "x", ["y", "z"], cells)
        return metrics.select("gpi", "tsw", "combo", "metric", r6("value"))

    return run


def recurring_sql(windows, overlap):
    """``labelled``: the rows of ``triple`` in every window, and in bulk."""
    rows = ", ".join(f"('{w.name}', {w.first[0]}, {w.last[0]}, {int(w.last < w.first)})" for w in windows)
    return f"""w AS (SELECT name,
          make_date(y, m1, 1) - {overlap} AS s, last_day(make_date(y + wraps, m2, 1)) + {overlap} AS e
        FROM (VALUES {rows}) v(name, m1, m2, wraps), range(1990, 2010) t(y)),
        labelled AS (SELECT DISTINCT t.gpi, t.ts, t.x, t.y, t.z, w.name AS tsw FROM triple t
          JOIN w ON CAST(t.ts AS DATE) BETWEEN w.s AND w.e
          UNION ALL SELECT gpi, ts, x, y, z, 'bulk' FROM triple)"""


YEARS_SQL = """labelled AS (SELECT gpi, ts, x, y, z, CAST(year(ts) AS VARCHAR) AS tsw FROM triple
          UNION ALL SELECT gpi, ts, x, y, z, 'bulk' FROM triple)"""


def _tsw_sql(labelled):
    return f"""WITH {TRIPLE}, {labelled}, pairs AS (SELECT gpi, tsw, 'x_and_y' AS combo, x, y FROM labelled
          UNION ALL SELECT gpi, tsw, 'x_and_z', x, z FROM labelled), long AS ({long_sql('gpi, tsw')})
        SELECT gpi, tsw, combo, metric, {s6('value')} FROM long"""


for _name, _windows, _overlap in (
    ("tsw_seasons", SEASONS, 0),
    ("tsw_months_overlap", MONTHS, 10),
    ("tsw_seasons_max_overlap", SEASONS, 185),
):
    query(_name, _tsw_sql(recurring_sql(_windows, _overlap)))(_tsw_run(recurring_cells(_windows, _overlap)))
query("tsw_years_bulk", _tsw_sql(YEARS_SQL))(_tsw_run(yearly_cells()))


SLOPES_SQL = f"""yearly AS (SELECT gpi, year(ts) AS year, combo, {SQL_R} AS R, {SQL_PAIR['BIAS']} AS BIAS,
          {SQL_PAIR['urmsd']} AS urmsd, count(*) AS n FROM timed GROUP BY 1, 2, 3),
        slopes AS (SELECT gpi, year, combo, 'slopeR' AS metric, R AS v FROM yearly WHERE n >= {stats.MIN_OBS}
          UNION ALL SELECT gpi, year, combo, 'slopeBIAS', BIAS FROM yearly WHERE n >= {stats.MIN_OBS}
          UNION ALL SELECT gpi, year, combo, 'slopeURMSD', urmsd FROM yearly WHERE n >= {stats.MIN_OBS}),
        trend AS (SELECT a.gpi, 'bulk' AS tsw, a.combo, a.metric,
          10 * median((b.v - a.v) / (b.year - a.year)) FILTER (WHERE b.year > a.year) AS value
        FROM slopes a JOIN slopes b ON a.gpi = b.gpi AND a.metric = b.metric AND a.combo = b.combo
        WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.gpi, a.combo, a.metric)"""


@query(
    "stability_theilsen",
    f"""WITH {TRIPLE}, timed AS (SELECT gpi, ts, 'x_and_y' AS combo, x, y FROM triple
          UNION ALL SELECT gpi, ts, 'x_and_z', x, z FROM triple), {SLOPES_SQL}
        SELECT gpi, tsw, combo, metric, {s6('value')} FROM trend""",
)
def stability_theilsen(spark, d):
    metrics = window_metrics(c.triple(spark, d), "x", ["y", "z"], yearly_cells())
    return stability_slopes(metrics).select("gpi", "tsw", "combo", "metric", r6("value"))


# --- triple collocation -----------------------------------------------------------------------

_Q = """q AS (SELECT gpi, var_samp(x) AS qxx, var_samp(y) AS qyy, var_samp(z) AS qzz, covar_samp(x, y) AS qxy,
  covar_samp(x, z) AS qxz, covar_samp(y, z) AS qyz FROM triple GROUP BY gpi)"""


def _noise(own, opposite, a, b):
    return f"CASE WHEN {own} * {opposite} / ({a} * {b}) - 1 > 0 THEN -10 * log10({own} * {opposite} / ({a} * {b}) - 1) END"


TC_SQL = {
    "snr": {
        "x": _noise("qxx", "qyz", "qxy", "qxz"),
        "y": _noise("qyy", "qxz", "qxy", "qyz"),
        "z": _noise("qzz", "qxy", "qxz", "qyz"),
    },
    "beta": {"x": "CAST(1 AS DOUBLE)", "y": "qxz / qyz", "z": "qxy / qyz"},
    "err_std": {
        "x": "CASE WHEN qxx - qxy * qxz / qyz >= 0 THEN sqrt(qxx - qxy * qxz / qyz) END",
        "y": "CASE WHEN qyy - qxy * qyz / qxz >= 0 THEN sqrt(qyy - qxy * qyz / qxz) * abs(qxz / qyz) END",
        "z": "CASE WHEN qzz - qxz * qyz / qxy >= 0 THEN sqrt(qzz - qxz * qyz / qxy) * abs(qxy / qyz) END",
    },
}


def _register_triple(metric, source, sql_source, names):
    def run(spark, d):
        wide = source(spark, d).groupBy("gpi").agg(*map(F.expr, stats.triple_moments(*names)))
        return wide.selectExpr(
            "gpi", *[e6(stats.triple_metric(metric, side), f"{metric}_{side}") for side in "xyz"]
        )

    columns = ", ".join(s6(TC_SQL[metric][side], f"{metric}_{side}") for side in "xyz")
    return run, f"WITH {sql_source}, {_Q} SELECT gpi, {columns} FROM q"


for _metric in stats.TRIPLE_METRICS:
    _run, _sql = _register_triple(_metric, c.triple, TRIPLE, ("x", "y", "z"))
    query(f"tcol_{_metric}", _sql)(_run)

# uncorrelated series: exercises the undefined cases
_run, _sql = _register_triple(
    "snr", matched_three, f"{MATCHED}, triple AS (SELECT gpi, A AS x, N AS y, R AS z FROM matched)", ("A", "N", "R")
)
query("tcol_snr_uncorrelated", _sql)(_run)

# weights written anew: an integer cut from the hash, held against the cumulated probabilities of Poisson(1)
_DRAW = "('0x' || substr(md5(gpi || '|' || epoch_us(ts) || '|' || (rep // 8)), CAST(rep % 8 * 4 + 1 AS BIGINT), 4))::INTEGER"
_CUMULATED = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]
_W = " + ".join(f"CAST(u >= {limit} AS INTEGER)" for limit in _CUMULATED)
_BOOT_Q = {name: f"(sum(w * {name[0]} * {name[1]}) - sum(w * {name[0]}) * sum(w * {name[1]}) / sum(w)) / (sum(w) - 1)"
           for name in ("xx", "yy", "zz", "xy", "xz", "yz")}
_TAIL = (1 - bootstrap.CONFIDENCE) / 2


def _interval(q):
    return f"CASE WHEN any_value(n) >= {stats.MIN_OBS} THEN quantile_cont(value, {q!r}) END"




def intervals_sql(source, by):
    """``intervals``: the bootstrap intervals of the rows (by, ts, x, y, z) of ``source``."""
    return f"""draws AS (SELECT {by}, rep, x, y, z, {_DRAW} AS u FROM {source}, range(0, {bootstrap.REPLICATES}) t(rep)),
        counts AS (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}),
        weighted AS (SELECT {by}, rep, x, y, z, {_W} AS w FROM draws),
        q AS (SELECT {by}, rep, {', '.join(f'{e} AS q{n}' for n, e in _BOOT_Q.items())} FROM weighted WHERE w > 0
          GROUP BY {by}, rep HAVING sum(w) > 1),
        drawn AS ({' UNION ALL '.join(
            f"SELECT {by}, '{m}' AS metric, '{side}' AS dataset, {sql} AS value FROM q"
            for m, sides in TC_SQL.items() for side, sql in sides.items())}),
        intervals AS (SELECT {by}, metric, dataset, {_interval(_TAIL)} AS lower, {_interval(1 - _TAIL)} AS upper
          FROM drawn JOIN counts USING ({by}) GROUP BY {by}, metric, dataset)"""


@query(
    "tcol_bootstrap_ci",
    f"""WITH {TRIPLE}, {intervals_sql('triple', 'gpi')}
        SELECT gpi, metric, dataset, {s6('lower')}, {s6('upper')} FROM intervals""",
)
def tcol_bootstrap_ci(spark, d):
    intervals = bootstrap.triple_intervals(c.triple(spark, d), ["x", "y", "z"])
    return intervals.select("gpi", "metric", "dataset", r6("lower"), r6("upper"))
