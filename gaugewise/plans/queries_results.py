"""Queries over spatial matching, upscaling, result shaping and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.functions.geo import in_bbox
from gaugewise.functions.timing import parse_time
from gaugewise.operators import results
from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_long
from gaugewise.operators.spatial import nearest
from gaugewise.operators.upscaling import lookup_table, upscale
from gaugewise.plans import canonical as c
from gaugewise.plans.queries_match import MATCHED, METRICS_SQL, SQL_PAIR, SQL_R, matched_three
from gaugewise.plans.queries_scan import POINTS, QUALITY, SENSORS
from gaugewise.plans.registry import query, r6, s6, sql_time_text, time_text

# --- spatial ----------------------------------------------------------------------------------

_DIST = """2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"""


def _nearest_sql(left, right):
    return f"""pairs AS (SELECT a.gpi AS gpi, b.gpi AS other, {_DIST} AS dist FROM {left} a, {right} b),
      hits AS (SELECT gpi, other, dist FROM (SELECT *, row_number() OVER (PARTITION BY gpi
        ORDER BY round(dist, 3), other) AS k FROM pairs) WHERE k = 1)"""


@query(
    "spatial_nearest_maxdist",
    f"""WITH {POINTS}, {SENSORS}, {_nearest_sql('points', 'sensors')}
        SELECT gpi, other AS other_gpi, round(dist / 1000, 3) + 0.0 AS distance_km FROM hits WHERE dist <= 300000""",
)
def spatial_nearest_maxdist(spark, d):
    """For every reference point the nearest sensor within 300 km."""
    hits = nearest(c.points(spark, d), c.sensors(spark, d), max_dist_m=300_000)
    return hits.select("gpi", "other_gpi", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


@query(
    "spatial_nearest",
    f"""WITH {POINTS}, {SENSORS}, {_nearest_sql('points', 'sensors')}
        SELECT gpi, other AS other_gpi, round(dist / 1000, 3) + 0.0 AS distance_km FROM hits""",
)
def spatial_nearest(spark, d):
    hits = nearest(c.points(spark, d), c.sensors(spark, d))
    return hits.select("gpi", "other_gpi", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


_LUT = f"{_nearest_sql('sensors', 'points')}, lut AS (SELECT other AS ref_gpi, gpi FROM hits)"
_SENSOR_SERIES = """sensor_series AS (SELECT l_partkey AS gpi, l_shipdate AS ts, avg(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""


@query(
    "upscale_lut",
    f"""WITH {POINTS}, {SENSORS}, {_LUT} SELECT ref_gpi, gpi, {s6('lon')}, {s6('lat')} FROM lut JOIN sensors
        USING (gpi)""",
)
def upscale_lut(spark, d):
    return lookup_table(c.points(spark, d), c.sensors(spark, d)).select("ref_gpi", "gpi", r6("lon"), r6("lat"))


@query(
    "upscale_average",
    f"""WITH {POINTS}, {SENSORS}, {_LUT}, {_SENSOR_SERIES}
        SELECT ref_gpi AS gpi, {sql_time_text('ts')}, {s6('avg(value)', 'value')}
        FROM sensor_series JOIN lut USING (gpi) GROUP BY ref_gpi, ts""",
)
def upscale_average(spark, d):
    averaged = upscale(c.sensor_series(spark, d), lookup_table(c.points(spark, d), c.sensors(spark, d)))
    return averaged.select("gpi", time_text(), r6("value"))


@query(
    "upscale_average_stable",
    f"""WITH {POINTS}, {SENSORS}, {_LUT}, {_SENSOR_SERIES},
        placed AS (SELECT ref_gpi, gpi, ts, value FROM sensor_series JOIN lut USING (gpi)),
        fit AS (SELECT ref_gpi, gpi, count(*) AS n, stddev_pop(value) AS s,
            CASE WHEN stddev_pop(m) > 0 AND stddev_pop(value) > 0
              THEN covar_pop(m, value) / (stddev_pop(m) * stddev_pop(value)) END AS r
          FROM (SELECT *, avg(value) OVER (PARTITION BY ref_gpi, ts) AS m FROM placed) GROUP BY ref_gpi, gpi),
        stable AS (SELECT ref_gpi, gpi FROM (SELECT *, count(*) OVER (PARTITION BY ref_gpi) AS stations FROM fit)
          WHERE stations <= 4
            OR (r >= 0.9 AND s * sqrt(greatest(1 - r * r, 0)) * sqrt(n / greatest(n - 2, 1)) <= 5.0))
        SELECT ref_gpi AS gpi, {sql_time_text('ts')}, {s6('avg(value)', 'value')}
        FROM placed JOIN stable USING (ref_gpi, gpi) GROUP BY ref_gpi, ts""",
)
def upscale_average_stable(spark, d):
    """Averages over the temporally stable sensors only."""
    lut = lookup_table(c.points(spark, d), c.sensors(spark, d))
    averaged = upscale(c.sensor_series(spark, d), lut, temporal_stability=True, r_min=0.9, see_max=5.0)
    return averaged.select("gpi", time_text(), r6("value"))


# --- result shaping ---------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT gpi, ts, A AS x, N AS y, 'A_and_N' AS combo FROM matched
  UNION ALL SELECT gpi, ts, A, R, 'A_and_R' FROM matched)"""
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT gpi, combo, '{m}' AS metric, "
    + (SQL_PAIR[m] if m == "n_obs" else f"CASE WHEN count(*) >= 10 THEN {SQL_PAIR[m]} END")
    + " AS value FROM pairs GROUP BY gpi, combo"
    for m in ("n_obs", "R", "BIAS", "urmsd")
) + ")"
_METRICS = ("n_obs", "R", "BIAS", "urmsd")


def run_metrics(spark, d, matched=None):
    return metrics_long(
        matched_three(spark, d) if matched is None else matched, "A", ["N", "R"], pair_metrics=_METRICS
    )


@query(
    "metric_pivot_names",
    f"""WITH {MATCHED}, {_PAIRS}, {_LONG} SELECT gpi, """
    + ", ".join(
        s6(f"max(value) FILTER (WHERE combo = '{combo}' AND metric = '{m}')", f'"{m}_between_{named}"')
        for combo, named in (("A_and_N", "0-A_and_1-N"), ("A_and_R", "0-A_and_2-R"))
        for m in _METRICS
    )
    + " FROM long GROUP BY gpi",
)
def metric_pivot_names(spark, d):
    """One row per location; datasets carry their number, the reference being 0."""
    matched = matched_three(spark, d).withColumnsRenamed({"A": "0-A", "N": "1-N", "R": "2-R"})
    metrics = metrics_long(matched, "0-A", ["1-N", "2-R"], pair_metrics=_METRICS)
    keys = [f"{m}_between_{combo}" for combo in ("0-A_and_1-N", "0-A_and_2-R") for m in _METRICS]
    wide = results.pivot_results(metrics, keys)
    return wide.select("gpi", *[r6(f"`{k}`", k) for k in keys])


@query(
    "status_counts",
    f"""WITH {POINTS}, {MATCHED}, per AS (SELECT gpi, count(*) >= 40 AS ok FROM matched GROUP BY gpi)
        SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(ok, false)) AS ok,
          count(*) FILTER (WHERE NOT coalesce(ok, false)) AS error FROM points LEFT JOIN per USING (gpi)""",
)
def status_counts(spark, d):
    """Locations with at least 40 matches are OK."""
    metrics = metrics_long(matched_three(spark, d), "A", ["N", "R"], min_obs=40, pair_metrics=("n_obs",))
    return results.count_status(metrics, "A_and_N", c.points(spark, d))


@query(
    "progress_pct",
    f"""WITH {POINTS}, {MATCHED}, per AS (SELECT gpi, count(*) >= 40 AS ok FROM matched GROUP BY gpi),
        counts AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok,
          count(*) FILTER (WHERE NOT ok) AS error FROM points LEFT JOIN per USING (gpi))
        SELECT total, ok, error, CAST(round_even(100.0 * (ok + error) / total, 0) AS INTEGER) AS progress FROM counts""",
)
def progress_pct(spark, d):
    """Share of the points that have a result so far."""
    metrics = metrics_long(matched_three(spark, d), "A", ["N", "R"], min_obs=40, pair_metrics=("n_obs",))
    done = results.point_status(metrics, "A_and_N")
    counts = (
        c.points(spark, d)
        .join(done, "gpi", "left")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.expr("count_if(ok)").alias("ok"),
            F.expr("count_if(NOT ok)").alias("error"),
        )
    )
    return results.progress(counts)


@query(
    "status_codes",
    f"""WITH {POINTS}, {QUALITY}, refs AS (SELECT gpi, ts, soil_moisture AS value FROM q WHERE flag = 0),
        others AS (SELECT gpi, ts FROM q WHERE flag = 1 AND mode = 2 AND soil_moisture > 48.5),
        hit AS (SELECT r.gpi, count(*) AS n FROM (SELECT DISTINCT orderkey, linenumber, gpi, ts FROM q WHERE flag = 0) r
          WHERE EXISTS (SELECT 1 FROM others o WHERE o.gpi = r.gpi
            AND abs(epoch_us(o.ts) - epoch_us(r.ts)) <= 1800000000) GROUP BY r.gpi),
        in_box AS (SELECT DISTINCT gpi FROM refs)
        SELECT p.gpi, CASE WHEN h.n >= 2 THEN 0::DOUBLE WHEN h.n IS NOT NULL THEN 1 WHEN b.gpi IS NOT NULL THEN 4
          ELSE 7 END AS status FROM points p LEFT JOIN hit h USING (gpi) LEFT JOIN in_box b USING (gpi)""",
)
def status_codes(spark, d):
    """Per location: 0 matched, 1 too few matches, 4 data but no match, 7 no data."""
    rows = c.quality_rows(spark, d)
    refs = rows.where("flag = 0").selectExpr("'ref' AS dataset", "gpi", "ts", "soil_moisture AS value")
    others = rows.where("flag = 1 AND mode = 2 AND soil_moisture > 48.5").selectExpr(
        "'other' AS dataset", "gpi", "ts", "soil_moisture AS value"
    )
    matched = match_datasets(refs.unionByName(others), "ref", ["other"], 1_800_000_000)
    metrics = metrics_long(matched, "ref", ["other"], min_obs=2, pair_metrics=())
    complete = results.with_missing_points(metrics, c.points(spark, d), refs, "ref_and_other")
    return complete.where("metric = 'status'").selectExpr("gpi", "value AS status")


@query(
    "summary_stats",
    f"""WITH {MATCHED}, {_PAIRS}, {_LONG} SELECT combo, metric, count(value) AS n, {s6('avg(value)', 'mean')},
        {s6('quantile_cont(value, 0.25)', 'p25')}, {s6('median(value)', 'median')},
        {s6('quantile_cont(value, 0.75)', 'p75')} FROM long WHERE value IS NOT NULL GROUP BY combo, metric""",
)
def summary_stats(spark, d):
    table = results.summary(run_metrics(spark, d).where("metric <> 'status'"))
    return table.select("combo", "metric", "n", r6("mean"), r6("p25"), r6("median"), r6("p75"))


@query(
    "metric_catalog",
    f"""WITH {MATCHED}, {_PAIRS}, {_LONG} SELECT DISTINCT combo, metric, replace(combo, '_and_', ' and ') AS pretty_combo,
        'pair' AS kind FROM long UNION ALL SELECT DISTINCT combo, 'status', replace(combo, '_and_', ' and '), 'pair'
        FROM long""",
)
def metric_catalog(spark, d):
    return results.metric_catalog(run_metrics(spark, d))


@query(
    "datasets_in_results",
    f"""WITH {MATCHED}, {_PAIRS} SELECT DISTINCT unnest(string_split(combo, '_and_')) AS dataset FROM pairs""",
)
def datasets_in_results(spark, d):
    metrics = run_metrics(spark, d)
    return metrics.select("combo").distinct().select(F.explode(F.split("combo", "_and_")).alias("dataset")).distinct()


# --- comparing runs ---------------------------------------------------------------------------

_BOX_1, _BOX_2 = (-80, -180, 80, 60), (-80, -60, 80, 180)
_RUNS = f"""{POINTS}, {MATCHED}, {_PAIRS}, {_LONG},
  wide AS (SELECT gpi, max(value) FILTER (WHERE metric = 'R') AS R, max(value) FILTER (WHERE metric = 'BIAS') AS BIAS
    FROM long WHERE combo = 'A_and_N' GROUP BY gpi),
  wide_r AS (SELECT gpi, max(value) FILTER (WHERE metric = 'R') AS R, max(value) FILTER (WHERE metric = 'BIAS') AS BIAS
    FROM long WHERE combo = 'A_and_R' GROUP BY gpi),
  run1 AS (SELECT wide.* FROM wide JOIN points USING (gpi) WHERE lat BETWEEN -80 AND 80 AND lon BETWEEN -180 AND 60),
  run2 AS (SELECT wide_r.* FROM wide_r JOIN points USING (gpi) WHERE lat BETWEEN -80 AND 80 AND lon BETWEEN -60 AND 180)"""
_COMPARED = ", ".join(
    [s6(f"a.{m}", f"{m}_1") + ", " + s6(f"b.{m}", f"{m}_2") + ", " + s6(f"a.{m} - b.{m}", f"{m}_diff")
     for m in ("R", "BIAS")]
)


def _two_runs(spark, d):
    """Two result sets over overlapping areas: the first pair in the west, the second in the east."""
    metrics = run_metrics(spark, d)

    def one(combo, box):
        keys = [f"{m}_between_{combo}" for m in ("R", "BIAS")]
        wide = results.pivot_results(metrics.where(F.col("combo") == combo), keys)
        area = c.points(spark, d).where(in_bbox(*box)).select("gpi")
        return wide.join(area, "gpi", "left_semi").withColumnsRenamed(dict(zip(keys, ("R", "BIAS"))))

    return one("A_and_N", _BOX_1), one("A_and_R", _BOX_2)


def _compared(intersection):
    def run(spark, d):
        compared = results.compare_runs(*_two_runs(spark, d), ["R", "BIAS"], intersection=intersection)
        return compared.select("gpi", *[r6(f"{m}_{s}") for m in ("R", "BIAS") for s in ("1", "2", "diff")])

    return run


query("run_comparison_inner", f"WITH {_RUNS} SELECT a.gpi, {_COMPARED} FROM run1 a JOIN run2 b USING (gpi)")(
    _compared(True)
)
query(
    "run_comparison_outer",
    f"WITH {_RUNS} SELECT coalesce(a.gpi, b.gpi) AS gpi, {_COMPARED} FROM run1 a FULL JOIN run2 b ON a.gpi = b.gpi",
)(_compared(False))


@query(
    "comparison_diff_table",
    f"""WITH {_RUNS}, d AS (SELECT 'R' AS metric, a.R - b.R AS v FROM run1 a JOIN run2 b USING (gpi)
          UNION ALL SELECT 'BIAS', a.BIAS - b.BIAS FROM run1 a JOIN run2 b USING (gpi))
        SELECT metric, count(v) AS n, {s6('avg(v)', 'mean')}, {s6('quantile_cont(v, 0.25)', 'p25')},
          {s6('median(v)', 'median')}, {s6('quantile_cont(v, 0.75)', 'p75')} FROM d WHERE v IS NOT NULL GROUP BY metric""",
)
def comparison_diff_table(spark, d):
    compared = results.compare_runs(*_two_runs(spark, d), ["R", "BIAS"])
    table = results.difference_table(compared, ["R", "BIAS"])
    return table.select("metric", "n", r6("mean"), r6("p25"), r6("median"), r6("p75"))


@query(
    "resume_anti_join",
    f"""WITH {_RUNS} SELECT gpi, {s6('lon')}, {s6('lat')} FROM points WHERE gpi NOT IN (SELECT gpi FROM run1)""",
)
def resume_anti_join(spark, d):
    """Points that a resumed run still has to process, given what the first run finished."""
    from gaugewise.sinks.results import pending_points

    finished, _ = _two_runs(spark, d)
    return pending_points(c.points(spark, d), finished).select("gpi", r6("lon"), r6("lat"))


@query(
    "actual_interval",
    """SELECT l_suppkey AS gpi, strftime(greatest(min(l_shipdate), TIMESTAMP '1996-01-01'), '%Y-%m-%d') AS actual_from,
         strftime(least(max(l_shipdate), TIMESTAMP '2000-12-31'), '%Y-%m-%d') AS actual_to FROM lineitem GROUP BY 1""",
)
def actual_interval(spark, d):
    """Overlap of the requested interval with the time range each location covers."""
    return (
        c.table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("gpi"))
        .agg(F.min("l_shipdate").alias("_first"), F.max("l_shipdate").alias("_last"))
        .selectExpr(
            "gpi",
            "date_format(greatest(_first, TIMESTAMP_NTZ'1996-01-01'), 'yyyy-MM-dd') AS actual_from",
            "date_format(least(_last, TIMESTAMP_NTZ'2000-12-31'), 'yyyy-MM-dd') AS actual_to",
        )
    )


# --- names, classes, listings -----------------------------------------------------------------


@query(
    "dataset_keys_from_name",
    """SELECT gpi, unnest(string_split(name, '_with_')) AS dataset FROM (
         SELECT gpi, string_agg(dataset, '_with_' ORDER BY dataset) AS name FROM (
           SELECT DISTINCT l_suppkey AS gpi, l_returnflag AS dataset FROM lineitem) GROUP BY gpi)""",
)
def dataset_keys_from_name(spark, d):
    """Result-table names of every location, and the datasets read back from them."""
    # one array entry per dataset
    names = (
        c.observations(spark, d)
        .groupBy("gpi")
        .agg(F.concat_ws(results.DATASET_JOINER, F.array_sort(F.collect_set("dataset"))).alias("name"))
    )
    return names.select("gpi", F.explode(results.dataset_keys(F.col("name"))).alias("dataset"))


@query(
    "datasets_not_listed",
    "SELECT DISTINCT event_type AS dataset FROM events WHERE event_type NOT IN ('click', 'error')",
)
def datasets_not_listed(spark, d):
    """Datasets in use that are missing from a list of known ones."""
    used = c.irregular(spark, d)
    return results.unlisted(used, used.where("dataset IN ('click', 'error')").select("dataset").distinct())


@query(
    "first_five_per_class",
    f"""SELECT event_type, event_id, {sql_time_text('ts')} FROM (SELECT *, row_number() OVER (
        PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5""",
)
def first_five_per_class(spark, d):
    first = results.first_per_class(c.table(spark, d, "events"), "event_type", ["ts", "event_id"])
    return first.select("event_type", "event_id", time_text())


@query(
    "plot_name_parsing",
    f"""WITH {MATCHED}, {_PAIRS}, {_LONG} SELECT DISTINCT 'overview_' || named || '_' || metric || '.png' AS file,
        'pair' AS kind, named AS combo, metric FROM (SELECT metric, CASE combo WHEN 'A_and_N' THEN '0-A_and_1-N'
        ELSE '0-A_and_2-R' END AS named FROM long UNION ALL SELECT 'status', CASE combo WHEN 'A_and_N'
        THEN '0-A_and_1-N' ELSE '0-A_and_2-R' END FROM long)""",
)
def plot_name_parsing(spark, d):
    matched = matched_three(spark, d).withColumnsRenamed({"A": "0-A", "N": "1-N", "R": "2-R"})
    catalog = metrics_long(matched, "0-A", ["1-N", "2-R"], pair_metrics=_METRICS).select("combo", "metric").distinct()
    files = catalog.select(F.concat(F.lit("overview_"), "combo", F.lit("_"), "metric", F.lit(".png")).alias("file"))
    return results.parse_plot_names(files)


@query(
    "time_parsing",
    f"""SELECT event_id, {sql_time_text("CASE event_id % 5 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN "
        "date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) "
        "- INTERVAL 2 HOUR END", 'ts')} FROM events""",
)
def time_parsing(spark, d):
    """Times written in every known form and read back."""
    written = F.expr(
        "CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm')"
        " WHEN 2 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
        " WHEN 3 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') ELSE event_type END"
    )
    rows = c.table(spark, d, "events").select("event_id", parse_time(written).alias("ts"))
    return rows.select("event_id", time_text())


_RANK = "rank() OVER (PARTITION BY gpi ORDER BY {0}) + (count(*) OVER (PARTITION BY gpi, {0}) - 1) / 2.0"


@query(
    "pairwise_all_with_rho",
    f"""WITH {MATCHED}, ranked AS (SELECT gpi, {', '.join(f'{_RANK.format(n)} AS {n.lower()}' for n in 'ANR')} FROM matched),
        ranks AS (SELECT gpi, 'A_and_N' AS combo, a AS x, n AS y FROM ranked
          UNION ALL SELECT gpi, 'A_and_R', a, r FROM ranked)
        SELECT gpi, combo, metric, value FROM ({METRICS_SQL})
        UNION ALL SELECT gpi, combo, 'rho', {s6(f'CASE WHEN count(*) >= 10 THEN {SQL_R} END', 'value')}
        FROM ranks GROUP BY gpi, combo""",
)
def pairwise_all_with_rho(spark, d):
    """Rank correlation computed together with the other metrics of all pairs."""
    metrics = metrics_long(matched_three(spark, d), "A", ["N", "R"], rank_correlation=True)
    return metrics.select("gpi", "combo", "metric", r6("value"))


@query(
    "actual_interval_of_run",
    """WITH ranges AS (SELECT l_returnflag AS dataset, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1
          UNION ALL SELECT 'orders', min(o_orderdate), max(o_orderdate) FROM orders),
        common AS (SELECT greatest(max(first), TIMESTAMP '1996-01-01') AS a, least(min(last), TIMESTAMP '2000-12-31') AS b FROM ranges)
        SELECT strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS actual_from, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS actual_to
        FROM common WHERE a <= b UNION ALL SELECT NULL, NULL FROM common WHERE NOT a <= b""",
)
def actual_interval_of_run(spark, d):
    """The time that all datasets of a run cover, within its interval: scans of one time column each."""
    lines, orders = c.table(spark, d, "lineitem"), c.table(spark, d, "orders")
    ends = [F.min("ts").alias("first"), F.max("ts").alias("last")]
    ranges = lines.select(F.col("l_returnflag").alias("dataset"), F.col("l_shipdate").alias("ts")).groupBy("dataset").agg(*ends)
    ranges = ranges.unionByName(
        orders.select(F.lit("orders").alias("dataset"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).groupBy("dataset").agg(*ends)
    )
    found = results.common_interval(ranges, "1996-01-01", "2000-12-31")
    return found.select(time_text("actual_from", "actual_from"), time_text("actual_to", "actual_to"))


_HALF_STEP_M = 40_000


def _regridded_sql(kind):
    where = "" if kind == "FULL" else "WHERE k.gpi IS NOT NULL AND b.gpi IS NOT NULL"
    return f"""WITH {_RUNS}, moved AS (SELECT 7 * p.gpi + 3 AS gpi, least(p.lon + (p.gpi % 9) / 10.0, 180) AS lon, p.lat FROM points p),
        run3 AS (SELECT 7 * gpi + 3 AS gpi, R, BIAS FROM run2),
        own AS (SELECT p.* FROM points p JOIN run1 USING (gpi)), other AS (SELECT m.* FROM moved m JOIN run3 USING (gpi)),
        placed AS (SELECT a.gpi AS gpi_2, b.gpi AS gpi, {_DIST} AS dist FROM other a, own b),
        hits AS (SELECT gpi_2, gpi, dist FROM (SELECT *, row_number() OVER (PARTITION BY gpi_2 ORDER BY round(dist, 3), gpi) AS k
          FROM placed) WHERE k = 1 AND dist <= {_HALF_STEP_M}),
        kept AS (SELECT gpi_2, gpi FROM (SELECT *, row_number() OVER (PARTITION BY gpi ORDER BY round(dist, 3), gpi_2) AS k FROM hits)
          WHERE k = 1),
        k AS (SELECT run1.*, kept.gpi_2 FROM run1 LEFT JOIN kept USING (gpi))
        SELECT k.gpi AS gpi, b.gpi AS gpi_2, {_COMPARED.replace('a.', 'k.')} FROM k FULL JOIN run3 b ON b.gpi = k.gpi_2 {where}"""


def _regridded(intersection):
    def run(spark, d):
        first, second = _two_runs(spark, d)
        points = c.points(spark, d)
        moved = points.selectExpr("7 * gpi + 3 AS gpi", "least(lon + (gpi % 9) / 10.0D, 180D) AS lon", "lat")
        second = second.withColumn("gpi", 7 * F.col("gpi") + 3)
        compared = results.compare_regridded(first, second, points, moved, ["R", "BIAS"], _HALF_STEP_M, intersection)
        return compared.select("gpi", "gpi_2", *[r6(f"{m}_{s}") for m in ("R", "BIAS") for s in ("1", "2", "diff")])

    return run


query("run_comparison_regridded", _regridded_sql("INNER"))(_regridded(True))
query("run_comparison_regridded_outer", _regridded_sql("FULL"))(_regridded(False))
