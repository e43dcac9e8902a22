"""Queries over sources, filters, timestamps and reader cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugewise.functions.flags import excludes_bitmask, has_no_bit_group
from gaugewise.functions.geo import in_bbox
from gaugewise.functions.scalar import format_duration_col, resolution_in_m_col, run_status
from gaugewise.functions.timing import within_period
from gaugewise.operators import filters as flt
from gaugewise.operators.series import clean, extend
from gaugewise.plans import canonical as c
from gaugewise.plans.registry import query, r6, s6, sql_time_text, time_text
from gaugewise.session import checkpoint_dir
from gaugewise.sources import ragged
from gaugewise.sources.bucketed import extend_bucketed, write_bucketed
from gaugewise.sources.stations import attach_frm_classes, networks_with_sensors, parse_sensor_metadata
from gaugewise.sources.timestamps import TIME_RULES, exact_time

OBS = """obs AS (SELECT l_returnflag AS dataset, l_suppkey AS gpi, l_shipdate AS ts, avg(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""
QUALITY = (
    "q AS (SELECT l_suppkey AS gpi, l_shipdate AS ts, l_orderkey AS orderkey, l_linenumber AS linenumber, "
    + ", ".join(f'{e} AS "{n}"' for n, e in c.QUALITY_EXPRESSIONS.items())
    + " FROM lineitem)"
)
POINTS = """points AS (SELECT s_suppkey AS gpi, (s_suppkey * 1237 % 3600) / 10.0 - 180 AS lon,
  (s_suppkey * 617 % 1700) / 10.0 - 85 AS lat, n_name AS network
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SENSORS = """sensors AS (SELECT p_partkey AS gpi, (p_partkey * 1453 % 3600) / 10.0 - 180 AS lon,
  (p_partkey * 733 % 1700) / 10.0 - 85 AS lat, p_brand AS network,
  (p_size - 1) / 20.0 AS depth_from, p_size / 20.0 AS depth_to FROM part)"""
FRM = """frm AS (SELECT p_partkey AS gpi, CASE p_size % 3 WHEN 0 THEN 'very representative'
  WHEN 1 THEN 'representative' ELSE 'not representative' END AS frm_class FROM part
  WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO'))"""


@query(
    "scan_obs",
    f"WITH {OBS} SELECT dataset, gpi, {sql_time_text('ts')}, {s6('value')} FROM obs",
)
def scan_obs(spark, d):
    return c.observations(spark, d).select("dataset", "gpi", time_text(), r6("value"))


@query(
    "period_filter",
    f"""SELECT l_orderkey, l_linenumber, {sql_time_text('l_shipdate', 'ts')} FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1998-12-31'""",
)
def period_filter(spark, d):
    return (
        c.table(spark, d, "lineitem")
        .where(within_period(F.col("l_shipdate"), "1997-01-01", "1998-12-31"))
        .select("l_orderkey", "l_linenumber", time_text("l_shipdate", "ts"))
    )


def _kept(name, condition, parametrised=()):
    """Registers: rows (order key, line number) that pass one named filter."""
    filters = () if parametrised else (name,)
    variable = flt.Variable("soil_moisture", 5.0, 45.0)

    def run(spark, d):
        rows = c.quality_rows(spark, d)
        return rows.where(flt.keep(variable, filters, parametrised)).select("orderkey", "linenumber")

    return run, f"WITH {QUALITY} SELECT orderkey, linenumber FROM q WHERE {condition}"


for _query, _filter, _condition, _parameter in [
    ("valid_range", "FIL_ALL_VALID_RANGE", "soil_moisture BETWEEN 5 AND 45", None),
    ("flag_equals", "FIL_ISMN_GOOD", "soil_moisture_flag = 'G'", None),
    ("flag_not_equals", "FIL_C3S_NO_FLAG_1", "flag <> 1", None),
    ("orbit_asc", "FIL_SMOSL2_ORBIT_ASC", "Overpass = 1", None),
    ("orbit_desc", "FIL_SMOSL2_ORBIT_DES", "Overpass = 2", None),
    ("orbit_asc_swapped", "FIL_SMAP_L3_V9_ORBIT_ASC", "Overpass = 2", None),
    (
        "rfi_combined_ratio",
        "FIL_SMOSL2_RFI_good_confidence",
        "(N_RFI_X + N_RFI_Y) / nullif(M_AVA0, 0) <= 0.2 AND RFI_Prob <= 0.2",
        None,
    ),
    ("param_threshold_le", "FIL_SMOSL3_RFI", "Ratio_RFI <= 0.05", "0.05"),
    ("param_threshold_ge", "FIL_SMOSL2_CHI2P", "Chi_2_P >= 0.04", "0.04"),
    ("param_threshold_lt", "FIL_ASCAT_SUBSURFACE_SCAT_PROB", "subsurface_scattering_probability < 0.05", " 0.05 "),
    ("param_threshold_gt", "FIL_ASCAT_SSM_SENSITIVITY", "surface_soil_moisture_sensitivity > 1", "1"),
    (
        "bits_any_groups",
        "FIL_SMOSL3_WATER",
        'NOT ((Science_Flags >> 5) & 1 = 1 OR (Science_Flags >> 13) & 1 = 1 OR (Science_Flags >> 14) & 1 = 1)',
        None,
    ),
]:
    _run, _sql = _kept(_filter, _condition, ((_filter, _parameter),) if _parameter else ())
    query(_query, _sql)(_run)


@query(
    "unfrozen_conjunction",
    f"WITH {QUALITY} SELECT orderkey, linenumber FROM q WHERE SWE_inst < 0.001 AND SoilMoi > 0 AND SoilTMP > 1",
)
def unfrozen_conjunction(spark, d):
    condition = flt.keep(flt.Variable("SoilMoi"), ["FIL_GLDAS_UNFROZEN"])
    return c.quality_rows(spark, d).where(condition).select("orderkey", "linenumber")


@query(
    "bitmask_exclude",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CAST(l_quantity AS BIGINT) & 5) <> 5",
)
def bitmask_exclude(spark, d):
    word = F.col("l_quantity").cast("bigint")
    return c.table(spark, d, "lineitem").where(excludes_bitmask(word, 5)).select("l_orderkey", "l_linenumber")


@query(
    "bits_all_group",
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE NOT ((CAST(l_quantity AS BIGINT) & 3) = 3 OR (CAST(l_quantity AS BIGINT) & 16) = 16)",
)
def bits_all_group(spark, d):
    return (
        c.table(spark, d, "lineitem")
        .where(has_no_bit_group(F.col("l_quantity"), [[0, 1], [4]]))
        .select("l_orderkey", "l_linenumber")
    )


# --- the whole filter catalogue in one pass ---------------------------------------------------

_CATALOG_VARIABLE = flt.Variable("soil_moisture", 5.0, 45.0)
_CATALOG_PARAMETERS = {
    "FIL_SMOSL3_RFI": "0.05",
    "FIL_SMOSL2_CHI2P": "0.04",
    "FIL_SMAP_L3_V9_VWC": "3",
    "FIL_SMAP_L3_V9_static_water_body": "0.06",
    "FIL_ASCAT_SUBSURFACE_SCAT_PROB": "0.05",
    "FIL_ASCAT_SSM_SENSITIVITY": "1",
}
_CATALOG_SQL = {
    "FIL_ALL_VALID_RANGE": "soil_moisture >= 5 AND soil_moisture <= 45",
    "FIL_ISMN_GOOD": "soil_moisture_flag = 'G'",
    "FIL_C3S_FLAG_0": "flag = 0",
    "FIL_C3S_NO_FLAG_1": "flag <> 1",
    "FIL_C3S_NO_FLAG_2": "flag <> 2",
    "FIL_C3S_MODE_ASC": "mode = 1",
    "FIL_C3S_MODE_DESC": "mode = 2",
    "FIL_GLDAS_UNFROZEN": "SWE_inst < 0.001 AND SoilMoi > 0 AND SoilTMP > 1",
    "FIL_ASCAT_METOP_A": "sat_id = 3",
    "FIL_ASCAT_METOP_B": "sat_id = 4",
    "FIL_ASCAT_METOP_C": "sat_id = 5",
    "FIL_ASCAT_UNFROZEN_UNKNOWN": "ssf <= 1",
    "FIL_ASCAT_UNFROZEN_UNKNOWN_new": "surface_flag <= 1",
    "FIL_ASCAT_NO_CONF_FLAGS": "conf_flag = 0",
    "FIL_ASCAT_NO_PROC_FLAGS": "proc_flag = 0",
    "FIL_ASCAT_NO_PROC_FLAGS_new": "processing_flag = 0",
    "FIL_SMOS_QUAL_RECOMMENDED": "Quality_Flag = 0",
    "FIL_SMOSL2_RFI_good_confidence": "(N_RFI_X + N_RFI_Y) / nullif(M_AVA0, 0) <= 0.2 AND RFI_Prob <= 0.2",
    "FIL_SMOSL2_RFI_high_confidence": "(N_RFI_X + N_RFI_Y) / nullif(M_AVA0, 0) <= 0.1 AND RFI_Prob <= 0.1",
    "FIL_SMOS_TOPO_NO_MODERATE": "Processing_Flags & 1 = 0",
    "FIL_SMOS_TOPO_NO_STRONG": "Processing_Flags & 2 = 0",
    "FIL_SMOS_UNPOLLUTED": "Scene_Flags & 4 = 0",
    "FIL_SMOS_UNFROZEN": "Scene_Flags & 8 = 0",
    "FIL_SMOS_BRIGHTNESS": "Processing_Flags & 1 = 0",
    "FIL_SMOSL3_STRONG_TOPO_MANDATORY": "(Science_Flags >> 3) & 1 = 0",
    "FIL_SMOSL3_MODERATE_TOPO": "(Science_Flags >> 4) & 1 = 0",
    "FIL_SMOSL3_ICE_MANDATORY": "(Science_Flags >> 12) & 1 = 0",
    "FIL_SMOSL3_FROZEN": "(Science_Flags >> 6) & 1 = 0 AND (Science_Flags >> 7) & 1 = 0 "
    "AND (Science_Flags >> 8) & 1 = 0 AND (Science_Flags >> 11) & 1 = 0",
    "FIL_SMOSL3_URBAN_LOW": "(Science_Flags >> 15) & 1 = 0",
    "FIL_SMOSL3_URBAN_HIGH": "(Science_Flags >> 16) & 1 = 0",
    "FIL_SMOSL3_WATER": "(Science_Flags >> 5) & 1 = 0 AND (Science_Flags >> 13) & 1 = 0 "
    "AND (Science_Flags >> 14) & 1 = 0",
    "FIL_SMOSL3_EXTERNAL": "(Science_Flags >> 24) & 1 = 0 AND (Science_Flags >> 25) & 1 = 0",
    "FIL_SMOSL3_TAU_FO": "(Science_Flags >> 27) & 1 = 0",
    "FIL_SMOSL2_OW": "(Science_Flags >> 5) & 1 = 0",
    "FIL_SMOSL2_SNOW": "(Science_Flags >> 6) & 1 = 0 AND (Science_Flags >> 7) & 1 = 0 "
    "AND (Science_Flags >> 8) & 1 = 0",
    "FIL_SMOSL2_ICE": "(Science_Flags >> 12) & 1 = 0",
    "FIL_SMOSL2_FROST": "(Science_Flags >> 11) & 1 = 0",
    "FIL_SMOSL2_TOPO_S": "(Science_Flags >> 3) & 1 = 0",
    "FIL_SMOSL2_ORBIT_DES": "Overpass = 2",
    "FIL_SMOSL2_ORBIT_ASC": "Overpass = 1",
    "FIL_ERA5_TEMP_UNFROZEN": "t > 274.15",
    "FIL_ERA5_LAND_TEMP_UNFROZEN": "t > 274.15",
    "FIL_SMAP_L3_V9_ORBIT_ASC": "Overpass = 2",
    "FIL_SMAP_L3_V9_ORBIT_DSC": "Overpass = 1",
    "FIL_CCIGF_GAPMASK": "gapmask = 0",
    "FIL_CCIGF_FROZENMASK": "frozenmask = 0",
    "FIL_SMOSL3_RFI": "Ratio_RFI <= 0.05",
    "FIL_SMOSL2_CHI2P": "Chi_2_P >= 0.04",
    "FIL_SMAP_L3_V9_VWC": "vegetation_water_content <= 3",
    "FIL_SMAP_L3_V9_static_water_body": "static_water_body_fraction <= 0.06",
    "FIL_ASCAT_SUBSURFACE_SCAT_PROB": "subsurface_scattering_probability < 0.05",
    "FIL_ASCAT_SSM_SENSITIVITY": "surface_soil_moisture_sensitivity > 1",
}


def _catalog_variable(name):
    if name == "FIL_GLDAS_UNFROZEN":
        return flt.Variable("SoilMoi")
    if name.startswith("FIL_ERA5"):
        return flt.Variable("wv")
    return _CATALOG_VARIABLE


@query(
    "filter_catalog_counts",
    f"WITH {QUALITY} SELECT gpi, "
    + ", ".join(f'count(*) FILTER (WHERE {condition}) AS "{name}"' for name, condition in _CATALOG_SQL.items())
    + " FROM q GROUP BY gpi",
)
def filter_catalog_counts(spark, d):
    """Rows each named filter keeps, per location, for the whole catalogue in one scan."""
    counts = []
    for name in _CATALOG_SQL:
        if name in _CATALOG_PARAMETERS:
            condition = flt.threshold_condition(name, _CATALOG_PARAMETERS[name])
        else:
            condition = flt.filter_condition(name, _catalog_variable(name))
        counts.append(F.count_if(condition).alias(name))
    return c.quality_rows(spark, d).groupBy("gpi").agg(*counts)


# --- stations and points ----------------------------------------------------------------------


@query(
    "network_filter",
    f"WITH {SENSORS} SELECT gpi, network FROM sensors WHERE network IN ('Brand#1', 'Brand#12')"
    " AND depth_from >= 0 AND depth_to <= 2",
)
def network_filter(spark, d):
    chosen = flt.select_sensors(c.sensors(spark, d), (), [("FIL_ISMN_NETWORKS", "Brand#1 , Brand#12, NotThere")])
    return chosen.select("gpi", "network")


@query(
    "depth_filter",
    f"WITH {SENSORS} SELECT gpi, {s6('depth_from')}, {s6('depth_to')} FROM sensors"
    " WHERE depth_from >= 0.5 AND depth_to <= 1.5",
)
def depth_filter(spark, d):
    chosen = flt.select_sensors(c.sensors(spark, d), (), [("FIL_ISMN_DEPTH", "0.5,1.5")])
    return chosen.select("gpi", r6("depth_from"), r6("depth_to"))


@query(
    "frm_filter_coalesce",
    f"""WITH {SENSORS}, {FRM}, s AS (SELECT sensors.*, coalesce(frm_class, 'undeducible') AS frm_class
          FROM sensors LEFT JOIN frm USING (gpi))
        SELECT gpi, frm_class FROM s WHERE frm_class IN ('very representative', 'representative')
          AND depth_from >= 0 AND depth_to <= 2""",
)
def frm_filter_coalesce(spark, d):
    stations = attach_frm_classes(c.sensors(spark, d), c.frm_classes(spark, d))
    return flt.select_sensors(stations, ["FIL_ISMN_FRM_representative"]).select("gpi", "frm_class")


@query(
    "frm_class_counts",
    f"""WITH {SENSORS}, {FRM} SELECT network, coalesce(frm_class, 'undeducible') AS frm_class, count(*) AS n
        FROM sensors LEFT JOIN frm USING (gpi) GROUP BY 1, 2""",
)
def frm_class_counts(spark, d):
    stations = attach_frm_classes(c.sensors(spark, d), c.frm_classes(spark, d))
    return stations.groupBy("network", "frm_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "network_points",
    f"""WITH {SENSORS} SELECT network, count(*) AS points, min(gpi) AS first_gpi FROM sensors
        WHERE depth_from >= 0 AND depth_to <= 1 AND lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40
        GROUP BY network""",
)
def network_points(spark, d):
    """Networks that keep at least one sensor after depth and bounding-box filters."""
    chosen = flt.select_sensors(c.sensors(spark, d), (), [("FIL_ISMN_DEPTH", "0,1")])
    return networks_with_sensors(chosen.where(in_bbox(-40, -60, 40, 60)))


@query(
    "sensor_metadata_reshape",
    f"""WITH {SENSORS} SELECT gpi, network AS meta_network, {s6('depth_from', 'instrument_depthfrom')},
        {s6('depth_to', 'instrument_depthto')} FROM sensors""",
)
def sensor_metadata_reshape(spark, d):
    raw = c.sensors(spark, d).selectExpr(
        "gpi",
        "map('network', array(struct(network AS value, depth_from AS depth_from, depth_to AS depth_to)),"
        " 'instrument', array(struct('probe' AS value, depth_from AS depth_from, depth_to AS depth_to))) AS metadata",
    )
    return parse_sensor_metadata(raw, ["network"]).select(
        "gpi", F.col("network").alias("meta_network"), r6("instrument_depthfrom"), r6("instrument_depthto")
    )


for _name, _box, _where in [
    ("bbox_normal", (-30, -90, 50, 60), "lat BETWEEN -30 AND 50 AND lon BETWEEN -90 AND 60"),
    ("bbox_antimeridian", (-60, 150, 60, 200), "lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -160)"),
    ("bbox_shifted", (-60, 190, 60, 230), "lat BETWEEN -60 AND 60 AND lon BETWEEN -170 AND -130"),
    ("bbox_full_circle", (-20, -200, 20, 200), "lat BETWEEN -20 AND 20"),
]:

    def _bbox(spark, d, box=_box):
        return c.points(spark, d).where(in_bbox(*box)).select("gpi", r6("lon"), r6("lat"))

    query(_name, f"WITH {POINTS} SELECT gpi, {s6('lon')}, {s6('lat')} FROM points WHERE {_where}")(_bbox)


# --- cleaning, extension, timestamps ----------------------------------------------------------

_RAW_SQL = """raw AS (SELECT l_orderkey AS orderkey, l_linenumber AS linenumber,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_shipdate END AS ts,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS Soil_Moisture,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 1000 END AS acquisition_time,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS Chi_2_P,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS Science_Flags FROM lineitem)"""


@query(
    "clean_fillna_dropna",
    f"""WITH {_RAW_SQL} SELECT orderkey, linenumber, {s6('Soil_Moisture')}, {s6('coalesce(Chi_2_P, 0)', 'Chi_2_P')},
        coalesce(Science_Flags, 0) AS Science_Flags FROM raw
        WHERE ts IS NOT NULL AND Soil_Moisture IS NOT NULL AND acquisition_time IS NOT NULL""",
)
def clean_fillna_dropna(spark, d):
    raw = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS orderkey",
        "l_linenumber AS linenumber",
        "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_shipdate END AS ts",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS Soil_Moisture",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 1000 END AS acquisition_time",
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS Chi_2_P",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS Science_Flags",
    )
    return clean(raw).select("orderkey", "linenumber", r6("Soil_Moisture"), r6("Chi_2_P"), "Science_Flags")


_EXTENDED = f"""WITH {OBS}, both_sources AS (
          SELECT gpi, ts, value, 0 AS src FROM obs WHERE dataset = 'A'
          UNION ALL SELECT gpi, ts, value, 1 FROM obs WHERE dataset = 'N'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY gpi, ts ORDER BY src DESC, value DESC) AS k
          FROM both_sources)
        SELECT gpi, {sql_time_text('ts')}, {s6('value')} FROM ranked WHERE k = 1"""


@query("extension_keep_last", _EXTENDED)
def extension_keep_last(spark, d):
    series = extend(c.dataset(spark, d, "A"), c.dataset(spark, d, "N"))
    return series.select("gpi", time_text(), r6("value"))


#: Buckets of the stores below; on a cluster several times the number of cores.
BUCKETS = 16


@query("extension_bucketed", _EXTENDED)
def extension_bucketed(spark, d):
    """The same from two stores that are bucketed alike and merged without a shuffle."""
    root = f"{checkpoint_dir(spark)}/gaugewise/{uuid.uuid4().hex}"
    base, newer = (write_bucketed(c.dataset(spark, d, n), f"{root}/{n}", BUCKETS) for n in ("A", "N"))
    return extend_bucketed(base, newer).select("gpi", time_text(), r6("value"))


#: Cells that the locations are dealt to below; the series come back as they were.
CELLS = 8
_SERIES = f"WITH {OBS} SELECT gpi, {sql_time_text('ts')}, {s6('value')} FROM obs WHERE dataset = 'A'"


@query("ragged_contiguous", _SERIES)
def ragged_contiguous(spark, d):
    """Series out of a store whose observations follow each other location by location."""
    locations, rows = ragged.as_contiguous(c.dataset(spark, d, "A"), F.col("gpi") % CELLS)
    return ragged.expand(locations, rows).select("gpi", time_text(), r6("value"))


@query("ragged_indexed", _SERIES)
def ragged_indexed(spark, d):
    """Series out of a store whose observations name their location's place in the cell."""
    locations, rows = ragged.as_indexed(c.dataset(spark, d, "A"), F.col("gpi") % CELLS)
    return ragged.expand(locations, rows).select("gpi", time_text(), r6("value"))


@query(
    "timestamp_days_seconds",
    f"""SELECT l_orderkey, l_linenumber, {sql_time_text(
        "TIMESTAMP '2000-01-01' + to_days(CAST(l_partkey AS INTEGER)) + to_seconds(l_quantity * 100)", 'ts')}
        FROM lineitem""",
)
def timestamp_days_seconds(spark, d):
    rows = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey AS Mean_Acq_Time_Days",
        "l_quantity * 100 AS Mean_Acq_Time_Seconds",
    )
    return rows.withColumn("ts", exact_time(TIME_RULES["SMOS_L3"])).select("l_orderkey", "l_linenumber", time_text())


@query(
    "timestamp_seconds_base12h",
    f"""SELECT l_orderkey, l_linenumber,
        {sql_time_text("TIMESTAMP '2000-01-01 12:00:00' + to_seconds(l_orderkey * 60)", 'ts')} FROM lineitem""",
)
def timestamp_seconds_base12h(spark, d):
    rows = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey * 60 AS acquisition_time"
    )
    return rows.withColumn("ts", exact_time(TIME_RULES["SMAP_L2"])).select("l_orderkey", "l_linenumber", time_text())


@query(
    "timestamp_days_seconds_micros",
    f"""SELECT l_orderkey, l_linenumber, {sql_time_text(
        "TIMESTAMP '2000-01-01' + to_days(CAST(l_suppkey AS INTEGER)) + to_seconds(l_linenumber * 7)"
        " + to_microseconds(l_partkey)", 'ts')} FROM lineitem""",
)
def timestamp_days_seconds_micros(spark, d):
    rows = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey AS Days",
        "l_linenumber * 7 AS UTC_Seconds",
        "l_partkey AS UTC_Microseconds",
    )
    return rows.withColumn("ts", exact_time(TIME_RULES["SMOS_IC"])).select("l_orderkey", "l_linenumber", time_text())


@query(
    "timestamp_seconds_versioned",
    f"""SELECT l_orderkey, l_linenumber,
        {sql_time_text("TIMESTAMP '2000-01-01' + to_seconds(l_orderkey * 60)", 'ts')} FROM lineitem""",
)
def timestamp_seconds_versioned(spark, d):
    rows = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey * 60 AS acquisition_time"
    )
    rule = TIME_RULES["SMOS_SBPCA"]
    return rows.withColumn("ts", exact_time(rule)).select("l_orderkey", "l_linenumber", time_text())


# --- scalar rules -----------------------------------------------------------------------------


@query(
    "resolution_in_m",
    f"""SELECT p_partkey, {s6("CASE p_size % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size / 100.0 * 100000.0 "
        "ELSE 30000.0 END", 'resolution_m')} FROM part""",
)
def resolution_in_m(spark, d):
    unit = F.expr("CASE p_size % 3 WHEN 0 THEN 'km' WHEN 1 THEN 'deg' END")
    value = F.expr("CASE p_size % 3 WHEN 1 THEN p_size / 100D ELSE CAST(p_size AS DOUBLE) END")
    return c.table(spark, d, "part").select("p_partkey", resolution_in_m_col(value, unit).alias("resolution_m")).select("p_partkey", r6("resolution_m"))


@query(
    "run_status_case",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE'
         WHEN progress = 0 AND NOT ended THEN 'SCHEDULED' WHEN progress = 100 AND ended THEN 'DONE'
         WHEN progress < 0 THEN 'CANCELLED' WHEN ended AND progress < 100 THEN 'ERROR' ELSE 'RUNNING' END AS status
       FROM (SELECT o_orderkey, o_orderstatus, (o_orderkey % 103) - 1 - CASE WHEN o_orderkey % 2 = 0
         THEN o_orderkey % 103 - 1 ELSE 0 END AS progress, o_custkey % 2 = 0 AS ended FROM orders)""",
)
def run_status_case(spark, d):
    rows = c.table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "(o_orderkey % 103) - 1 - CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 103 - 1 ELSE 0 END AS progress",
        "o_custkey % 2 = 0 AS ended",
    )
    current = F.when(F.col("o_orderstatus") == "F", "DONE")
    return rows.select("o_orderkey", run_status(F.col("progress"), F.col("ended"), current).alias("status"))


@query(
    "duration_text",
    """SELECT o_orderkey, CASE WHEN h > 0 THEN printf('%dh%02dm%02ds', h, m, s)
         WHEN m > 0 THEN printf('%dm%02ds', m, s) ELSE printf('%ds', s) END AS duration
       FROM (SELECT o_orderkey, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s
         FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS t FROM orders))""",
)
def duration_text(spark, d):
    seconds = F.col("o_totalprice") / 10
    return c.table(spark, d, "orders").select("o_orderkey", format_duration_col(seconds).alias("duration"))


@query(
    "named_filters_together",
    f"""WITH {QUALITY} SELECT orderkey, linenumber, {s6('soil_moisture')} FROM q
        WHERE soil_moisture BETWEEN 5 AND 45 AND flag <> 1 AND soil_moisture_flag = 'G'
          AND Ratio_RFI <= 0.06 AND Chi_2_P >= 0.02""",
)
def named_filters_together(spark, d):
    """A dataset as configurations have it: several named filters, two of them with a parameter."""
    condition = flt.keep(
        flt.Variable("soil_moisture", 5, 45),
        [flt.VALID_RANGE, "FIL_C3S_NO_FLAG_1", "FIL_ISMN_GOOD"],
        [("FIL_SMOSL3_RFI", "0.06"), ("FIL_SMOSL2_CHI2P", "0.02")],
    )
    return c.quality_rows(spark, d).where(condition).select("orderkey", "linenumber", r6("soil_moisture"))


@query(
    "event_properties",
    "SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k"
    " FROM events) GROUP BY ALL",
)
def event_properties(spark, d):
    """Settings kept as JSON text, read with a schema."""
    parsed = c.table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return parsed.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))
