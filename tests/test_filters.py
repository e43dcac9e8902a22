import pytest
from pyspark.sql import functions as F

from gaugewise.functions.flags import excludes_bitmask, has_no_bit_group
from gaugewise.operators import filters as flt


def keeps(spark, words, condition):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w bigint")
    return [r.k for r in rows.select("i", condition(F.col("w")).alias("k")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "words, mask, expected",
    [([1, 2, 3, 4], 1, [False, True, False, True]), ([2, 4, 8], 1, [True, True, True]), ([5, 7, 1], 5, [False, False, True])],
)
def test_bitmask(spark, words, mask, expected):
    assert keeps(spark, words, lambda w: excludes_bitmask(w, mask)) == expected


@pytest.mark.parametrize(
    "words, groups, expected",
    [
        ([1, 2, 4, 3], [[0]], [False, True, True, False]),
        ([1, 2, 4], [[0], [1]], [False, False, True]),
        ([1, 3, 6], [[0, 1]], [True, False, True]),
        ([4, 11, 3, 8], [[2], [0, 1]], [False, False, False, True]),
        ([None, 1], [[0]], [True, False]),
    ],
)
def test_bit_groups(spark, words, groups, expected):
    assert keeps(spark, words, lambda w: has_no_bit_group(w, groups)) == expected


def test_fractional_words_are_truncated(spark):
    rows = spark.createDataFrame([(2.9,), (3.0,), (float("nan"),)], "w double")
    assert [r.k for r in rows.select(has_no_bit_group(F.col("w"), [[0]]).alias("k")).collect()] == [True, False, True]


@pytest.mark.parametrize(
    "name, columns",
    [
        ("FIL_ISMN_GOOD", {"soil_moisture_flag"}),
        ("FIL_SMOS_QUAL_RECOMMENDED", {"Quality_Flag"}),
        ("FIL_NONEXISTENT", set()),
        ("FIL_SMOS_UNFROZEN", {"Scene_Flags"}),
        ("FIL_ASCAT_METOP_A", {"sat_id"}),
        ("FIL_CCIGF_GAPMASK", {"gapmask"}),
        ("FIL_SMAP_L3_V9_ORBIT_ASC", {"Overpass"}),
        ("FIL_SMOSL2_RFI_good_confidence", {"RFI_Prob", "N_RFI_X", "N_RFI_Y", "M_AVA0"}),
    ],
)
def test_required_columns(name, columns):
    found = flt.required_columns("soil_moisture", [name])
    assert found[0] == "soil_moisture" and set(found[1:]) == columns


def test_companion_columns():
    assert flt.required_columns("SoilMoi0_10cm_inst", ["FIL_GLDAS_UNFROZEN"]) == [
        "SoilMoi0_10cm_inst",
        "SWE_inst",
        "SoilTMP0_10cm_inst",
    ]
    assert flt.required_columns("swvl1", ["FIL_ERA5_TEMP_UNFROZEN"]) == ["swvl1", "stl1"]
    assert flt.required_columns("sm", [], ["FIL_SMOSL3_RFI"]) == ["sm", "Ratio_RFI"]


def test_every_named_filter_has_a_rule():
    assert len(flt.COMPARISON_FILTERS) + len(flt.BIT_FILTERS) + 1 == 46
    assert len(flt.THRESHOLD_FILTERS) + len({flt.NETWORKS, flt.DEPTH}) == 8


def test_missing_values(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "i int, flag int")
    variable = flt.Variable("i")

    def kept(name):
        return {r.i for r in rows.where(flt.keep(variable, [name])).collect()}

    assert kept("FIL_C3S_FLAG_0") == {2}
    assert kept("FIL_C3S_NO_FLAG_1") == {1, 2}


@pytest.mark.parametrize("parameter, expected", [(None, (0.0, 2.0)), ("0.1,0.3", (0.1, 0.3)), (" 0 , 1 ", (0.0, 1.0))])
def test_depth_range(parameter, expected):
    assert flt.depth_range([(flt.DEPTH, parameter)] if parameter else []) == expected


@pytest.mark.parametrize("parameter", ["-0.1,0.3", "0.1,-1", "0.5,0.2"])
def test_bad_depth_range(parameter):
    with pytest.raises(ValueError):
        flt.depth_range([(flt.DEPTH, parameter)])


def test_network_names_are_trimmed():
    assert flt.split_names(" A, B ,C") == ["A", "B", "C"]


def test_sensors_without_class(spark):
    sensors = spark.createDataFrame([(1, "X", 0.0, 0.1), (2, "Y", 0.0, 3.0)], "gpi int, network string, depth_from double, depth_to double")
    assert [r.gpi for r in flt.select_sensors(sensors, [flt.FRM], [(flt.NETWORKS, "ALL")]).collect()] == [1]


def test_comparisons_reach_the_scan(spark, sf_dir):
    variable = flt.Variable("l_quantity", 5.0, 45.0)
    plan = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .where(flt.keep(variable, ["FIL_ALL_VALID_RANGE"]))
        .select("l_orderkey")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "GreaterThanOrEqual(l_quantity,5.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
