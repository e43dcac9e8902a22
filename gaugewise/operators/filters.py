"""Named quality filters as column predicates.

A filter is data: which column, which comparison, which value. :func:`keep` turns the
active filters of a dataset into one conjunctive predicate, so comparisons reach the
Parquet scan and only the columns they need are read.

Missing values: a comparison with a missing value drops the row, except ``!=``, which keeps
it; a missing flag word counts as "no flag set".
"""

from __future__ import annotations

import logging
import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.flags import has_no_bit_group

LOG = logging.getLogger(__name__)

COMPARE = {
    "==": operator.eq,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "!=": lambda c, v: ~c.eqNullSafe(v),
}

#: Stands for the validated variable itself in a rule.
VARIABLE = "{variable}"

# Filters that compare columns, as (column, comparison, value) triples.
COMPARISON_FILTERS: dict[str, tuple[tuple[str, str, object], ...]] = {
    "FIL_ISMN_GOOD": (("soil_moisture_flag", "==", "G"),),
    "FIL_C3S_FLAG_0": (("flag", "==", 0),),
    "FIL_C3S_NO_FLAG_1": (("flag", "!=", 1),),
    "FIL_C3S_NO_FLAG_2": (("flag", "!=", 2),),
    "FIL_C3S_MODE_ASC": (("mode", "==", 1),),
    "FIL_C3S_MODE_DESC": (("mode", "==", 2),),
    "FIL_GLDAS_UNFROZEN": (("SWE_inst", "<", 0.001), (VARIABLE, ">", 0.0), ("{variable:Moi->TMP}", ">", 1.0)),
    "FIL_ASCAT_METOP_A": (("sat_id", "==", 3),),
    "FIL_ASCAT_METOP_B": (("sat_id", "==", 4),),
    "FIL_ASCAT_METOP_C": (("sat_id", "==", 5),),
    "FIL_ASCAT_UNFROZEN_UNKNOWN": (("ssf", "<=", 1),),
    "FIL_ASCAT_UNFROZEN_UNKNOWN_new": (("surface_flag", "<=", 1),),
    "FIL_ASCAT_NO_CONF_FLAGS": (("conf_flag", "==", 0),),
    "FIL_ASCAT_NO_PROC_FLAGS": (("proc_flag", "==", 0),),
    "FIL_ASCAT_NO_PROC_FLAGS_new": (("processing_flag", "==", 0),),
    "FIL_SMOS_QUAL_RECOMMENDED": (("Quality_Flag", "==", 0),),
    "FIL_SMOSL2_RFI_good_confidence": (("COMBINED_RFI", "<=", 0.2), ("RFI_Prob", "<=", 0.2)),
    "FIL_SMOSL2_RFI_high_confidence": (("COMBINED_RFI", "<=", 0.1), ("RFI_Prob", "<=", 0.1)),
    "FIL_SMOSL2_ORBIT_DES": (("Overpass", "==", 2),),
    "FIL_SMOSL2_ORBIT_ASC": (("Overpass", "==", 1),),
    "FIL_ERA5_TEMP_UNFROZEN": (("{variable:wv->t}", ">", 274.15),),
    "FIL_ERA5_LAND_TEMP_UNFROZEN": (("{variable:wv->t}", ">", 274.15),),
    "FIL_SMAP_L3_V9_ORBIT_ASC": (("Overpass", "==", 2),),
    "FIL_SMAP_L3_V9_ORBIT_DSC": (("Overpass", "==", 1),),
    "FIL_CCIGF_GAPMASK": (("gapmask", "==", 0),),
    "FIL_CCIGF_FROZENMASK": (("frozenmask", "==", 0),),
}

# Filters that drop a row when any of the bits is set (bit 0 is the lowest).
BIT_FILTERS: dict[str, tuple[str, tuple[int, ...]]] = {
    "FIL_SMOS_TOPO_NO_MODERATE": ("Processing_Flags", (0,)),
    "FIL_SMOS_TOPO_NO_STRONG": ("Processing_Flags", (1,)),
    "FIL_SMOS_UNPOLLUTED": ("Scene_Flags", (2,)),
    "FIL_SMOS_UNFROZEN": ("Scene_Flags", (3,)),
    "FIL_SMOS_BRIGHTNESS": ("Processing_Flags", (0,)),
    "FIL_SMOSL3_STRONG_TOPO_MANDATORY": ("Science_Flags", (3,)),
    "FIL_SMOSL3_MODERATE_TOPO": ("Science_Flags", (4,)),
    "FIL_SMOSL3_ICE_MANDATORY": ("Science_Flags", (12,)),
    "FIL_SMOSL3_FROZEN": ("Science_Flags", (6, 7, 8, 11)),
    "FIL_SMOSL3_URBAN_LOW": ("Science_Flags", (15,)),
    "FIL_SMOSL3_URBAN_HIGH": ("Science_Flags", (16,)),
    "FIL_SMOSL3_WATER": ("Science_Flags", (5, 13, 14)),
    "FIL_SMOSL3_EXTERNAL": ("Science_Flags", (24, 25)),
    "FIL_SMOSL3_TAU_FO": ("Science_Flags", (27,)),
    "FIL_SMOSL2_OW": ("Science_Flags", (5,)),
    "FIL_SMOSL2_SNOW": ("Science_Flags", (6, 7, 8)),
    "FIL_SMOSL2_ICE": ("Science_Flags", (12,)),
    "FIL_SMOSL2_FROST": ("Science_Flags", (11,)),
    "FIL_SMOSL2_TOPO_S": ("Science_Flags", (3,)),
}

# Filters whose threshold is a parameter.
THRESHOLD_FILTERS: dict[str, tuple[str, str]] = {
    "FIL_SMOSL3_RFI": ("Ratio_RFI", "<="),
    "FIL_SMOSL2_CHI2P": ("Chi_2_P", ">="),
    "FIL_SMAP_L3_V9_VWC": ("vegetation_water_content", "<="),
    "FIL_SMAP_L3_V9_static_water_body": ("static_water_body_fraction", "<="),
    "FIL_ASCAT_SUBSURFACE_SCAT_PROB": ("subsurface_scattering_probability", "<"),
    "FIL_ASCAT_SSM_SENSITIVITY": ("surface_soil_moisture_sensitivity", ">"),
}

VALID_RANGE = "FIL_ALL_VALID_RANGE"
NETWORKS = "FIL_ISMN_NETWORKS"
DEPTH = "FIL_ISMN_DEPTH"
FRM = "FIL_ISMN_FRM_representative"

# Classes that count as representative, and the depth range used by default.
FRM_CLASSES = ("very representative", "representative")
DEFAULT_DEPTH = (0.0, 2.0)


@dataclass(frozen=True)
class Variable:
    """The validated variable and its valid range."""

    name: str
    min_value: float | None = None
    max_value: float | None = None


def companion_column(rule: str, variable: str) -> str:
    """Column a rule refers to: itself, the variable, or a name derived from the variable."""
    if rule == VARIABLE:
        return variable
    if rule.startswith("{variable:"):
        old, new = rule[len("{variable:") : -1].split("->")
        return variable.replace(old, new)
    return rule


def combined_rfi(x: str = "N_RFI_X", y: str = "N_RFI_Y", snapshots: str = "M_AVA0") -> Column:
    """Share of snapshots with radio-frequency interference."""
    return F.try_divide(F.col(x).cast("double") + F.col(y), F.col(snapshots).cast("double"))


def _column(name: str) -> Column:
    return combined_rfi() if name == "COMBINED_RFI" else F.col(name)


def filter_condition(name: str, variable: Variable) -> Column | None:
    """Keep-predicate of a filter without parameter; None for names without a row predicate."""
    if name == VALID_RANGE:
        return reduce(
            operator.and_,
            [
                COMPARE[op](F.col(variable.name), F.lit(limit))
                for op, limit in ((">=", variable.min_value), ("<=", variable.max_value))
                if limit is not None
            ],
            F.lit(True),
        )
    if name in COMPARISON_FILTERS:
        return reduce(
            operator.and_,
            [
                COMPARE[op](_column(companion_column(column, variable.name)), F.lit(value))
                for column, op, value in COMPARISON_FILTERS[name]
            ],
        )
    if name in BIT_FILTERS:
        column, bits = BIT_FILTERS[name]
        return has_no_bit_group(F.col(column), [[bit] for bit in bits])
    return None


def threshold_condition(name: str, parameter: str | float) -> Column | None:
    if name not in THRESHOLD_FILTERS:
        return None
    column, op = THRESHOLD_FILTERS[name]
    return COMPARE[op](F.col(column), F.lit(float(parameter)))


def is_known(name: str) -> bool:
    return name in {VALID_RANGE, DEPTH, NETWORKS, FRM, *COMPARISON_FILTERS, *BIT_FILTERS, *THRESHOLD_FILTERS}


def keep(
    variable: Variable, filters: Iterable[str] = (), parametrised: Iterable[tuple[str, str]] = ()
) -> Column:
    """Conjunction of all active filters. Names that filter neither rows nor stations are logged."""
    parametrised, filters = list(parametrised), list(filters)
    for name in [*filters, *(name for name, _ in parametrised)]:
        if not is_known(name):
            LOG.warning("no filter %r; it is left out", name)
    conditions = [threshold_condition(name, parameter) for name, parameter in parametrised]
    conditions += [filter_condition(name, variable) for name in filters]
    return reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def required_columns(
    variable: str, filters: Iterable[str] = (), parametrised: Iterable[str] = ()
) -> list[str]:
    """Columns to read for a dataset: the variable first, then what its filters look at."""
    columns = [variable]
    for name in filters:
        for rule, _, _ in COMPARISON_FILTERS.get(name, ()):
            column = companion_column(rule, variable)
            columns += ["N_RFI_X", "N_RFI_Y", "M_AVA0"] if column == "COMBINED_RFI" else [column]
        if name in BIT_FILTERS:
            columns.append(BIT_FILTERS[name][0])
    columns += [THRESHOLD_FILTERS[name][0] for name in parametrised if name in THRESHOLD_FILTERS]
    return list(dict.fromkeys(columns))


# --- filters on station metadata -------------------------------------------------------------


def depth_range(parametrised: Iterable[tuple[str, str]]) -> tuple[float, float]:
    """Depth range asked for, or the default; raises on a negative or inverted range."""
    low, high = DEFAULT_DEPTH
    for name, parameter in parametrised:
        if name == DEPTH:
            low, high = (float(part) for part in parameter.split(",")[:2])
            break
    if low < 0 or high < 0:
        raise ValueError("a depth range has no negative limits")
    if high < low:
        raise ValueError("a depth range ends below its start")
    return low, high


def split_names(parameter: str) -> list[str]:
    """Items of a comma list, without surrounding blanks."""
    return [item.strip() for item in parameter.split(",") if item.strip()]


def station_condition(
    columns: Sequence[str], filters: Iterable[str] = (), parametrised: Iterable[tuple[str, str]] = ()
) -> Column:
    """Predicate on sensor metadata: depth range, networks, representativeness class.

    The class filter is left out when the metadata has no ``frm_class`` column.
    """
    parametrised = list(parametrised)
    low, high = depth_range(parametrised)
    condition = (F.col("depth_from") >= low) & (F.col("depth_to") <= high)
    for name, parameter in parametrised:
        if name == NETWORKS and parameter and parameter.strip() != "ALL":
            condition = condition & F.col("network").isin(split_names(parameter))
    if FRM in set(filters) and "frm_class" in columns:
        condition = condition & F.col("frm_class").isin(*FRM_CLASSES)
    return condition


def select_sensors(sensors: DataFrame, filters=(), parametrised=()) -> DataFrame:
    return sensors.where(station_condition(sensors.columns, filters, parametrised))
