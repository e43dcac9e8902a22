"""Exact observation times from base and offset columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.timing import DAY_US

UNIT_US = {"D": DAY_US, "s": 1_000_000, "us": 1}


@dataclass(frozen=True)
class TimeRule:
    """``base`` plus one term per (column, unit)."""

    base: str
    terms: Sequence[tuple[str, str]]

    @property
    def columns(self) -> list[str]:
        return [column for column, _ in self.terms]


# Datasets whose time is stored as offsets. The third entry is for one version only.
TIME_RULES = {
    "SMOS_L3": TimeRule("2000-01-01 00:00:00", (("Mean_Acq_Time_Days", "D"), ("Mean_Acq_Time_Seconds", "s"))),
    "SMOS_IC": TimeRule(
        "2000-01-01 00:00:00", (("Days", "D"), ("UTC_Seconds", "s"), ("UTC_Microseconds", "us"))
    ),
    "SMOS_SBPCA": TimeRule("2000-01-01 00:00:00", (("acquisition_time", "s"),)),
    "SMAP_L2": TimeRule("2000-01-01 12:00:00", (("acquisition_time", "s"),)),
}
VERSION_LIMITED = {"SMOS_SBPCA": "SMOS_SBPCA_v724"}


def time_rule(dataset: str, version: str) -> TimeRule | None:
    if VERSION_LIMITED.get(dataset, version) != version:
        return None
    return TIME_RULES.get(dataset)


def exact_time(rule: TimeRule) -> Column:
    """The time as TIMESTAMP_NTZ; NULL when any part is missing."""
    micros = F.unix_micros(F.lit(rule.base).cast("timestamp"))
    for column, unit in rule.terms:
        micros = micros + F.round(F.col(column).cast("double") * UNIT_US[unit]).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def adapt_timestamps(series: DataFrame, dataset: str, version: str) -> DataFrame:
    """``series`` with ``ts`` replaced by the exact time where the dataset has a rule."""
    rule = time_rule(dataset, version)
    return series if rule is None else series.withColumn("ts", exact_time(rule))


def raw_period(rule: TimeRule, start: datetime, end: datetime) -> Column:
    """Coarse period predicate on the stored offset, which reaches the Parquet scan.

    Of a time stored as a day and the time of day, the day is held against the period, with the day
    before it and one day of margin on both sides. The exact predicate still follows.
    """
    if len(rule.terms) > 1:
        days = next((column for column, unit in rule.terms if unit == "D"), None)
        if days is None:
            return F.lit(True)
        low, high = (math.floor((moment - datetime.fromisoformat(rule.base)).total_seconds() / 86_400) for moment in (start, end))
        # whole numbers, so that the comparison needs no cast of the column
        return (F.col(days) >= low - 2) & (F.col(days) <= high + 1)
    (column, unit), base = rule.terms[0], datetime.fromisoformat(rule.base)
    second = UNIT_US["s"] / UNIT_US[unit]
    low, high = ((moment - base).total_seconds() * second for moment in (start, end))
    return (F.col(column) >= low - second) & (F.col(column) <= high + second)
