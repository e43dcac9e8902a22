"""Temporal sub-windows: rows labelled with every window they fall into, without a join."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BULK = "bulk"
SEPARATOR = "|"
OVERLAP_MIN, OVERLAP_MAX = 0, 185


@dataclass(frozen=True)
class YearlyWindow:
    """A window that recurs every year, given by first and last (month, day).

    A last day of 0 stands for the last day of the month. A window whose last month comes
    before its first month runs over the turn of the year.
    """

    name: str
    first: tuple[int, int]
    last: tuple[int, int]

    def predicate(self, ts: str = "ts", overlap: int = 0) -> str:
        wraps = 1 if self.last < self.first else 0
        cases = []
        for shift in (-1, 0, 1):
            start = f"date_sub(make_date(year({ts}) + {shift}, {self.first[0]}, {self.first[1]}), {overlap})"
            month, day = self.last
            end_year = f"year({ts}) + {shift + wraps}"
            end = (
                f"make_date({end_year}, {month}, {day})" if day else f"last_day(make_date({end_year}, {month}, 1))"
            )
            cases.append(f"(to_date({ts}) BETWEEN {start} AND date_add({end}, {overlap}))")
        return "(" + " OR ".join(cases) + ")"

    def covers(self, day: date, overlap: int = 0) -> bool:
        """What ``predicate`` says of a day."""
        wraps, margin = int(self.last < self.first), timedelta(days=overlap)
        for year in (day.year - 1, day.year, day.year + 1):
            month, last = self.last
            if last:
                end = date(year + wraps, month, last)
            else:
                end = date(year + wraps + month // 12, month % 12 + 1, 1) - timedelta(days=1)
            if date(year, *self.first) - margin <= day <= end + margin:
                return True
        return False


# The recurring windows of the intra-annual metrics.
SEASONS = (
    YearlyWindow("S1", (12, 1), (2, 0)),
    YearlyWindow("S2", (3, 1), (5, 31)),
    YearlyWindow("S3", (6, 1), (8, 31)),
    YearlyWindow("S4", (9, 1), (11, 30)),
)
MONTHS = tuple(
    YearlyWindow(name, (month, 1), (month, 0))
    for month, name in enumerate(
        ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), start=1
    )
)
INTRA_ANNUAL = {"Seasonal": SEASONS, "Monthly": MONTHS}


def label_recurring(rows: DataFrame, windows, overlap: int = 0, bulk: bool = True) -> DataFrame:
    """One copy of a row per window it belongs to (column ``tsw``), plus one for ``bulk``."""
    if not OVERLAP_MIN <= overlap <= OVERLAP_MAX:
        raise ValueError(f"overlap must lie in {OVERLAP_MIN}..{OVERLAP_MAX} days")
    names = [f"CASE WHEN {w.predicate(overlap=overlap)} THEN '{w.name}' END" for w in windows]
    if bulk:
        names.append(f"'{BULK}'")
    return rows.withColumn("tsw", F.explode(F.expr(f"array_compact(array({', '.join(names)}))")))


def label_years(rows: DataFrame, bulk: bool = True) -> DataFrame:
    """Calendar-year windows (``tsw`` = the year) and ``bulk``."""
    year: Column = F.year("ts").cast("string")
    return rows.withColumn("tsw", F.explode(F.array(year, F.lit(BULK)) if bulk else F.array(year)))
