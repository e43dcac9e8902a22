"""Time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def epoch_us(ts: str | Column = "ts") -> Column:
    """Microseconds since the epoch of a timestamp column (UTC session)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def tile_of(us: Column, width_us: int) -> Column:
    """Index of the fixed-width time tile that holds ``us``."""
    return F.floor(us / F.lit(float(width_us)))


def half_window_us(full_window_hours: float) -> int:
    """The configured matching window is the full width; half of it applies on each side."""
    return int(round(full_window_hours * HOUR_US / 2))


def within_period(ts: Column, start, end) -> Column:
    """Inclusive period predicate on the raw column, so that it reaches the Parquet scan."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (ts <= F.lit(end).cast("timestamp_ntz"))
    return keep


# Forms in which times are written.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parse_time(text: Column) -> Column:
    """Time from text in any of the known forms as TIMESTAMP_NTZ in UTC; NULL for anything else."""
    tries = [F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in TIME_FORMATS]
    return F.coalesce(*tries)
