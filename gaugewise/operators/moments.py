"""Mergeable moments: counts, means and centred co-moments that add up without the rows.

Rows are aggregated once, to cells: sets of days that belong to the same windows. A window's moments
are then merged from those of its cells, of which a location has a few dozen at most, so no row is
copied for the windows it falls into. The same merge adds a later batch of rows to earlier ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.subwindows import BULK, OVERLAP_MAX, OVERLAP_MIN, YearlyWindow

#: Name of a group of series (a pair or triple) -> its columns; in formulas they are x, y, z in turn.
Groups = Mapping[str, Sequence[str]]
SIDES = "xyz"


def _pairs(n: int) -> list[str]:
    return [SIDES[a] + SIDES[b] for a in range(n) for b in range(a, n)]


def fields(groups: Groups) -> list[str]:
    """Columns of the moments: ``<group>n``, ``<group>m<side>`` and ``<group>c<side><side>``."""
    out = []
    for prefix, names in groups.items():
        out += [f"{prefix}n", *(f"{prefix}m{s}" for s in SIDES[: len(names)]), *(f"{prefix}c{p}" for p in _pairs(len(names)))]
    return out


def row_moments(groups: Groups) -> list[str]:
    """Aggregates (SQL text) over rows; a row counts for a group where all its series have a value."""
    out = []
    for prefix, names in groups.items():
        quoted = [f"`{n}`" for n in names]
        present = " AND ".join(f"{q} IS NOT NULL" for q in quoted)
        value = dict(zip(SIDES, (f"CASE WHEN {present} THEN {q} END" for q in quoted)))
        n = f"count(CASE WHEN {present} THEN 1 END)"
        out.append(f"{n} AS {prefix}n")
        out += [f"coalesce(avg({value[s]}), 0D) AS {prefix}m{s}" for s in SIDES[: len(names)]]
        for a, b in _pairs(len(names)):
            spread = f"var_pop({value[a]})" if a == b else f"covar_pop({value[a]}, {value[b]})"
            out.append(f"coalesce({spread} * {n}, 0D) AS {prefix}c{a}{b}")
    return out


def _merge_of(groups: Groups, a: str, b: str) -> str:
    """Struct (SQL text) of the moments of two disjoint sets of rows."""
    parts = []
    for prefix, names in groups.items():
        na, nb = f"{a}.{prefix}n", f"{b}.{prefix}n"
        n = f"greatest({na} + {nb}, 1)"
        apart = {s: f"({b}.{prefix}m{s} - {a}.{prefix}m{s})" for s in SIDES[: len(names)]}
        parts.append(f"{na} + {nb} AS {prefix}n")
        parts += [f"{a}.{prefix}m{s} + {apart[s]} * {nb} / {n} AS {prefix}m{s}" for s in apart]
        for p in _pairs(len(names)):
            between = f"{apart[p[0]]} * {apart[p[1]]} * {na} / {n} * {nb}"
            parts.append(f"{a}.{prefix}c{p} + {b}.{prefix}c{p} + {between} AS {prefix}c{p}")
    return f"struct({', '.join(parts)})"


def merge_moments(
    cells: DataFrame, groups: Groups, by: Sequence[str], order: Sequence[str] = (), more: Sequence[str] = ()
) -> DataFrame:
    """One row of moments for each ``by``, merged from the rows of ``cells``; ``more`` adds aggregates (SQL text).

    ``order`` names columns by which a group's rows are merged in turn, so that reruns agree to the last
    digit. A group's rows are gathered in one array: they have to be few, as cells or batches are.
    """
    names = fields(groups)
    zero = ", ".join(f"{'0L' if n.endswith('n') else '0D'} AS {n}" for n in names)
    states = ", ".join([*(f"`{c}`" for c in order), *names])
    gathered = F.expr(f"array_sort(collect_list(struct({states})))").alias("_states")
    merged = cells.groupBy(*by).agg(gathered, *map(F.expr, more))
    folded = f"aggregate(_states, struct({zero}), (a, b) -> {_merge_of(groups, 'a', 'b')})"
    return merged.withColumn("_m", F.expr(folded)).select("*", "_m.*").drop("_m", "_states")


def pair_columns(prefix: str) -> list[str]:
    """The columns that ``stats.pair_metric`` reads, from merged moments."""
    n = f"nullif({prefix}n, 0)"
    x, y = f"{prefix}mx", f"{prefix}my"
    return [
        f"{prefix}n",
        f"CASE WHEN {prefix}n > 0 THEN {x} END AS {x}",
        f"CASE WHEN {prefix}n > 0 THEN {y} END AS {y}",
        f"sqrt({prefix}cxx / {n}) AS {prefix}sx",
        f"sqrt({prefix}cyy / {n}) AS {prefix}sy",
        f"{prefix}cxy / {n} AS {prefix}cxy",
        f"greatest({prefix}cxx + {prefix}cyy - 2 * {prefix}cxy, 0D) / {n} + ({x} - {y}) * ({x} - {y}) AS {prefix}msd",
    ]


def triple_columns(prefix: str) -> list[str]:
    """The columns that ``stats.triple_metric`` reads, from merged moments."""
    return [f"{prefix}n", *(f"{prefix}c{p} / nullif({prefix}n - 1, 0) AS {prefix}q{p}" for p in _pairs(3))]


# --- windows ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Days of one number ``cell`` (SQL text over ``ts``) lie in the same ``windows`` (array text over ``_cell``)."""

    cell: str
    windows: str
    #: Names of the windows of the bits of ``_cell``; None where the cell's own number is the name.
    bits: tuple[str, ...] | None = None
    bulk: bool = True

    def names(self, cell: int | None) -> list[str | None]:
        """What ``windows`` gives for a cell."""
        if self.bits is not None:
            named = [name for i, name in enumerate(self.bits) if (cell or 0) >> i & 1]
        else:
            named = [None if cell is None else str(cell)]
        return [*named, *[BULK] * self.bulk]


#: A year without leap years beside it, one after a leap year, a leap year, and one before: the windows of a day
#: follow from this and its number in the year.
_KINDS = (2002, 2001, 2004, 2003)


def _leap(year: str) -> str:
    return f"({year} % 4 = 0 AND ({year} % 100 <> 0 OR {year} % 400 = 0))"


def recurring_cells(windows: Sequence[YearlyWindow], overlap: int = 0, bulk: bool = True) -> Cells:
    """Cells of windows that recur every year: one bit a window."""
    if not OVERLAP_MIN <= overlap <= OVERLAP_MAX:
        raise ValueError(f"overlap must lie in {OVERLAP_MIN}..{OVERLAP_MAX} days")
    # written out for every day: the windows' own predicates are dozens of date calls a row
    days = [date(year, 1, 1) + timedelta(days=k) for year in _KINDS for k in range(366)]
    listed = ", ".join(f"{sum(w.covers(day, overlap) << i for i, w in enumerate(windows))}L" for day in days)
    kind = f"CASE WHEN {_leap('year(ts)')} THEN 2 WHEN {_leap('(year(ts) - 1)')} THEN 1 WHEN {_leap('(year(ts) + 1)')} THEN 3 ELSE 0 END"
    cell = f"coalesce(get(array({listed}), 366 * {kind} + dayofyear(ts) - 1), 0L)"
    names = [f"CASE WHEN _cell & {1 << i}L <> 0 THEN '{w.name}' END" for i, w in enumerate(windows)]
    names += [f"'{BULK}'"] * bulk
    return Cells(cell, f"array_compact(array({', '.join(names)}))", tuple(w.name for w in windows), bulk)


def yearly_cells(bulk: bool = True) -> Cells:
    """Calendar years (window = the year)."""
    names = ["CAST(_cell AS STRING)", *[f"'{BULK}'"] * bulk]
    return Cells("CAST(year(ts) AS BIGINT)", f"array({', '.join(names)})", bulk=bulk)


def cell_moments(
    rows: DataFrame, groups: Groups, cells: Cells, by: Sequence[str] = ("gpi",), more: Sequence[str] = ()
) -> DataFrame:
    """Moments of every location and cell (``_cell``): one aggregation with map-side combine."""
    placed = rows.withColumn("_cell", F.expr(cells.cell))
    return placed.groupBy(*by, "_cell").agg(*map(F.expr, [*row_moments(groups), *more]))


def window_moments(
    moments: DataFrame, groups: Groups, cells: Cells, by: Sequence[str] = ("gpi",), more: Sequence[str] = ()
) -> DataFrame:
    """Moments of every location and window (``tsw``), merged from ``cell_moments``."""
    spread = moments.withColumn("tsw", F.explode(F.expr(cells.windows)))
    return merge_moments(spread, groups, [*by, "tsw"], ["_cell"], more)
