"""Agreement metrics as native SQL expressions (every aggregate combines map-side).

Expressions are SQL text: a run asks for hundreds of them at once, and one parsed string
costs far less driver time than building the same tree call by call.

Population moments throughout the pairwise metrics, so that the three parts of the mean
squared error add up to it exactly.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: Below this number of matched observations the metrics of a location are NULL.
MIN_OBS = 10
#: Correlations below this are what rounding leaves of none: their digits depend on the order of the rows.
ROUNDING = 1e-12


@dataclass(frozen=True)
class PairMetric:
    """A metric of a run's own, computed in the same aggregation as the others.

    ``moments`` are SQL aggregates by name, over the pair's columns written as ``{x}`` (the reference)
    and ``{y}``; ``value`` is SQL over these names and the usual moments (n, mx, my, sx, sy, cxy, msd),
    each in braces. Rows lacking one of the two series should not count; ``{both}`` is true for the others.
    ``merge`` says how a moment of several sets of rows follows from theirs (sum, min or max); with it
    the metric is available in temporal sub-windows too.
    """

    name: str
    moments: Mapping[str, str]
    value: str
    merge: Mapping[str, str] | None = None

    def __post_init__(self):
        if self.merge is not None and (set(self.merge) != set(self.moments) or set(self.merge.values()) - {"sum", "min", "max"}):
            raise ValueError(f"metric {self.name!r}: merge needs sum, min or max for each of its moments")
        if set(self.moments) & set(_USUAL):
            raise ValueError(f"metric {self.name!r}: {', '.join(_USUAL)} are there already")

    def aggregates(self, x: str, y: str, prefix: str) -> list[str]:
        both = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
        return [f"{sql.format(x=x, y=y, both=both)} AS {self.column(m, prefix)}" for m, sql in self.moments.items()]

    def merges(self, prefix: str) -> list[str]:
        if self.merge is None:
            raise ValueError(f"metric {self.name!r} has no merge, so it can't be had in sub-windows")
        return [f"{how}({self.column(m, prefix)}) AS {self.column(m, prefix)}" for m, how in self.merge.items()]

    def columns(self, prefix: str) -> list[str]:
        return [self.column(m, prefix) for m in self.moments]

    def column(self, moment: str, prefix: str) -> str:
        return f"`{prefix}{self.name}_{moment}`"

    def expression(self, prefix: str) -> str:
        usual = {m: prefix + m for m in _USUAL}
        return f"CAST({self.value.format(**usual, **{m: self.column(m, prefix) for m in self.moments})} AS DOUBLE)"


#: Moments that every pair has.
_USUAL = ("n", "mx", "my", "sx", "sy", "cxy", "msd")

PAIR_METRICS = ("n_obs", "R", "BIAS", "RMSD", "urmsd", "mse", "mse_corr", "mse_bias", "mse_var", "RSS")
TRIPLE_METRICS = ("snr", "beta", "err_std")
TRIPLE_SIDES = ("x", "y", "z")
SLOPE_METRICS = ("R", "BIAS", "urmsd")


def pearson(x: str, y: str) -> str:
    """Correlation; NULL when either series is constant (``corr`` would raise)."""
    return (
        f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


def pair_moments(x: str, y: str, prefix: str = "") -> list[str]:
    """Aggregates from which every pairwise metric follows."""
    return [
        f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS {prefix}n",
        f"avg({x}) AS {prefix}mx",
        f"avg({y}) AS {prefix}my",
        f"stddev_pop({x}) AS {prefix}sx",
        f"stddev_pop({y}) AS {prefix}sy",
        f"covar_pop({x}, {y}) AS {prefix}cxy",
        f"avg(({x} - {y}) * ({x} - {y})) AS {prefix}msd",
    ]


def pair_metric(name: str, prefix: str = "") -> str:
    """One pairwise metric over the columns made by :func:`pair_moments`; x is the reference."""
    n, mx, my, sx, sy, cxy, msd = (prefix + c for c in ("n", "mx", "my", "sx", "sy", "cxy", "msd"))
    return {
        "n_obs": f"CAST({n} AS DOUBLE)",
        "R": f"CASE WHEN {sx} > 0 AND {sy} > 0 THEN {cxy} / ({sx} * {sy}) END",
        "BIAS": f"({mx} - {my})",
        "RMSD": f"sqrt({msd})",
        "urmsd": f"sqrt(greatest({msd} - ({mx} - {my}) * ({mx} - {my}), 0D))",
        "mse": msd,
        "mse_corr": f"2 * ({sx} * {sy} - {cxy})",
        "mse_bias": f"({mx} - {my}) * ({mx} - {my})",
        "mse_var": f"({sx} - {sy}) * ({sx} - {sy})",
        "RSS": f"{msd} * {n}",
    }[name]


def triple_moments(x: str, y: str, z: str, prefix: str = "") -> list[str]:
    pairs = {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}
    return [f"count(CASE WHEN {x} + {y} + {z} IS NOT NULL THEN 1 END) AS {prefix}n"] + [
        f"covar_samp({a}, {b}) AS {prefix}q{name}" for name, (a, b) in pairs.items()
    ]


def triple_metric(metric: str, side: str, prefix: str = "") -> str:
    """Triple collocation ``snr`` (dB), ``beta`` or ``err_std`` of side x, y or z; x is the reference.

    ``err_std`` is in reference units. NULL where a denominator is zero or an error
    variance is negative. A covariance that is nothing but rounding counts as zero.
    """
    q = {name: f"{prefix}q{name}" for name in ("xx", "yy", "zz", "xy", "xz", "yz")}
    own = q[side * 2]
    a, b, opposite = (q[c] for c in {"x": ("xy", "xz", "yz"), "y": ("xy", "yz", "xz"), "z": ("xz", "yz", "xy")}[side])
    usable = " AND ".join(
        f"abs({q[c]}) > {ROUNDING!r}D * sqrt({q[c[0] * 2]} * {q[c[1] * 2]})" for c in ("xy", "xz", "yz")
    )
    scale = {"x": "1D", "y": f"{q['xz']} / {q['yz']}", "z": f"{q['xy']} / {q['yz']}"}[side]
    if metric == "beta":
        return f"CASE WHEN {usable} THEN {scale} END"
    if metric == "err_std":
        variance = f"({own} - {a} * {b} / {opposite})"
        return f"CASE WHEN {usable} THEN CASE WHEN {variance} >= 0 THEN sqrt({variance}) * abs({scale}) END END"
    if metric == "snr":
        noise = f"({own} * {opposite} / ({a} * {b}) - 1)"
        return f"CASE WHEN {usable} THEN CASE WHEN {noise} > 0 THEN -10 * log10({noise}) END END"
    raise ValueError(f"unknown triple collocation metric {metric!r}")
