"""Percentiles read off a fitted beta distribution, for series whose percentiles repeat.

The distribution function is integrated over x = 1 / (1 + exp(-pi sinh t)): there the integrand is
smooth and vanishes quickly at both ends whatever the parameters, so a sum over evenly spaced t is
exact to many digits. All of it is Spark's own expressions over arrays of fixed length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBABILITIES = (0.0, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)
#: Nodes lie at -REACH ... REACH, where the integrand has vanished for parameters down to a hundredth.
REACH, NODES = 8.0, 8192
_STEP = 2 * REACH / NODES


def _logs(t: float) -> tuple[float, float, float]:
    """Logarithms of x, 1 - x and of dx/dt / (x (1 - x))."""
    z = math.pi * math.sinh(t)
    log_x = -math.log1p(math.exp(-z)) if z > 0 else z - math.log1p(math.exp(z))
    return log_x, log_x - z, math.log(math.pi * math.cosh(t))


def _constant(values) -> str:
    """An array literal (SQL text); one string, which is folded once however many numbers it has."""
    return "CAST(split('" + ",".join(map(repr, values)) + "', ',') AS ARRAY<DOUBLE>)"


def _sum(term: str) -> str:
    """``term`` over the pieces between neighbouring percentiles, weighted by probability (SQL text)."""
    parts = []
    for k in range(len(PROBABILITIES) - 1):
        width = PROBABILITIES[k + 1] - PROBABILITIES[k]
        parts.append(f"{width!r}D * ({term.format(a=f'_unit[{k}]', b=f'_unit[{k + 1}]')})")
    return "(" + " + ".join(parts) + ")"


def distinct_percentiles(frame: DataFrame, points: str) -> DataFrame:
    """``frame`` with the percentile array ``points`` replaced by beta-fitted percentiles where values repeat.

    The fit is the beta distribution on [min, max] with the mean and variance of the piecewise linear
    distribution through the percentiles. Where it does not exist the percentiles are spread evenly.
    Arrays with a null or without spread stay as they are. One row is one series of one location.
    """
    last = len(PROBABILITIES) - 1
    p, columns = f"`{points}`", frame.columns
    repeats = " OR ".join(f"{p}[{k + 1}] <= {p}[{k}]" for k in range(last))
    needed = f"(NOT exists({p}, v -> v IS NULL OR isnan(v)) AND {p}[{last}] > {p}[0] AND ({repeats}))"
    step = frame.selectExpr("*", f"CASE WHEN {needed} THEN transform({p}, v -> (v - {p}[0]) / ({p}[{last}] - {p}[0])) END AS _unit")
    step = step.selectExpr("*", f"{_sum('({a} + {b}) / 2')} AS _mean", f"{_sum('({a} * {a} + {a} * {b} + {b} * {b}) / 3')} AS _square")
    step = step.selectExpr("*", "_mean * (1 - _mean) / nullif(greatest(_square - _mean * _mean, 0D), 0D) - 1 AS _strength")
    step = step.selectExpr("*", "CASE WHEN _strength > 0 AND _mean > 0 AND _mean < 1 THEN _strength END AS _ab")
    # density over t up to a factor; its logarithm is shifted by the one at the mean, near its top
    x, y, w = (_constant(column) for column in zip(*(_logs(-REACH + _STEP * k) for k in range(NODES + 1))))
    logs = f"zip_with({x}, {y}, (x, y) -> _mean * _ab * (x - ln(_mean)) + (1 - _mean) * _ab * (y - ln(1 - _mean)))"
    density = f"zip_with({logs}, {w}, (v, w) -> exp(v + w))"
    step = step.selectExpr("*", f"CASE WHEN _ab IS NOT NULL THEN {density} END AS _g")
    step = step.selectExpr("*", "aggregate(_g, 0D, (sum, g) -> sum + g) AS _total")
    # one walk over the nodes keeps, where the running sum passes a wanted share, the node, what is still
    # missing there and the density around
    wanted = list(range(1, last))
    passing = "CAST(NULL AS STRUCT<k: INT, rest: DOUBLE, a: DOUBLE, b: DOUBLE, c: DOUBLE>)"
    start = ", ".join(["0 AS k", "0D AS upto", "0D AS g0", "0D AS g1", *(f"{passing} AS t{i}" for i in wanted)])
    moved = ["s.k + 1 AS k", "s.upto + (s.g1 + g) / 2 AS upto", "s.g1 AS g0", "g AS g1"]
    for i in wanted:
        share = f"{PROBABILITIES[i]!r}D * _total"
        # trapezoids less the first term of their error
        found = f"struct(s.k - 1 AS k, {share} - s.upto + (g - s.g0) / 24 AS rest, s.g1 AS a, (g - s.g0) / 2 AS b, (g - 2 * s.g1 + s.g0) / 2 AS c)"
        passed = f"s.t{i} IS NULL AND s.upto + (s.g1 + g) / 2 >= {share}"
        moved.append(f"CASE WHEN {passed} THEN {found} ELSE s.t{i} END AS t{i}")
    walk = f"aggregate(_g, struct({start}), (s, g) -> struct({', '.join(moved)}))"
    step = step.selectExpr("*", f"{walk} AS _w").selectExpr("*", "array(" + ", ".join(f"_w.t{i}" for i in wanted) + ") AS _t")
    # inside a step of u = 0 ... 1 the density is a + b u + c u^2; its integral reaches the rest at the root by Newton
    step = step.selectExpr("*", "transform(_t, t -> 2 * t.rest / (t.a + sqrt(greatest(t.a * t.a + 4 * (t.b + t.c) * t.rest, 0D)))) AS _u")
    for _ in range(3):
        newton = "u - (t.a * u + t.b * u * u / 2 + t.c * u * u * u / 3 - t.rest) / (t.a + t.b * u + t.c * u * u)"
        step = step.withColumn("_u", F.expr(f"zip_with(_t, _u, (t, u) -> {newton})"))
    places = [f"1 / (1 + exp(-pi() * sinh({-REACH!r}D + {_STEP!r}D * (_t[{j}].k + _u[{j}]))))" for j in range(len(wanted))]
    span = f"({p}[{last}] - {p}[0])"
    fitted = ", ".join([f"{p}[0]", *(f"{p}[0] + {x} * {span}" for x in places), f"{p}[{last}]"])
    even = ", ".join(f"{p}[0] + {q!r}D * {span}" for q in PROBABILITIES)
    replaced = f"CASE WHEN _unit IS NULL THEN {p} WHEN _ab IS NULL THEN array({even}) ELSE array({fitted}) END"
    return step.selectExpr(*[f"{replaced} AS `{c}`" if c == points else f"`{c}`" for c in columns])
