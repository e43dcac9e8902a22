"""Rescaling of the other datasets of matched rows onto a scaling reference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.beta import distinct_percentiles
from gaugewise.operators.ranking import percentiles
from gaugewise.operators.skew import attach, settle

# Percentiles at which two distributions are matched.
CDF_PERCENTILES = (0, 5, 10, 30, 50, 70, 90, 95, 100)

METHODS = ("none", "min_max", "linreg", "mean_std", "cdf_match", "cdf_beta_match")


def scale(
    matched: DataFrame,
    method: str,
    reference: str,
    others: Sequence[str],
    by: Sequence[str] = ("gpi",),
) -> DataFrame:
    """``matched`` with every column of ``others`` mapped onto the distribution of ``reference``.

    A series without spread cannot be scaled and becomes NULL.
    """
    if method == "none":
        return matched
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}")
    # read twice below: once for the statistics, once to apply them
    matched = settle(matched)
    if method in ("cdf_match", "cdf_beta_match"):
        return _cdf_match(matched, reference, list(others), list(by), beta=method == "cdf_beta_match")
    x = f"`{reference}`"
    aggregates, scaled = ["count(1) AS _n"], {}
    if method == "min_max":
        aggregates += [f"min({x}) AS _lo_x", f"max({x}) AS _hi_x"]
    elif method == "mean_std":
        aggregates += [f"avg({x}) AS _m_x", f"stddev_pop({x}) AS _s_x"]
    for i, name in enumerate(others):
        y = f"`{name}`"
        if method == "min_max":
            aggregates += [f"min({y}) AS _lo_{i}", f"max({y}) AS _hi_{i}"]
            scaled[name] = f"try_divide({y} - _lo_{i}, _hi_{i} - _lo_{i}) * (_hi_x - _lo_x) + _lo_x"
        elif method == "mean_std":
            aggregates += [f"avg({y}) AS _m_{i}", f"stddev_pop({y}) AS _s_{i}"]
            scaled[name] = f"try_divide({y} - _m_{i}, _s_{i}) * _s_x + _m_x"
        else:
            aggregates += [
                f"CASE WHEN var_pop({y}) > 0 THEN covar_pop({x}, {y}) / var_pop({y}) END AS _b_{i}",
                f"CASE WHEN var_pop({y}) > 0 THEN avg({x}) - covar_pop({x}, {y}) / var_pop({y}) * avg({y}) END AS _a_{i}",
            ]
            scaled[name] = f"_a_{i} + _b_{i} * {y}"
    statistics = matched.groupBy(*by).agg(*map(F.expr, aggregates))
    rows = attach(matched, statistics, by, count_col="_n")
    return rows.selectExpr(
        *[f"{scaled[c]} AS `{c}`" if c in scaled else f"`{c}`" for c in matched.columns]
    )


def _cdf_match(matched: DataFrame, reference: str, others: list[str], by: list[str], beta: bool) -> DataFrame:
    names = [reference, *others]
    series = ", ".join(f"struct({i} AS _series, `{name}` AS _value)" for i, name in enumerate(names))
    probabilities = {f"p{p}": p / 100 for p in CDF_PERCENTILES}
    columns = [f"`{k}`" for k in by]
    points = percentiles(
        matched.selectExpr(*columns, f"inline(array({series}))"), [*by, "_series"], "_value", probabilities
    )
    points = points.select(*by, "_series", "n", F.array(*probabilities).alias("_points"))
    if beta:
        points = distinct_percentiles(points, "_points")
    per_key = points.groupBy(*by).agg(
        F.max("n").alias("_n"),
        *[F.max(F.when(F.col("_series") == i, F.col("_points"))).alias(f"_points_{i}") for i in range(len(names))],
    )
    # plain columns, so that the map below stays in generated code
    flat = per_key.selectExpr(
        *columns,
        "_n",
        *[f"_points_{i}[{k}] AS _q_{i}_{k}" for i in range(len(names)) for k in range(len(CDF_PERCENTILES))],
    )
    rows = attach(matched, flat, by, count_col="_n")
    scaled = {name: _piecewise(f"`{name}`", i) for i, name in enumerate(others, start=1)}
    return rows.selectExpr(*[f"{scaled[c]} AS `{c}`" if c in scaled else f"`{c}`" for c in matched.columns])


def _piecewise(y: str, i: int) -> str:
    """Linear map from the percentiles of series i to those of the reference; the end pieces extrapolate."""
    last = len(CDF_PERCENTILES) - 1

    def piece(k: int) -> str:
        return (
            f"_q_0_{k} + ({y} - _q_{i}_{k}) / (_q_{i}_{k + 1} - _q_{i}_{k}) * (_q_0_{k + 1} - _q_0_{k})"
        )

    cases = [f"WHEN _q_{i}_{k + 1} > _q_{i}_{k} AND {y} <= _q_{i}_{k + 1} THEN {piece(k)}" for k in range(last)]
    beyond = reduce(
        lambda rest, k: f"CASE WHEN _q_{i}_{k + 1} > _q_{i}_{k} THEN {piece(k)} ELSE {rest} END", range(last), "NULL"
    )
    return f"CASE {' '.join(cases)} ELSE {beyond} END"
