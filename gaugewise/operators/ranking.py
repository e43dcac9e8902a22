"""Exact ranks and percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task's memory,
and a rank window sorts a whole group in one task. Both are used while the largest group is
small enough for that. Otherwise equal values are first merged map-side, and a hot group is
cut into value ranges at its approximate quantiles (the more the larger it is, up to TILES),
every range being ranked on its own. The quantiles only balance the work: ranks and
percentiles are exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators import skew
from gaugewise.operators.skew import attach, crowding, settle

TILES = 1024
#: The range of a value is looked up among every BLOCK-th cut first, then within one block.
BLOCK = 32


def _quoted(keys: Sequence[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def cumulative_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct value of a group: ``v``, ``cnt`` copies, rows ``below`` it, and the group ``total``."""
    keys, names = list(keys), _quoted(keys)
    values = settle(
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    sizes = settle(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"), F.sum("cnt").alias("_total")))
    crowd = crowding(sizes, "_distinct")
    group = f"PARTITION BY {', '.join(names)}"
    if not crowd.any_hot:
        return values.selectExpr(
            *names,
            "v",
            "cnt",
            f"sum(cnt) OVER ({group} ORDER BY v ROWS UNBOUNDED PRECEDING) - cnt AS below",
            f"sum(cnt) OVER ({group}) AS total",
        )
    # fewer than PARTS groups and at most 2 * PARTS ranges, so everything broadcast below is bounded
    hot = F.broadcast(sizes.where(F.col("_distinct") > crowd.threshold).select(*keys, "_total", "_distinct"))
    probabilities = ", ".join(f"{i / TILES}D" for i in range(1, TILES))
    step = f"greatest(1, floor({TILES} * {crowd.threshold!r}D / _distinct))"
    cuts = (
        values.join(hot, keys)
        .groupBy(*keys, "_total", "_distinct")
        .agg(F.expr(f"approx_percentile(v, array({probabilities}), 10000)").alias("_all"))
        .withColumn("_cuts", F.expr(f"filter(_all, (c, i) -> (i + 1) % {step} = 0)"))
        .withColumn("_blocks", F.expr(f"filter(_cuts, (c, i) -> (i + 1) % {BLOCK} = 0)"))
        .select(*keys, "_total", "_cuts", "_blocks")
    )
    block = f"{BLOCK} * size(filter(_blocks, c -> c < v))"
    tiled = (
        values.join(F.broadcast(cuts), keys, "left")
        .withColumn("_block", F.expr(f"CASE WHEN _cuts IS NULL THEN 0 ELSE {block} END"))
        .withColumn(
            "_tile",
            F.expr(
                "CASE WHEN _cuts IS NULL THEN 0 "
                f"ELSE _block + size(filter(slice(_cuts, _block + 1, {BLOCK - 1}), c -> c < v)) END"
            ),
        )
        .drop("_cuts", "_blocks", "_block")
    )
    offsets = (
        tiled.where(F.col("_total").isNotNull())
        .groupBy(*keys, "_tile")
        .agg(F.sum("cnt").alias("_n"))
        .selectExpr(
            *names,
            "_tile",
            f"coalesce(sum(_n) OVER ({group} ORDER BY _tile "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset",
        )
    )
    return (
        tiled.selectExpr(
            "*",
            f"sum(cnt) OVER ({group}, _tile ORDER BY v ROWS UNBOUNDED PRECEDING) - cnt AS _below",
            f"sum(cnt) OVER ({group}, _tile) AS _in_tile",
        )
        .join(F.broadcast(offsets), [*keys, "_tile"], "left")
        .selectExpr(
            *names,
            "v",
            "cnt",
            "_below + coalesce(_offset, 0) AS below",
            "coalesce(_total, _in_tile) AS total",
        )
    )


def percentiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    mean: str | None = None,
) -> DataFrame:
    """Exact interpolated percentiles (name -> probability in 0..1) of every group, and its size ``n``.

    ``mean`` names an additional column with the average.
    """
    keys = list(keys)
    rows = settle(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")))
    names = list(probabilities)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if crowding(sizes).largest <= skew.FLOOR:
        wanted = ", ".join(f"{probabilities[name]!r}D" for name in names)
        averages = [F.avg("v").alias(mean)] if mean else []
        return (
            rows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), *averages, F.expr(f"percentile(v, array({wanted}))").alias("_p"))
            .select(
                *keys,
                "n",
                *([mean] if mean else []),
                *[F.col("_p")[i].alias(name) for i, name in enumerate(names)],
            )
        )
    averages = [F.expr("sum(v * cnt) / sum(cnt)").alias(mean)] if mean else []

    def holding(index):
        return f"max(CASE WHEN below <= {index} AND {index} < below + cnt THEN v END)"

    aggregates = []
    for name in names:
        at = f"({probabilities[name]!r}D * (total - 1))"
        lower, upper = holding(f"floor({at})"), holding(f"ceil({at})")
        aggregates.append(F.expr(f"{lower} + max({at} - floor({at})) * ({upper} - {lower})").alias(name))
    counted = cumulative_counts(rows, keys, "v")
    return counted.groupBy(*keys).agg(F.max("total").alias("n"), *averages, *aggregates)


def with_ranks(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``rank_<column>``: the average rank (ties share it) of the row in its group; NULL has none."""
    keys, names = list(keys), _quoted(keys)
    rows = settle(rows)
    group = f"PARTITION BY {', '.join(names)}"
    if not crowding(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))).any_hot:
        return rows.selectExpr(
            "*",
            *[
                # equal rows are counted in the rank's own order, which spares a second sort
                f"CASE WHEN `{c}` IS NOT NULL THEN rank() OVER ({group} ORDER BY `{c}` NULLS LAST) "
                f"+ (count(1) OVER ({group} ORDER BY `{c}` NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2D "
                f"END AS `rank_{c}`"
                for c in columns
            ],
        )
    series = ", ".join(f"struct('{c}' AS _column, CAST(`{c}` AS DOUBLE) AS _value)" for c in columns)
    counted = settle(
        cumulative_counts(rows.selectExpr(*names, f"inline(array({series}))"), [*keys, "_column"], "_value")
    )
    ranked = rows
    for column in columns:
        ranks = counted.where(F.col("_column") == column).selectExpr(
            *names, f"v AS `{column}`", f"below + (cnt + 1) / 2D AS `rank_{column}`", "cnt AS _n"
        )
        ranked = attach(ranked, ranks, [*keys, column], count_col="_n", how="left")
    return ranked
