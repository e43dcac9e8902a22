"""Result naming, wide results, status counts, summaries and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.ranking import percentiles
from gaugewise.operators.skew import settle
from gaugewise.operators.spatial import nearest
from gaugewise.operators.subwindows import SEPARATOR


def with_metric_key(metrics: DataFrame) -> DataFrame:
    """Adds ``metric_key``: ``[tsw|]metric_between_a_and_b``."""
    prefix = F.concat(F.col("tsw"), F.lit(SEPARATOR)) if "tsw" in metrics.columns else F.lit("")
    return metrics.withColumn("metric_key", F.concat(prefix, "metric", F.lit("_between_"), "combo"))


def pivot_results(metrics: DataFrame, metric_keys: Sequence[str], key: str = "gpi") -> DataFrame:
    """One row per location, one column per metric key.

    The keys are known from the configuration, so no extra pass looks them up.
    """
    named = with_metric_key(metrics)
    return named.groupBy(key).agg(
        *[F.expr(f"max(CASE WHEN metric_key = '{k}' THEN value END) AS `{k}`") for k in metric_keys]
    )


def point_status(metrics: DataFrame, combo: str, key: str = "gpi") -> DataFrame:
    """``key, ok``: whether all statuses of one combination are 0; yearly windows do not count."""
    rows = metrics.where((F.col("metric") == "status") & (F.col("combo") == combo))
    if "tsw" in metrics.columns:
        rows = rows.where(~F.col("tsw").rlike("^[0-9]+$"))
    return rows.groupBy(key).agg(F.expr("bool_and(value = 0)").alias("ok"))


def count_status(metrics: DataFrame, combo: str, points: DataFrame, key: str = "gpi") -> DataFrame:
    """One row: ``total``, ``ok``, ``error`` over all points of the run; a point without result is an error."""
    joined = points.select(key).join(point_status(metrics, combo, key), key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.expr("count_if(coalesce(ok, false))").alias("ok"),
        F.expr("count_if(NOT coalesce(ok, false))").alias("error"),
    )


def with_missing_points(metrics: DataFrame, points: DataFrame, data: DataFrame, combo: str) -> DataFrame:
    """Status rows for points that have no metrics: 7 without any data, 4 with data but no match."""
    from gaugewise.operators.metrics import STATUS_NO_DATA, STATUS_NO_MATCH

    missing = points.select("gpi").join(metrics.select("gpi").distinct(), "gpi", "left_anti")
    has_data = data.select("gpi").distinct().withColumn("_has", F.lit(True))
    rows = missing.join(has_data, "gpi", "left").select(
        "gpi",
        F.lit(combo).alias("combo"),
        F.lit("status").alias("metric"),
        F.when(F.col("_has"), float(STATUS_NO_MATCH)).otherwise(float(STATUS_NO_DATA)).alias("value"),
    )
    if "tsw" in metrics.columns:
        rows = rows.withColumn("tsw", F.lit("bulk"))
    return metrics.unionByName(rows.select(*metrics.columns))


def progress(counts: DataFrame) -> DataFrame:
    """Adds ``progress``: finished points in whole percent."""
    return counts.withColumn("progress", F.expr("CAST(bround(100D * (ok + error) / total) AS INT)"))


SUMMARY_PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def summary(metrics: DataFrame, by: Sequence[str] = ("combo", "metric")) -> DataFrame:
    """Mean, median and quartiles of every metric over all locations.

    There are few groups and each spans all locations; the percentiles are computed over
    value ranges so that no task holds a whole group.
    """
    return percentiles(metrics, by, "value", SUMMARY_PERCENTILES, mean="mean")


def metric_catalog(metrics: DataFrame) -> DataFrame:
    """Which metric exists for which pair or triple, with the names shown to users."""
    return (
        metrics.select("combo", "metric")
        .distinct()
        .selectExpr(
            "combo",
            "metric",
            "replace(combo, '_and_', ' and ') AS pretty_combo",
            "CASE size(split(combo, '_and_')) WHEN 2 THEN 'pair' WHEN 3 THEN 'triple' END AS kind",
        )
    )


#: Separates the datasets in the name of a result table.
DATASET_JOINER = "_with_"


def join_dataset_keys(keys: Sequence[str]) -> str:
    return DATASET_JOINER.join(keys)


def dataset_keys(name: str | Column) -> list[str] | Column:
    """The datasets named in the name of a result table (plain text or a column)."""
    return name.split(DATASET_JOINER) if isinstance(name, str) else F.split(name, DATASET_JOINER)


def unlisted(used: DataFrame, known: DataFrame, key: str = "dataset") -> DataFrame:
    """Datasets that occur in results but not in a list of known ones."""
    return used.select(key).distinct().join(known.select(key), key, "left_anti")


def first_per_class(rows: DataFrame, kind: str, order: Sequence[str], keep: int = 5) -> DataFrame:
    """The first rows of every class; the planner limits each task to ``keep`` rows per class before the shuffle."""
    ranked = rows.withColumn(
        "_k", F.expr(f"row_number() OVER (PARTITION BY `{kind}` ORDER BY {', '.join(f'`{o}`' for o in order)})")
    )
    return ranked.where(F.col("_k") <= keep).drop("_k")


# Names of overview plots of pairs and of triples.
PAIR_PLOT = "overview_{ref}_and_{other}_{metric}.png"
PAIR_PLOT_PATTERN = r"^(?:bulk_)?overview_(\d+)-(.+)_and_(\d+)-([^_]+)_(.+)\.png$"
TRIPLE_PLOT_PATTERN = r"^(?:bulk_)?overview_(\d+)-(.+)_and_(\d+)-(.+)_and_(\d+)-([^_]+)_(snr|beta|err_std)_for_(\d+)-(.+)\.png$"


def parse_plot_names(files: DataFrame, name: str = "file") -> DataFrame:
    """``kind`` (pair or triple), ``combo`` and ``metric`` of overview plots; other files are left out."""
    text = F.col(name)

    def part(pattern, *groups):
        return F.concat_ws("-", *[F.regexp_extract(text, pattern, g) for g in groups])

    triple, pair = text.rlike(TRIPLE_PLOT_PATTERN), text.rlike(PAIR_PLOT_PATTERN)
    p, t = PAIR_PLOT_PATTERN, TRIPLE_PLOT_PATTERN
    return files.where(triple | pair).select(
        text.alias(name),
        F.when(triple, "triple").otherwise("pair").alias("kind"),
        F.when(triple, F.concat_ws("_and_", part(t, 1, 2), part(t, 3, 4), part(t, 5, 6)))
        .otherwise(F.concat_ws("_and_", part(p, 1, 2), part(p, 3, 4)))
        .alias("combo"),
        F.when(triple, F.concat(F.regexp_extract(text, t, 7), F.lit("_for_"), part(t, 8, 9)))
        .otherwise(F.regexp_extract(text, p, 5))
        .alias("metric"),
    )


def compare_runs(
    first: DataFrame,
    second: DataFrame,
    metrics: Sequence[str],
    intersection: bool = True,
    extent=None,
    key: str = "gpi",
) -> DataFrame:
    """Two wide result sets side by side: per metric ``<m>_1``, ``<m>_2`` and ``<m>_diff``.

    ``intersection`` keeps common locations only, otherwise all of both. ``extent`` is a
    predicate on the inputs.
    """
    if extent is not None:
        first, second = first.where(extent), second.where(extent)
    left = first.select(key, *[F.col(m).alias(f"{m}_1") for m in metrics])
    right = second.select(key, *[F.col(m).alias(f"{m}_2") for m in metrics])
    joined = left.join(right, key, "inner" if intersection else "full_outer")
    return joined.select(
        key,
        *[c for m in metrics for c in (F.col(f"{m}_1"), F.col(f"{m}_2"), (F.col(f"{m}_1") - F.col(f"{m}_2")).alias(f"{m}_diff"))],
    )


def compare_regridded(
    first: DataFrame,
    second: DataFrame,
    first_points: DataFrame,
    second_points: DataFrame,
    metrics: Sequence[str],
    max_dist_m: float,
    intersection: bool = True,
    extent=None,
    key: str = "gpi",
) -> DataFrame:
    """Two wide result sets on different grids, side by side as of ``compare_runs``.

    A location of the second run goes to the nearest location of the first that lies within
    ``max_dist_m`` (half a grid step); of several that go to one place the nearest stays, then the one
    with the smaller id. With ``intersection`` only places of both remain. Otherwise locations of the
    second run without a partner follow under their own id with ``<key>_2``, places of the first have a
    null there. ``extent`` is a predicate on the points' coordinates.
    """
    if extent is not None:
        first_points, second_points = first_points.where(extent), second_points.where(extent)
    own = first_points.join(first.select(key), key, "left_semi").select(key, "lon", "lat")
    other = second_points.join(second.select(key), key, "left_semi").select(key, "lon", "lat")
    hits = nearest(other, own, max_dist_m).select(F.col(key).alias(f"{key}_2"), F.col("other_gpi").alias(key), "distance_m")
    # one row a place: an aggregate, so that a crowd of points around one place is merged before it travels
    best = F.min(F.struct(F.round("distance_m", 3).alias("d"), F.col(f"{key}_2").alias("k")))
    paired = settle(hits.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.k").alias(f"{key}_2")))
    left = first.join(own.select(key), key, "left_semi").select(key, *[F.col(m).alias(f"{m}_1") for m in metrics])
    right = second.join(other.select(key), key, "left_semi").select(
        F.col(key).alias(f"{key}_2"), *[F.col(m).alias(f"{m}_2") for m in metrics]
    )
    joined = left.join(paired, key, "inner" if intersection else "left").join(right, f"{key}_2", "inner" if intersection else "full_outer")
    return joined.select(
        key,
        f"{key}_2",
        *[c for m in metrics for c in (F.col(f"{m}_1"), F.col(f"{m}_2"), (F.col(f"{m}_1") - F.col(f"{m}_2")).alias(f"{m}_diff"))],
    )


def common_interval(ranges: DataFrame, start=None, end=None) -> DataFrame:
    """One row: from the latest start to the earliest end of the datasets, within the run's interval.

    ``ranges`` has ``dataset``, ``first`` and ``last`` of every dataset. Null and null if they do not overlap.
    """
    found = ranges.agg(F.max("first").alias("a"), F.min("last").alias("b"))
    if start is not None:
        found = found.withColumn("a", F.greatest("a", F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        found = found.withColumn("b", F.least("b", F.lit(end).cast("timestamp_ntz")))
    overlap = F.col("a") <= F.col("b")
    return found.select(F.when(overlap, F.col("a")).alias("actual_from"), F.when(overlap, F.col("b")).alias("actual_to"))


def difference_table(compared: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Summary (count, mean, median, quartiles) of the differences of two runs, one row per metric."""
    rows = ", ".join(f"struct('{m}' AS metric, `{m}_diff` AS value)" for m in metrics)
    return summary(compared.selectExpr(f"inline(array({rows}))"), by=("metric",))
