"""From a run configuration to one DataFrame plan, and from the plan to written results."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugewise.config import ANOMALY_METHODS, SCALING_METHODS, UPSCALING_METHODS, DatasetConfig, RunConfig
from gaugewise.functions import stats
from gaugewise.functions.geo import in_bbox
from gaugewise.functions.timing import half_window_us, within_period
from gaugewise.operators import filters as flt
from gaugewise.operators import results as res
from gaugewise.operators.bootstrap import triple_intervals
from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_long, pair_names, rank_correlations, triple_names, window_metrics
from gaugewise.operators.moments import Cells, recurring_cells, yearly_cells
from gaugewise.operators.scaling import scale
from gaugewise.operators.series import climatology_anomaly, moving_anomaly
from gaugewise.operators.spatial import nearest
from gaugewise.operators.skew import attach, intermediate_results, settle
from gaugewise.operators.stability import stability_slopes
from gaugewise.operators.subwindows import BULK, INTRA_ANNUAL, SEPARATOR
from gaugewise.operators.upscaling import lookup_table, upscale
from gaugewise.session import require_utc
from gaugewise.sinks import metadata
from gaugewise.sinks import results as sink
from gaugewise.sources.loaders import STATION_READERS, Source, load
from gaugewise.sources.timestamps import adapt_timestamps, raw_period, time_rule

LOG = logging.getLogger(__name__)
ANOMALY_WINDOW_DAYS = 35


@dataclass(frozen=True)
class RunResult:
    path: str
    table: str
    total: int
    ok: int
    error: int


class ValidationPlan:
    """Lazy pieces of a run. Per dataset: read, exact time, filters, anomaly; then match, scale, metrics."""

    def __init__(
        self,
        spark: SparkSession,
        run: RunConfig,
        sources: dict[int, Source] | None = None,
        own_metrics: Sequence[stats.PairMetric] = (),
    ):
        if run.intra_annual_metrics and run.stability_metrics:
            raise ValueError("intra-annual and stability metrics exclude each other")
        if run.intra_annual_metrics and run.intra_annual_type not in INTRA_ANNUAL:
            raise ValueError(f"intra_annual_type has to be one of {', '.join(INTRA_ANNUAL)}")
        for name, choices in (
            ("scaling_method", SCALING_METHODS),
            ("anomalies", ANOMALY_METHODS),
            ("upscaling_method", UPSCALING_METHODS),
        ):
            if getattr(run, name) not in choices:
                raise ValueError(f"{name} has to be one of {', '.join(choices)}")
        if len(run.datasets) < 2:
            raise ValueError("a run needs at least two dataset configurations")
        if len({config.id for config in run.datasets}) < len(run.datasets):
            raise ValueError("dataset configurations need different ids")
        require_utc(spark)
        taken = {*stats.PAIR_METRICS, "rho", "status"}
        for metric in own_metrics:
            if metric.name in taken:
                raise ValueError(f"there is a metric {metric.name!r} already")
            taken.add(metric.name)
        self.spark, self.run, self.own_metrics = spark, run, tuple(own_metrics)
        self._sources = dict(sources or {})
        self._lookups: dict[int, DataFrame] = {}
        #: Whether the reference points of a plan are fewer than those of the reference dataset.
        self.restricted = None not in run.bbox or run.spatial_ref.reader in STATION_READERS

    # -- inputs ----------------------------------------------------------------------------

    def source(self, config: DatasetConfig) -> Source:
        if config.id not in self._sources:
            self._sources[config.id] = load(self.spark, config)
        return self._sources[config.id]

    def eligible(self, config: DatasetConfig) -> DataFrame:
        """Points of a dataset that have a place and pass its station filters, all over the globe."""
        points = self.source(config).points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        if config.reader in STATION_READERS and {"depth_from", "depth_to", "network"} <= set(points.columns):
            if flt.FRM in config.filters and "frm_class" not in points.columns:
                LOG.warning("%s has no frm_class; its class filter is left out", config.short_name)
            points = flt.select_sensors(points, config.filters, config.parametrised_filters)
        return points

    def points(self, config: DatasetConfig) -> DataFrame:
        """Eligible points inside the bounding box."""
        return self.eligible(config).where(in_bbox(*self.run.bbox))

    def lookup(self, config: DatasetConfig) -> DataFrame:
        """Points of a dataset under their nearest reference points.

        Made once against the whole reference grid, so that neither batches nor the bounding box
        move a point to another reference point.
        """
        if config.id not in self._lookups:
            table = lookup_table(self.eligible(self.run.spatial_ref), self.eligible(config))
            self._lookups[config.id] = settle(table)
        return self._lookups[config.id]

    def series(self, config: DatasetConfig) -> DataFrame:
        """``gpi, ts, value`` of one dataset after exact times, filters and anomalies."""
        run, variable = self.run, config.variable
        raw = self.source(config).series
        rule = time_rule(config.short_name, config.version)
        margin = timedelta(days=ANOMALY_WINDOW_DAYS / 2) if run.anomalies == "moving_avg_35_d" else timedelta(0)
        needs_all = run.anomalies == "climatology"
        bounded = run.period is not None and not needs_all
        if needs_all and run.period and run.anomalies_from and run.anomalies_to:
            spans = (run.period, (run.anomalies_from, run.anomalies_to))
            if rule:
                raw = raw.where(raw_period(rule, *spans[0]) | raw_period(rule, *spans[1]))
        if bounded:
            start, end = run.period[0] - margin, run.period[1] + margin
            raw = raw.where(raw_period(rule, start, end)) if rule else raw
        exact = adapt_timestamps(raw, config.short_name, config.version)
        if bounded:
            exact = exact.where(within_period(F.col("ts"), start, end))
        kept = exact.where(flt.keep(variable, config.filters, config.parametrised_filters)).select(
            "gpi", "ts", F.nanvl(F.col(variable.name).cast("double"), F.lit(None).cast("double")).alias("value")
        )
        kept = kept.where(F.col("value").isNotNull() & F.col("ts").isNotNull())
        if run.anomalies == "moving_avg_35_d":
            kept = moving_anomaly(kept, ANOMALY_WINDOW_DAYS)
        elif run.anomalies == "climatology":
            kept = climatology_anomaly(kept, run.anomalies_from, run.anomalies_to)
        if run.period and (margin or needs_all):
            kept = kept.where(within_period(F.col("ts"), *run.period))
        return kept

    # -- matching --------------------------------------------------------------------------

    def reference_points(self) -> DataFrame:
        return self.points(self.run.spatial_ref)

    def located_series(self, config: DatasetConfig, reference_points: DataFrame) -> DataFrame:
        """A dataset's series under the reference points it belongs to (``gpi`` is the reference)."""
        # rows per location before filters: a scan of one column
        sizes = self.source(config).series.groupBy("gpi").agg(F.count(F.lit(1)).alias("n"))
        if config.id == self.run.spatial_ref.id:
            if not self.restricted:
                return self.series(config)
            return attach(self.series(config), reference_points.select("gpi").join(sizes, "gpi"), ["gpi"])
        if self.run.upscaling_method != "none":
            chosen = reference_points.select(F.col("gpi").alias("ref_gpi"))
            lut = self.lookup(config).join(chosen, "ref_gpi", "left_semi")
            return upscale(self.series(config), lut, self.run.temporal_stability, sizes)
        hits = nearest(reference_points, self.eligible(config), config.max_dist_m)
        mapping = hits.select(F.col("gpi").alias("_ref"), F.col("other_gpi").alias("gpi")).join(sizes, "gpi")
        placed = attach(self.series(config), mapping, ["gpi"])
        return placed.select(F.col("_ref").alias("gpi"), "ts", "value")

    def matched(self, reference_points: DataFrame) -> DataFrame:
        """Rows in which all datasets have a value: ``gpi, ts`` and one column per dataset."""
        run = self.run
        union = None
        for config in run.datasets:
            tagged = self.located_series(config, reference_points).withColumn("dataset", F.lit(run.name_of(config)))
            union = tagged if union is None else union.unionByName(tagged)
        temporal = run.name_of(run.temporal_ref or run.spatial_ref)
        others = [name for name in run.names.values() if name != temporal]
        matched = match_datasets(union, temporal, others, half_window_us(run.temporal_matching))
        scaling_ref = run.name_of(run.scaling_ref or run.spatial_ref)
        scaled = [name for name in run.names.values() if name != scaling_ref]
        method = run.scaling_method
        return scale(matched, method, scaling_ref, scaled)

    # -- metrics ---------------------------------------------------------------------------

    @property
    def reference(self) -> str:
        return self.run.name_of(self.run.spatial_ref)

    @property
    def others(self) -> list[str]:
        return [name for name in self.run.names.values() if name != self.reference]

    @property
    def with_triples(self) -> bool:
        return self.run.tcol is True and len(self.run.datasets) >= 3

    def cells(self) -> Cells | None:
        """The cells that the run's sub-windows are merged from."""
        run = self.run
        if run.intra_annual_metrics:
            return recurring_cells(INTRA_ANNUAL[run.intra_annual_type], int(run.intra_annual_overlap or 0))
        return yearly_cells() if run.stability_metrics else None

    def metrics(self, matched: DataFrame) -> DataFrame:
        cells = self.cells()
        if cells is None:
            by = ["gpi"]
            tidy = metrics_long(
                matched, self.reference, self.others, by=by, triples=self.with_triples, rank_correlation=True,
                own=self.own_metrics,
            )
        else:
            matched, by = settle(matched), ["gpi", "tsw"]  # settled for the moments and the ranks
            tidy = window_metrics(matched, self.reference, self.others, cells, triples=self.with_triples, own=self.own_metrics)
            tidy = tidy.unionByName(rank_correlations(matched, self.reference, self.others, cells))
        if self.run.stability_metrics:
            tidy = settle(tidy)  # for the slopes and the result
            tidy = tidy.unionByName(stability_slopes(tidy).select(*tidy.columns))
        if self.with_triples and self.run.bootstrap_tcol_cis:
            for names in triple_names(self.reference, self.others):
                bounds = triple_intervals(matched, names, cells=cells).selectExpr(
                    *by,
                    f"'{'_and_'.join(names)}' AS combo",
                    "inline(array(struct(concat(metric, '_ci_lower_', dataset) AS metric, lower AS value),"
                    " struct(concat(metric, '_ci_upper_', dataset) AS metric, upper AS value)))",
                )
                tidy = tidy.unionByName(bounds)
        return tidy

    def metric_keys(self, windows: list[str]) -> list[str]:
        """Result columns that follow from the configuration."""
        keys = []
        for window in windows or [None]:
            prefix = f"{window}{SEPARATOR}" if window else ""
            for names in pair_names(self.reference, self.others):
                combo = "_and_".join(names)
                metrics = [*stats.PAIR_METRICS, "rho", *(m.name for m in self.own_metrics), "status"]
                if self.run.stability_metrics and window == BULK:
                    metrics += ["slopeR", "slopeBIAS", "slopeURMSD"]
                keys += [f"{prefix}{m}_between_{combo}" for m in metrics]
            for names in triple_names(self.reference, self.others) if self.with_triples else ():
                combo = "_and_".join(names)
                kinds = ["", "_ci_lower", "_ci_upper"] if self.run.bootstrap_tcol_cis else [""]
                metrics = [f"{m}{k}_{d}" for m in stats.TRIPLE_METRICS for k in kinds for d in names] + ["status"]
                keys += [f"{prefix}{m}_between_{combo}" for m in metrics]
        return list(dict.fromkeys(keys))

    def windows(self, metrics: DataFrame | None = None) -> list[str]:
        run = self.run
        if run.intra_annual_metrics:
            return [w.name for w in INTRA_ANNUAL[run.intra_annual_type]] + [BULK]
        if run.stability_metrics:
            if run.period:
                years = range(run.period[0].year, run.period[1].year + 1)
                return [str(y) for y in years] + [BULK]
            # one row per calendar year
            found = metrics.select("tsw").distinct().collect()
            return sorted(row["tsw"] for row in found)
        return []

    @property
    def output_name(self) -> str:
        """Name of the result table: the datasets with their variables, reference first."""
        labels = {self.run.name_of(c): f"{self.run.name_of(c)}.{c.variable.name}" for c in self.run.datasets}
        return res.join_dataset_keys([labels[name] for name in (self.reference, *self.others)])

    @property
    def first_combo(self) -> str:
        return "_and_".join(pair_names(self.reference, self.others)[0]) if self.others else self.reference

    def wide(self, metrics: DataFrame, reference_points: DataFrame) -> DataFrame:
        """One row per location: coordinates, station metadata, and one column per metric key."""
        keys = self.metric_keys(self.windows(metrics))
        return reference_points.join(res.pivot_results(metrics, keys), "gpi", "left")


# --- execution --------------------------------------------------------------------------------


@contextmanager
def tracked(spark: SparkSession, run_id: str):
    """Jobs started inside carry the run's tag, so the run can be cancelled from outside."""
    spark.sparkContext.addJobTag(run_id)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(run_id)


def cancel(spark: SparkSession, run_id: str) -> None:
    spark.sparkContext.cancelJobsWithTag(run_id)


@dataclass
class Progress:
    """Points done so far, counted by Spark while the batches are written."""

    combo: str
    total: int
    points: int = 0
    ok: int = 0

    def observed(self, results: DataFrame, observation: Observation) -> DataFrame:
        status = (F.col("metric") == "status") & (F.col("combo") == self.combo)
        if "tsw" in results.columns:
            status &= F.col("tsw") == BULK
        fine = status & (F.col("value") == 0)
        return results.observe(observation, F.count_if(status).alias("points"), F.count_if(fine).alias("ok"))

    def add(self, observation: Observation) -> None:
        self.points += observation.get["points"]
        self.ok += observation.get["ok"]

    @property
    def percent(self) -> int:
        return round(100 * self.points / self.total) if self.total else 0


def run_validation(
    spark: SparkSession,
    run: RunConfig,
    output: str,
    batches: int = 1,
    sources: dict[int, Source] | None = None,
    own_metrics: Sequence[stats.PairMetric] = (),
) -> RunResult:
    """Executes a run and writes metrics, wide results, summary and metadata under ``output``.

    Points are processed in ``batches`` parts; parts finished by an earlier attempt with
    the same configuration are not repeated. ``own_metrics`` adds metrics to every pair.
    """
    with intermediate_results(spark):
        return _run(spark, ValidationPlan(spark, run, sources, own_metrics), output, batches)


def _run(spark: SparkSession, plan: ValidationPlan, output: str, batches: int) -> RunResult:
    run = plan.run
    plan.restricted = plan.restricted or batches > 1
    settings = run.settings() | ({"own_metrics": [str(m) for m in plan.own_metrics]} if plan.own_metrics else {})
    path = sink.batch_path(output, settings, batches)
    points = plan.reference_points()
    with tracked(spark, run.id):
        done = sink.finished_batches(spark, path)
        seen = Progress(plan.first_combo, points.count())
        for batch_id in (b for b in range(batches) if b not in done):
            part = sink.with_batch(points, batches).where(F.col("batch_id") == batch_id).drop("batch_id")
            metrics = settle(plan.metrics(settle(plan.matched(part))))
            data = plan.source(run.spatial_ref).series
            complete = res.with_missing_points(metrics, part, data, plan.first_combo)
            observation = Observation(f"batch {batch_id}")
            sink.write_batch(seen.observed(complete, observation), path, batch_id)
            seen.add(observation)
            LOG.info("batch %d of %d written to %s, %d %% of the points done", batch_id + 1, batches, path, seen.percent)
        metrics = sink.read_results(spark, path).drop("batch_id")
        sink.write_results(plan.wide(metrics, points), f"{path}/wide/{plan.output_name}")
        groups = [c for c in ("tsw", "combo", "metric") if c in metrics.columns]
        sink.write_summary_csv(res.summary(metrics.where("metric <> 'status'"), groups), f"{path}/summary")
        if done or plan.cells() is not None:
            # batches of an earlier attempt were not seen, and a point of several windows is judged by all of them
            counts = res.progress(res.count_status(metrics, plan.first_combo, points)).first().asDict()
        else:
            counts = {"total": seen.total, "ok": seen.ok, "error": seen.total - seen.ok, "progress": seen.percent}
        finished = replace(
            run,
            total_points=counts["total"],
            ok_points=counts["ok"],
            error_points=counts["error"],
            progress=counts["progress"] or 0,
        )
        sink.write_table(metadata.attributes(spark, finished), f"{path}/run_metadata")
    return RunResult(path, f"{path}/wide/{plan.output_name}", counts["total"], counts["ok"], counts["error"])
