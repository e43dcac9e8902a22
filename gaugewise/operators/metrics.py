"""Per-location agreement metrics over matched rows: one aggregation for all pairs and triples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions import stats
from gaugewise.operators import locations, moments
from gaugewise.operators.ranking import with_ranks

#: Status of a location and sub-window.
STATUS_OK = 0
STATUS_NOT_ENOUGH_DATA = 1
STATUS_NO_MATCH = 4
STATUS_NO_DATA = 7


def pair_names(reference: str, others: Sequence[str]) -> list[tuple[str, str]]:
    """Every dataset paired with the reference."""
    return [(reference, other) for other in others]


def triple_names(reference: str, others: Sequence[str]) -> list[tuple[str, str, str]]:
    """Every triple that holds the reference."""
    return [(reference, a, b) for a, b in combinations(others, 2)]


def metrics_wide(
    matched: DataFrame,
    reference: str,
    others: Sequence[str],
    by: Sequence[str] = ("gpi",),
    triples: bool = False,
    ranked: bool = False,
    own: Sequence[stats.PairMetric] = (),
) -> DataFrame:
    """Moments of all pairs (and triples) of every location in a single aggregation.

    ``ranked`` says that ``rank_<dataset>`` columns are present for the rank correlation.
    """
    aggregates = []
    for i, names in enumerate(pair_names(reference, others)):
        aggregates += stats.pair_moments(*map(_quoted, names), prefix=f"_p{i}_")
        if ranked:
            x, y = (_quoted(f"rank_{name}") for name in names)
            aggregates.append(f"{stats.pearson(x, y)} AS _p{i}_rho")
        for metric in own:
            aggregates += metric.aggregates(*map(_quoted, names), prefix=f"_p{i}_")
    if triples:
        for i, names in enumerate(triple_names(reference, others)):
            aggregates += stats.triple_moments(*map(_quoted, names), prefix=f"_t{i}_")
    return matched.groupBy(*by).agg(*map(F.expr, aggregates))


def metrics_long(
    matched: DataFrame,
    reference: str,
    others: Sequence[str],
    by: Sequence[str] = ("gpi",),
    triples: bool = False,
    min_obs: int = stats.MIN_OBS,
    pair_metrics: Sequence[str] = stats.PAIR_METRICS,
    rank_correlation: bool = False,
    own: Sequence[stats.PairMetric] = (),
) -> DataFrame:
    """Tidy metrics: ``by``, ``combo`` (datasets joined by ``_and_``), ``metric``, ``value``.

    ``own`` adds metrics of the caller's to every pair.

    Metrics of a location with fewer than ``min_obs`` matches are NULL; its ``n_obs`` and
    ``status`` are always present.
    """
    if rank_correlation:
        matched = with_ranks(matched, by, [reference, *others])
    wide = metrics_wide(matched, reference, others, by, triples, ranked=rank_correlation, own=own)
    return _tidy(wide, reference, others, by, triples, min_obs, pair_metrics, rank_correlation, own)


def _tidy(wide, reference, others, by, triples, min_obs, pair_metrics, rank_correlation=False, own=()) -> DataFrame:
    """One row for each metric of the moments that ``metrics_wide`` names."""
    entries = []

    def add(combo, metric, value, n=None):
        guarded = value if n is None else f"CASE WHEN {n} >= {min_obs} THEN {value} END"
        entries.append(f"struct('{combo}' AS combo, '{metric}' AS metric, {guarded} AS value)")

    def add_status(combo, n):
        add(combo, "status", f"CASE WHEN {n} >= {min_obs} THEN {STATUS_OK}D ELSE {STATUS_NOT_ENOUGH_DATA}D END")

    for i, names in enumerate(pair_names(reference, others)):
        combo, n = "_and_".join(names), f"_p{i}_n"
        for metric in pair_metrics:
            add(combo, metric, stats.pair_metric(metric, f"_p{i}_"), n=None if metric == "n_obs" else n)
        if rank_correlation:
            add(combo, "rho", f"_p{i}_rho", n)
        for metric in own:
            add(combo, metric.name, metric.expression(f"_p{i}_"), n)
        add_status(combo, n)
    if triples:
        for i, names in enumerate(triple_names(reference, others)):
            combo, n = "_and_".join(names), f"_t{i}_n"
            for metric in stats.TRIPLE_METRICS:
                for side, dataset in zip(stats.TRIPLE_SIDES, names):
                    add(combo, f"{metric}_{dataset}", stats.triple_metric(metric, side, f"_t{i}_"), n)
            add_status(combo, n)
    return wide.selectExpr(*map(_quoted, by), f"inline(array({', '.join(entries)}))")


def moment_groups(reference: str, others: Sequence[str], triples: bool = False) -> dict[str, tuple[str, ...]]:
    """The pairs and triples under the prefixes that their moments carry."""
    groups = {f"_p{i}_": names for i, names in enumerate(pair_names(reference, others))}
    if triples:
        groups |= {f"_t{i}_": names for i, names in enumerate(triple_names(reference, others))}
    return groups


def metrics_of_moments(
    merged: DataFrame,
    reference: str,
    others: Sequence[str],
    by: Sequence[str],
    triples: bool = False,
    min_obs: int = stats.MIN_OBS,
    pair_metrics: Sequence[str] = stats.PAIR_METRICS,
    own: Sequence[stats.PairMetric] = (),
) -> DataFrame:
    """Tidy metrics as of ``metrics_long``, from merged moments of ``moment_groups``."""
    columns = []
    for prefix, names in moment_groups(reference, others, triples).items():
        columns += moments.pair_columns(prefix) if len(names) == 2 else moments.triple_columns(prefix)
    columns += [c for i in range(len(others)) for metric in own for c in metric.columns(f"_p{i}_")]
    wide = merged.selectExpr(*map(_quoted, by), *columns)
    return _tidy(wide, reference, others, by, triples, min_obs, pair_metrics, own=own)


def window_metrics(
    matched: DataFrame,
    reference: str,
    others: Sequence[str],
    cells: moments.Cells,
    by: Sequence[str] = ("gpi",),
    triples: bool = False,
    min_obs: int = stats.MIN_OBS,
    pair_metrics: Sequence[str] = stats.PAIR_METRICS,
    own: Sequence[stats.PairMetric] = (),
) -> DataFrame:
    """Tidy metrics of every temporal sub-window (``tsw``), from one aggregation of the matched rows."""
    groups = moment_groups(reference, others, triples)
    more, merges = [], []
    for i, names in enumerate(pair_names(reference, others)):
        for metric in own:
            more += metric.aggregates(*map(_quoted, names), prefix=f"_p{i}_")
            merges += metric.merges(f"_p{i}_")
    in_cells = moments.cell_moments(matched, groups, cells, by, more)
    merged = moments.window_moments(in_cells, groups, cells, by, merges)
    return metrics_of_moments(merged, reference, others, [*by, "tsw"], triples, min_obs, pair_metrics, own)


def rank_correlations(
    matched: DataFrame,
    reference: str,
    others: Sequence[str],
    cells: moments.Cells,
    by: Sequence[str] = ("gpi",),
    min_obs: int = stats.MIN_OBS,
) -> DataFrame:
    """Tidy ``rho`` of every pair and temporal sub-window (``tsw``).

    Ranks do not merge. A location's rows are ranked in every window where they lie together, once for windows that
    hold the same cells; only the rows of hot locations are copied into their windows.
    """
    names = [reference, *others]
    pairs = pair_names(reference, others)
    gathered, hot = locations.by_location(matched, by[0])
    keys = [_quoted(k) for k in by]
    ordered = gathered.selectExpr(
        *keys, *(f"CAST({_quoted(name)} AS DOUBLE) AS _v{i}" for i, name in enumerate(names)), f"{cells.cell} AS _cell"
    ).sortWithinPartitions(*by, "_cell")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*by).schema)
    columns = "".join(f", _n{i} bigint, _rho{i} double" for i in range(len(pairs)))
    wide = ordered.mapInArrow(_rank_task(list(by), len(names), cells), f"{schema}, _tsw array<string>{columns}")
    wide = wide.withColumn("tsw", F.explode("_tsw")).drop("_tsw")
    if hot is not None:
        spread = hot.withColumn("_cell", F.expr(cells.cell)).withColumn("tsw", F.explode(F.expr(cells.windows)))
        # one key, as ranks are joined to their rows: inside a struct nulls are equal
        spread = spread.withColumn("_group", F.struct(*by, "tsw"))
        ranked = with_ranks(spread.select("_group", *map(_quoted, names)), ["_group"], names)
        aggregates = []
        for i, pair in enumerate(pairs):
            x, y = (_quoted(f"rank_{name}") for name in pair)
            both = " AND ".join(f"{_quoted(name)} IS NOT NULL" for name in pair)
            aggregates += [f"count(CASE WHEN {both} THEN 1 END) AS _n{i}", f"{stats.pearson(x, y)} AS _rho{i}"]
        wide = wide.unionByName(ranked.groupBy("_group").agg(*map(F.expr, aggregates)).select("_group.*", "*").drop("_group"))
    entries = [
        f"struct('{'_and_'.join(pair)}' AS combo, 'rho' AS metric, CASE WHEN _n{i} >= {min_obs} THEN _rho{i} END AS value)"
        for i, pair in enumerate(pairs)
    ]
    return wide.selectExpr(*keys, "tsw", f"inline(array({', '.join(entries)}))")


def _rank_task(
    by: list[str], width: int, cells: moments.Cells
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for table, starts in locations.whole_groups(batches, by):
            runs, firsts, present = locations.segments(table, starts)
            values, known = zip(*(locations.doubles(table.column(f"_v{i}")) for i in range(width)))
            groups, labels, found = [], [], []
            for g, (first, last) in enumerate(zip(firsts, [*firsts[1:], len(runs)])):
                begin, end = runs[first], runs[last] if last < len(runs) else table.num_rows
                codes = [_codes(v[begin:end], k[begin:end]) for v, k in zip(values, known)]
                cell = np.repeat(np.arange(last - first), np.diff([*runs[first:last], end]))
                for names, numbers in locations.shared_windows(present[first:last], cells):
                    inside = np.isin(cell, numbers)
                    groups.append(g)
                    labels.append(names)
                    found.append(_rhos([code[inside] for code in codes]))
            if not groups:
                continue
            n, rho = np.array(found).transpose(2, 1, 0)  # each (pair, window)
            yield pa.RecordBatch.from_arrays(
                [
                    *(table.column(c).combine_chunks().take(pa.array(starts[groups])) for c in by),
                    pa.array(labels, pa.list_(pa.string())),
                    *(a for k, r in zip(n, rho) for a in (pa.array(k.astype(np.int64)), pa.array(r, mask=np.isnan(r)))),
                ],
                names=[*by, "_tsw", *(f"_{c}{i}" for i in range(width - 1) for c in ("n", "rho"))],
            )

    return run


def _codes(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of values among the distinct ones, NaN after all others; -1 for none."""
    return np.where(known, np.unique(values, return_inverse=True)[1], -1)


def _rhos(codes: list[np.ndarray]) -> list[tuple[int, float]]:
    """Rows and rank correlation (NaN for NULL) of the first series with each other one."""
    ranks = []
    for code in codes:
        counts = np.bincount(code[code >= 0], minlength=1)
        average = np.cumsum(counts) - counts + (counts + 1) / 2
        ranks.append(np.where(code >= 0, average[code], np.nan))
    out = []
    x = ranks[0]
    for y in ranks[1:]:
        both = ~(np.isnan(x) | np.isnan(y))
        spread = _spread(x) * _spread(y)
        n = np.count_nonzero(both)
        a, b = x[both], y[both]
        out.append((n, ((a - a.mean()) * (b - b.mean())).mean() / spread if n and spread > 0 else np.nan))
    return out


def _spread(ranks: np.ndarray) -> float:
    some = ranks[~np.isnan(ranks)]
    return float(some.std()) if len(some) else 0.0


def _quoted(name: str) -> str:
    return f"`{name}`"
