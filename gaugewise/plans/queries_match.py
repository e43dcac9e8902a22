"""Queries over temporal matching and pairwise metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.functions import stats
from gaugewise.operators.matching import match_datasets
from gaugewise.operators.metrics import metrics_long, metrics_wide
from gaugewise.operators.ranking import with_ranks
from gaugewise.plans import canonical as c
from gaugewise.plans.queries_scan import OBS
from gaugewise.plans.registry import e6, query, r6, s6, sql_time_text, time_text

MATCHED = f"""{OBS},
cand AS (SELECT a.gpi, a.ts, a.value AS A, o.dataset, o.value AS y, o.ts AS ots,
    row_number() OVER (PARTITION BY a.gpi, a.ts, o.dataset
      ORDER BY abs(epoch_us(o.ts) - epoch_us(a.ts)), o.ts, o.value) AS k
  FROM obs a JOIN obs o ON a.gpi = o.gpi AND o.dataset IN ('N', 'R')
    AND abs(epoch_us(o.ts) - epoch_us(a.ts)) <= {c.MATCH_HALF_US}
  WHERE a.dataset = 'A'),
matched AS (SELECT gpi, ts, A, max(y) FILTER (WHERE dataset = 'N') AS N, max(y) FILTER (WHERE dataset = 'R') AS R
  FROM cand WHERE k = 1 GROUP BY gpi, ts, A HAVING count(*) = 2)"""


def matched_three(spark, d, **options):
    return match_datasets(c.observations(spark, d), "A", ["N", "R"], c.MATCH_HALF_US, unique=True, **options)


@query(
    "temporal_match_nearest",
    f"""WITH {MATCHED} SELECT gpi, {sql_time_text('ts')}, {s6('A')}, {s6('y', 'N')}, {sql_time_text('ots', 'N_ts')}
        FROM cand WHERE k = 1 AND dataset = 'N'""",
)
def temporal_match_nearest(spark, d):
    matched = match_datasets(
        c.observations(spark, d), "A", ["N"], c.MATCH_HALF_US, unique=True, keep_times=True
    )
    return matched.select("gpi", time_text(), r6("A"), r6("N"), time_text("N_ts"))


@query(
    "temporal_match_combined",
    f"WITH {MATCHED} SELECT gpi, {sql_time_text('ts')}, {s6('A')}, {s6('N')}, {s6('R')} FROM matched",
)
def temporal_match_combined(spark, d):
    return matched_three(spark, d).select("gpi", time_text(), r6("A"), r6("N"), r6("R"))


@query(
    "temporal_match_outer",
    f"""WITH {MATCHED}, best AS (SELECT * FROM cand WHERE k = 1)
        SELECT a.gpi, {sql_time_text('a.ts', 'ts')}, {s6('a.value', 'A')}, {s6('n.y', 'N')}, {s6('r.y', 'R')}
        FROM obs a LEFT JOIN best n ON a.gpi = n.gpi AND a.ts = n.ts AND n.dataset = 'N'
          LEFT JOIN best r ON a.gpi = r.gpi AND a.ts = r.ts AND r.dataset = 'R'
        WHERE a.dataset = 'A'""",
)
def temporal_match_outer(spark, d):
    """Every reference row, matched or not."""
    return matched_three(spark, d, combined=False).select("gpi", time_text(), r6("A"), r6("N"), r6("R"))


_EVENT_HALF = 6 * 3_600_000_000


@query(
    "temporal_match_irregular",
    f"""WITH cand AS (SELECT a.event_id, a.user_id AS gpi, a.ts, a.value AS x, o.value AS y,
          row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(o.ts) - epoch_us(a.ts)), o.ts, o.value) AS k
        FROM events a JOIN events o ON a.user_id = o.user_id AND o.event_type = 'click'
          AND abs(epoch_us(o.ts) - epoch_us(a.ts)) <= {_EVENT_HALF}
        WHERE a.event_type = 'view')
      SELECT gpi, {sql_time_text('ts')}, {s6('x', 'view')}, {s6('y', 'click')} FROM cand WHERE k = 1""",
)
def temporal_match_irregular(spark, d):
    """Views matched to the nearest click of the same user within 6 hours (microsecond times)."""
    matched = match_datasets(c.irregular(spark, d), "view", ["click"], _EVENT_HALF)
    return matched.select("gpi", time_text(), r6("view"), r6("click"))


@query(
    "raw_duplicates_match",
    f"""WITH cand_values AS (SELECT l_suppkey AS gpi, l_shipdate AS ts, min(l_quantity) AS value FROM lineitem
          WHERE l_returnflag = 'N' GROUP BY 1, 2),
        refs AS (SELECT l_orderkey, l_linenumber, l_suppkey AS gpi, l_shipdate AS ts, l_quantity AS value
          FROM lineitem WHERE l_returnflag = 'A'),
        cand AS (SELECT r.*, o.value AS y, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, r.gpi, r.ts,
            r.value ORDER BY abs(epoch_us(o.ts) - epoch_us(r.ts)), o.ts) AS k,
          FROM refs r JOIN cand_values o ON r.gpi = o.gpi AND abs(epoch_us(o.ts) - epoch_us(r.ts)) <= {c.MATCH_HALF_US})
        SELECT gpi, {sql_time_text('ts')}, count(*) AS n, {s6('sum(value)', 'sum_ref')}, {s6('sum(y)', 'sum_other')}
        FROM cand WHERE k = 1 GROUP BY gpi, ts""",
)
def raw_duplicates_match(spark, d):
    """Raw line items, where a location has several rows per day: every reference row is kept."""
    raw = c.table(spark, d, "lineitem").selectExpr(
        "l_returnflag AS dataset", "l_suppkey AS gpi", "l_shipdate AS ts", "l_quantity AS value"
    )
    matched = match_datasets(raw, "A", ["N"], c.MATCH_HALF_US)
    return matched.groupBy("gpi", "ts").agg(
        F.count(F.lit(1)).alias("n"), r6("sum(A)", "sum_ref"), r6("sum(N)", "sum_other")
    ).select("gpi", time_text(), "n", "sum_ref", "sum_other")


# --- pairwise metrics -------------------------------------------------------------------------


def _pair_sql(columns):
    """One row per (gpi, combo) over all matched rows; ``columns`` are SQL over x and y."""
    return f"""WITH {MATCHED}, pairs AS (SELECT gpi, ts, 'A_and_N' AS combo, A AS x, N AS y FROM matched
        UNION ALL SELECT gpi, ts, 'A_and_R', A, R FROM matched)
        SELECT gpi, combo, {columns} FROM pairs GROUP BY gpi, combo"""


SQL_R = (
    "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 "
    "THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"
)
SQL_PAIR = {
    "n_obs": "CAST(count(*) AS DOUBLE)",
    "R": SQL_R,
    "BIAS": "avg(x) - avg(y)",
    "RMSD": "sqrt(avg((x - y) * (x - y)))",
    "urmsd": "sqrt(greatest(avg((x - y) * (x - y)) - power(avg(x) - avg(y), 2), 0))",
    "mse": "avg((x - y) * (x - y))",
    "mse_corr": "2 * (stddev_pop(x) * stddev_pop(y) - covar_pop(x, y))",
    "mse_bias": "power(avg(x) - avg(y), 2)",
    "mse_var": "power(stddev_pop(x) - stddev_pop(y), 2)",
    "RSS": "sum((x - y) * (x - y))",
}


def _register_pair_query(name, metrics):
    def run(spark, d):
        wide = metrics_wide(matched_three(spark, d), "A", ["N", "R"])
        rows = ", ".join(
            f"struct('{combo}' AS combo, "
            + ", ".join(e6(stats.pair_metric(m, prefix), m) for m in metrics)
            + ")"
            for combo, prefix in (("A_and_N", "_p0_"), ("A_and_R", "_p1_"))
        )
        return wide.selectExpr("gpi", f"inline(array({rows}))")

    query(name, _pair_sql(", ".join(s6(SQL_PAIR[m], m) for m in metrics)))(run)


for _name, _metrics in [
    ("pairwise_n_obs", ["n_obs"]),
    ("pairwise_pearson", ["R"]),
    ("pairwise_bias", ["BIAS"]),
    ("pairwise_rmsd_urmsd", ["RMSD", "urmsd"]),
    ("pairwise_mse_decomp", ["mse", "mse_corr", "mse_bias", "mse_var"]),
    ("pairwise_rss", ["RSS"]),
]:
    _register_pair_query(_name, _metrics)


@query(
    "pairwise_spearman",
    f"""WITH {MATCHED}, ranked AS (SELECT gpi,
          rank() OVER (PARTITION BY gpi ORDER BY A) + (count(*) OVER (PARTITION BY gpi, A) - 1) / 2.0 AS a,
          rank() OVER (PARTITION BY gpi ORDER BY N) + (count(*) OVER (PARTITION BY gpi, N) - 1) / 2.0 AS n,
          rank() OVER (PARTITION BY gpi ORDER BY R) + (count(*) OVER (PARTITION BY gpi, R) - 1) / 2.0 AS r
        FROM matched), pairs AS (SELECT gpi, 'A_and_N' AS combo, a AS x, n AS y FROM ranked
          UNION ALL SELECT gpi, 'A_and_R', a, r FROM ranked)
        SELECT gpi, combo, {s6(SQL_R, 'rho')} FROM pairs GROUP BY gpi, combo""",
)
def pairwise_spearman(spark, d):
    ranked = with_ranks(matched_three(spark, d), ["gpi"], ["A", "N", "R"])
    rho = ranked.groupBy("gpi").agg(
        F.expr(stats.pearson("rank_A", "rank_N")).alias("_n"), F.expr(stats.pearson("rank_A", "rank_R")).alias("_r")
    )
    return rho.selectExpr(
        "gpi",
        f"inline(array(struct('A_and_N' AS combo, {e6('_n', 'rho')}), struct('A_and_R' AS combo, {e6('_r', 'rho')})))",
    )


_ALL_LONG = " UNION ALL ".join(
    f"SELECT gpi, combo, '{m}' AS metric, "
    + (f"{sql}" if m == "n_obs" else f"CASE WHEN count(*) >= {stats.MIN_OBS} THEN {sql} END")
    + " AS value FROM pairs GROUP BY gpi, combo"
    for m, sql in SQL_PAIR.items()
)


METRICS_SQL = f"""WITH {MATCHED}, pairs AS (SELECT gpi, ts, 'A_and_N' AS combo, A AS x, N AS y FROM matched
    UNION ALL SELECT gpi, ts, 'A_and_R', A, R FROM matched),
    long AS ({_ALL_LONG} UNION ALL SELECT gpi, combo, 'status',
      CASE WHEN count(*) >= {stats.MIN_OBS} THEN 0 ELSE 1 END FROM pairs GROUP BY gpi, combo)
    SELECT gpi, combo, metric, {s6('value')} FROM long"""


@query("validation_metrics", METRICS_SQL)
def validation_metrics(spark, d):
    """Flagship: three-way nearest match and every pairwise metric per location."""
    return metrics_long(matched_three(spark, d), "A", ["N", "R"]).select("gpi", "combo", "metric", r6("value"))


#: Metrics that are not among the library's own.
OWN_METRICS = (
    stats.PairMetric(
        "MAD",
        {"gap": "sum(CASE WHEN {both} THEN abs({x} - {y}) END)"},
        "{gap} / {n}",
        {"gap": "sum"},
    ),
    stats.PairMetric("NSE", {}, "CASE WHEN {sx} > 0 THEN 1 - {msd} / ({sx} * {sx}) END", {}),
    stats.PairMetric(
        "max_gap", {"top": "max(CASE WHEN {both} THEN abs({x} - {y}) END)"}, "{top}", {"top": "max"}
    ),
)
SQL_OWN = {
    "MAD": "avg(abs(x - y))",
    "NSE": "1 - sum((x - y) * (x - y)) / nullif(var_pop(x) * count(*), 0)",
    "max_gap": "max(abs(x - y))",
}


@query(
    "pairwise_custom",
    f"""WITH {MATCHED}, pairs AS (SELECT gpi, ts, 'A_and_N' AS combo, A AS x, N AS y FROM matched
        UNION ALL SELECT gpi, ts, 'A_and_R', A, R FROM matched),
        long AS ({' UNION ALL '.join(
            f"SELECT gpi, combo, '{m}' AS metric, CASE WHEN count(*) >= {stats.MIN_OBS} THEN {sql} END AS value FROM pairs GROUP BY gpi, combo"
            for m, sql in SQL_OWN.items())})
        SELECT gpi, combo, metric, {s6('value')} FROM long UNION ALL {METRICS_SQL.replace('WITH', 'SELECT * FROM (WITH', 1)})""",
)
def pairwise_custom(spark, d):
    """Metrics of the caller's beside the library's, in one aggregation."""
    metrics = metrics_long(matched_three(spark, d), "A", ["N", "R"], own=OWN_METRICS)
    return metrics.select("gpi", "combo", "metric", r6("value"))
