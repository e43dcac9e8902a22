"""Operators against brute force on small inputs, with and without hot groups."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewise.functions import stats
from gaugewise.operators.bootstrap import block_hash, poisson_weight, triple_intervals
from gaugewise.operators.matching import match_datasets, match_nearest
from gaugewise.operators.metrics import metrics_long
from gaugewise.operators.moments import recurring_cells, yearly_cells
from gaugewise.operators.ranking import cumulative_counts, percentiles, with_ranks
from gaugewise.operators.scaling import scale
from gaugewise.operators.series import climatology_anomaly, extend, moving_mean
from gaugewise.operators.skew import attach
from gaugewise.operators.spatial import nearest
from gaugewise.operators.stability import theil_sen
from gaugewise.operators.subwindows import SEASONS, label_recurring
from gaugewise.operators.upscaling import lookup_table

EPOCH = datetime(2000, 1, 1)
HOUR = 3_600_000_000


def series(spark, rows):
    """rows of (gpi, hours since EPOCH, value)."""
    data = [(g, EPOCH + timedelta(hours=h), v) for g, h, v in rows]
    return spark.createDataFrame(data, "gpi bigint, ts timestamp_ntz, value double")


def random_rows(seed, n=300, hot_share=0.6, span=2000):
    """One location holds most of the rows."""
    rng = np.random.default_rng(seed)
    gpis = np.where(rng.random(n) < hot_share, 0, rng.integers(1, 6, n))
    return [(int(g), float(h), float(v)) for g, h, v in zip(gpis, rng.integers(0, span, n), np.round(rng.normal(10, 3, n), 1))]


@pytest.mark.parametrize("tile_hours", [None, 13, 50, 100000])
def test_matching_against_all_pairs(spark, tile_hours):
    ref, other = random_rows(1), random_rows(2)
    half = 5
    best = {}
    for g, h, v in other:
        best[(g, h)] = min(v, best.get((g, h), v))
    expected = []
    for g, h, v in ref:
        near = sorted((abs(oh - h), oh, ov) for (og, oh), ov in best.items() if og == g and abs(oh - h) <= half)
        if near:
            expected.append((g, h, v, near[0][2]))
    matched = match_nearest(
        series(spark, ref), {"other": series(spark, other)}, half * HOUR, tile_us=tile_hours and tile_hours * HOUR
    )
    got = [(r.gpi, (r.ts - EPOCH).total_seconds() / 3600, r.ref, r.other) for r in matched.collect()]
    assert sorted(got) == sorted(expected)


def test_matching_hot_reference_times(spark, crowded):
    rng = np.random.default_rng(12)
    ref = [(0, 5.0, float(v)) for v in rng.integers(0, 3, 200)] + random_rows(13, n=100)
    other = random_rows(14) + [(0, 6.0, 1.5)]
    plain = match_nearest(series(spark, ref), {"o": series(spark, other)}, 5 * HOUR, unique=True)
    hot = match_nearest(series(spark, ref), {"o": series(spark, other)}, 5 * HOUR)
    assert "_chunk" in hot._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for g, h, v in other:
        best[(g, h)] = min(v, best.get((g, h), v))
    expected = []
    for g, h, v in ref:
        near = sorted((abs(oh - h), oh, ov) for (og, oh), ov in best.items() if og == g and abs(oh - h) <= 5)
        if near:
            expected.append((g, h, v, near[0][2]))
    got = [(r.gpi, (r.ts - EPOCH).total_seconds() / 3600, r.ref, r.o) for r in hot.collect()]
    assert sorted(got) == sorted(expected) and plain.columns == hot.columns


def test_matching_before_the_epoch_and_ties(spark):
    ref = series(spark, [(1, -400000.0, 1.0), (1, 0.0, 2.0)])
    other = series(spark, [(1, -400001.0, 5.0), (1, -399999.0, 6.0), (1, 2.0, 7.0), (1, 2.001, 8.0)])
    rows = match_nearest(ref, {"o": other}, 2 * HOUR).orderBy("ts").collect()
    assert [r.o for r in rows] == [5.0, 7.0]
    assert match_nearest(ref, {"o": other.limit(0)}, 2 * HOUR).count() == 0
    kept = match_nearest(ref, {"o": other.limit(0)}, 2 * HOUR, combined=False).collect()
    assert [r.o for r in kept] == [None, None]


def test_matching_is_one_exchange(spark, sf_dir):
    from gaugewise.plans.canonical import observations

    plan = match_datasets(observations(spark, sf_dir), "A", ["N", "R"], HOUR, unique=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_constant_series_has_no_correlation(spark):
    rows = spark.createDataFrame([(1, float(i), 5.0) for i in range(20)], "gpi int, a double, b double")
    values = {r.metric: r.value for r in metrics_long(rows, "a", ["b"]).collect()}
    assert values["R"] is None and values["n_obs"] == 20 and values["BIAS"] == pytest.approx(4.5)


def test_metrics_against_numpy_and_parts_of_mse(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(5, 2, 200), rng.normal(4, 1, 200)
    rows = spark.createDataFrame(pd.DataFrame({"gpi": 1, "a": x, "b": y}))
    m = {r.metric: r.value for r in metrics_long(rows, "a", ["b"]).collect()}
    assert m["R"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert m["RMSD"] == pytest.approx(np.sqrt(np.mean((x - y) ** 2)))
    assert m["urmsd"] == pytest.approx(np.std(x - y))
    assert m["RSS"] == pytest.approx(np.sum((x - y) ** 2))
    assert m["mse"] == pytest.approx(m["mse_corr"] + m["mse_bias"] + m["mse_var"])


def test_too_few_observations(spark):
    rows = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(5)], "gpi int, a double, b double")
    m = {r.metric: r.value for r in metrics_long(rows, "a", ["b"]).collect()}
    assert m["R"] is None and m["n_obs"] == 5 and m["status"] == 1


def test_triple_collocation_recovers_known_errors(spark):
    rng = np.random.default_rng(4)
    n = 20000
    s = rng.normal(0, 3, n)
    frame = pd.DataFrame(
        {"gpi": 1, "x": s + rng.normal(0, 1, n), "y": 0.5 * s + rng.normal(0, 0.5, n), "z": 2 * s + rng.normal(0, 4, n)}
    )
    m = {r.metric: r.value for r in metrics_long(spark.createDataFrame(frame), "x", ["y", "z"], triples=True).collect()}
    assert m["beta_y"] == pytest.approx(2, rel=0.05) and m["beta_z"] == pytest.approx(0.5, rel=0.05)
    assert m["err_std_x"] == pytest.approx(1, rel=0.05) and m["err_std_z"] == pytest.approx(2, rel=0.05)
    assert m["snr_x"] == pytest.approx(10 * np.log10(9), rel=0.05)


def test_hot_keys_are_salted(spark, crowded):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k int, i int")
    stats_rows = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    joined = attach(rows, stats_rows, ["k"])
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text
    got = {(r.k, r.i, r.m) for r in joined.collect()}
    top = {r.k: r.m for r in stats_rows.collect()}
    assert got == {(r.k, r.i, top[r.k]) for r in rows.collect()}


def test_copies_of_a_row_are_spread_and_kept(spark, crowded, monkeypatch):
    from gaugewise.operators import skew

    monkeypatch.setattr(skew, "CHUNK", 7)
    rows = spark.createDataFrame([(0, 1.0)] * 100 + [(1, 2.0), (1, 2.0), (2, 3.0)], "k int, v double")
    two_rows_per_key = spark.createDataFrame(
        [(0, "a", 100), (0, "b", 100), (1, "c", 2), (2, "d", 1)], "k int, s string, n long"
    )
    counts = {(r.k, r.s): r["count"] for r in attach(rows, two_rows_per_key, ["k"]).groupBy("k", "s").count().collect()}
    assert counts == {(0, "a"): 100, (0, "b"): 100, (1, "c"): 2, (2, "d"): 1}


def _check_percentiles(spark):
    rows = pd.DataFrame(random_rows(5, n=2000), columns=["gpi", "h", "value"])
    table = percentiles(spark.createDataFrame(rows), ["gpi"], "value", {"lo": 0.05, "mid": 0.5, "hi": 1.0}, mean="mean")
    for r in table.collect():
        values = rows.value[rows.gpi == r.gpi]
        assert r.n == len(values) and r["mean"] == pytest.approx(values.mean())
        assert (r.lo, r.mid, r.hi) == pytest.approx(tuple(np.percentile(values, [5, 50, 100])))


def test_percentiles(spark):
    _check_percentiles(spark)


def test_percentiles_of_hot_groups(spark, crowded):
    _check_percentiles(spark)


def _check_ranks(spark):
    rows = pd.DataFrame(random_rows(6, n=800), columns=["gpi", "h", "value"])
    rows["other"] = rows.value.sample(frac=1, random_state=1).values
    got = with_ranks(spark.createDataFrame(rows), ["gpi"], ["value", "other"]).toPandas()
    assert len(got) == len(rows)
    for column in ("value", "other"):
        expected = rows.groupby("gpi")[column].rank()
        merged = sorted(zip(rows.gpi, rows[column], expected))
        assert sorted(zip(got.gpi, got[column], got[f"rank_{column}"])) == merged


def test_ranks(spark):
    _check_ranks(spark)


def test_ranks_of_hot_groups(spark, crowded):
    _check_ranks(spark)


def test_cumulative_counts_cut_a_hot_group(spark, crowded):
    rows = spark.createDataFrame([(0, float(v)) for v in range(5000)] + [(1, 1.0)], "k int, v double")
    counted = cumulative_counts(rows.withColumnRenamed("v", "value"), ["k"], "value")
    assert "_tile" in counted._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.below == r.v and r.total == 5000 for r in counted.where("k = 0").collect())


@pytest.mark.parametrize("unique", [True, False])
def test_moving_mean(spark, unique):
    rows = random_rows(7, n=400)
    if unique:
        rows = list({(g, h): (g, h, v) for g, h, v in rows}.values())
    got = moving_mean(series(spark, rows), 4, unique=unique, tile_us=60 * HOUR).collect()
    assert len(got) == len(rows)
    for r in got:
        at = (r.ts - EPOCH).total_seconds() / 3600
        near = [v for g, h, v in rows if g == r.gpi and abs(h - at) <= 48]
        assert r["mean"] == pytest.approx(np.mean(near))


@pytest.mark.parametrize("unique", [True, False])
def test_moving_mean_in_a_crowded_tile(spark, crowded, unique):
    rng = np.random.default_rng(17)
    rows = [(0, 3000 + float(h) / 1000, 1e6 + float(h % 89)) for h in rng.choice(50_000, 900, replace=False)]
    rows += [(g, h, v) for g, h, v in random_rows(18, n=150)] + ([] if unique else rows[:5] * 3)
    if unique:
        rows = list({(g, h): (g, h, v) for g, h, v in rows}.values())
    averaged = moving_mean(series(spark, rows), 4, unique=unique, tile_us=400 * HOUR)
    assert "_sub" in averaged._jdf.queryExecution().analyzed().toString()
    got = averaged.collect()
    assert len(got) == len(rows)
    for r in got:
        at = (r.ts - EPOCH).total_seconds() / 3600
        near = [v for g, h, v in rows if g == r.gpi and abs(h - at) <= 48 + 1e-9]
        assert r["mean"] == pytest.approx(np.mean(near), abs=1e-6)


def _check_climatology(spark):
    rows = [(g, h * 24, v) for g, h, v in random_rows(8, n=600, span=1000)]
    got = climatology_anomaly(series(spark, rows), "2000-01-01", "2001-12-31").collect()
    frame = pd.DataFrame(rows, columns=["gpi", "h", "value"])
    frame["ts"] = [EPOCH + timedelta(hours=h) for h in frame.h]
    frame["doy"] = [t.timetuple().tm_yday for t in frame.ts]
    base = frame[(frame.ts <= datetime(2001, 12, 31))].groupby(["gpi", "doy"]).value.mean()
    expected = sorted(
        (g, t, round(v - base[(g, d)], 6) if (g, d) in base.index else None)
        for g, t, v, d in zip(frame.gpi, frame.ts, frame.value, frame.doy)
        if (g, d) in base.index
    )
    assert sorted((r.gpi, r.ts, round(r.value, 6)) for r in got if r.value is not None) == expected
    assert len(got) == len(rows)


def test_climatology(spark):
    _check_climatology(spark)


def test_climatology_with_hot_days(spark, crowded):
    _check_climatology(spark)


def test_extension_wins(spark):
    base, newer = series(spark, [(1, 0.0, 1.0), (1, 1.0, 2.0)]), series(spark, [(1, 1.0, 9.0), (1, 2.0, 3.0)])
    assert [r.value for r in extend(base, newer).orderBy("ts").collect()] == [1.0, 9.0, 3.0]
    assert extend(base, None) is base


def _scaled(spark, method, x, y):
    rows = spark.createDataFrame(pd.DataFrame({"gpi": 1, "i": range(len(x)), "x": x, "y": y}))
    return scale(rows, method, "x", ["y"]).orderBy("i").toPandas().y.to_numpy(dtype=float)


@pytest.mark.parametrize("hot", [False, True])
def test_scaling(spark, hot, request):
    if hot:
        request.getfixturevalue("crowded")
    rng = np.random.default_rng(9)
    x, y = rng.normal(5, 2, 500), rng.gamma(2, 3, 500)
    assert _scaled(spark, "mean_std", x, y) == pytest.approx((y - y.mean()) / y.std() * x.std() + x.mean())
    assert _scaled(spark, "min_max", x, y) == pytest.approx(
        (y - y.min()) / (y.max() - y.min()) * (x.max() - x.min()) + x.min()
    )
    slope, intercept = np.polyfit(y, x, 1)
    assert _scaled(spark, "linreg", x, y) == pytest.approx(intercept + slope * y)
    marks = [0, 5, 10, 30, 50, 70, 90, 95, 100]
    expected = np.interp(y, np.percentile(y, marks), np.percentile(x, marks))
    assert _scaled(spark, "cdf_match", x, y) == pytest.approx(expected)
    assert _scaled(spark, "cdf_beta_match", x, y) == pytest.approx(expected)
    with pytest.raises(ValueError):
        _scaled(spark, "magic", x, y)


def test_scaling_without_spread(spark):
    assert np.isnan(_scaled(spark, "mean_std", [1.0, 2.0], [3.0, 3.0])).all()


def test_beta_scaling_of_repeated_percentiles(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(5, 2, 400)
    y = np.where(rng.random(400) < 0.5, 0.0, rng.random(400))
    scaled = _scaled(spark, "cdf_beta_match", x, y)
    assert np.isfinite(scaled).all() and scaled.min() >= x.min() - 1e-9 and scaled.max() <= x.max() + 1e-9
    order = np.argsort(y)
    assert (np.diff(scaled[order]) >= -1e-9).all()


def beta_slowly(points):
    """The fit by a plain midpoint sum over a very fine grid, in steps that keep singular ends integrable."""
    from gaugewise.functions.beta import PROBABILITIES

    p, q = np.array(PROBABILITIES), np.array(points, float)
    unit, width = (q - q[0]) / (q[-1] - q[0]), np.diff(PROBABILITIES)
    mean = np.sum(width * (unit[:-1] + unit[1:]) / 2)
    square = np.sum(width * (unit[:-1] ** 2 + unit[:-1] * unit[1:] + unit[1:] ** 2) / 3)
    strength = mean * (1 - mean) / (square - mean**2) - 1
    a, b = mean * strength, (1 - mean) * strength
    u = (np.arange(4_000_000) + 0.5) / 4_000_000
    x = u**3 * (10 - 15 * u + 6 * u**2)  # the ends are approached slowly
    one_less = (1 - u) ** 3 * (10 - 15 * (1 - u) + 6 * (1 - u) ** 2)
    density = x ** (a - 1) * one_less ** (b - 1) * 30 * u**2 * (1 - u) ** 2
    total = np.concatenate([[0], np.cumsum(density)])
    edges = np.arange(4_000_001) / 4_000_000
    v = np.interp(p, total / total[-1], edges)
    return q[0] + v**3 * (10 - 15 * v + 6 * v**2) * (q[-1] - q[0]), (a, b)


@pytest.mark.parametrize(
    "points",
    [
        [1, 1, 1, 2, 2, 3, 5, 5, 9],  # skewed
        [0, 0, 0, 2, 5, 8, 10, 10, 10],  # both ends crowded: alpha and beta below 1
        [0, 4.8, 4.9, 5, 5, 5, 5.1, 5.2, 10],  # narrow
        [-3, -3, -2, -1, 0, 0, 1, 2, 2],
    ],
)
def test_beta_percentiles_by_fine_sums(spark, points):
    from gaugewise.functions.beta import distinct_percentiles

    frame = spark.createDataFrame([(1, [float(v) for v in points])], "k int, points array<double>")
    wanted, (a, b) = beta_slowly(points)
    got = distinct_percentiles(frame, "points").first().points
    assert a > 0.2 and b > 0.2 and got == pytest.approx(wanted, abs=2e-6)
    assert all(later > earlier for earlier, later in zip(got, got[1:]))


def test_beta_leaves_other_percentiles_alone(spark):
    from gaugewise.functions.beta import distinct_percentiles

    rows = {1: [float(v) for v in range(9)], 2: [5.0] * 9, 3: [1.0, None, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 4: None,
            5: [float("nan")] * 9, 6: [0.0] * 4 + [1.0] * 5}
    frame = spark.createDataFrame(list(rows.items()), "k int, points array<double>")
    got = {r.k: r.points for r in distinct_percentiles(frame, "points").collect()}
    assert got[1] == rows[1] and got[2] == rows[2] and got[3] == rows[3] and got[4] is None
    assert all(np.isnan(got[5])) and len(got[6]) == 9
    plan = distinct_percentiles(frame, "points")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_yearly_slope(spark):
    rows = [(1, y, 0.1 * (y - 2000)) for y in (2000, 2001, 2002)] + [(2, 2000, 5.0), (3, 2000, None)]
    got = {r.k: r.slope for r in theil_sen(spark.createDataFrame(rows, "k int, year int, value double"), ["k"]).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None and 3 not in got


def test_seasons_over_the_turn_of_the_year(spark):
    days = ["1999-12-01", "2000-02-29", "2000-03-01", "2001-02-28", "2001-11-30"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("d", "CAST(d AS timestamp_ntz) AS ts")
    got = {r.d: set() for r in rows.collect()}
    for r in label_recurring(rows, SEASONS).collect():
        got[r.d].add(r.tsw)
    assert got == {
        "1999-12-01": {"S1", "bulk"},
        "2000-02-29": {"S1", "bulk"},
        "2000-03-01": {"S2", "bulk"},
        "2001-02-28": {"S1", "bulk"},
        "2001-11-30": {"S4", "bulk"},
    }
    with pytest.raises(ValueError):
        label_recurring(rows, SEASONS, overlap=186)


def _great_circle(a, b):
    la, lb = np.radians(a[1]), np.radians(b[1])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(min(1, h)))


@pytest.mark.parametrize("leaf, max_dist", [(64, None), (1, None), (2, 800_000)])
def test_nearest_point(spark, monkeypatch, leaf, max_dist):
    from gaugewise.operators import spatial

    monkeypatch.setattr(spatial, "LEAF_SIZE", leaf)
    rng = np.random.default_rng(11)
    # a crowded cluster, the poles, the antimeridian, corners of the octree and exact copies
    places = [(float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for _ in range(60)]
    places += [(10 + float(rng.normal(0, 0.01)), 50 + float(rng.normal(0, 0.01))) for _ in range(60)]
    places += [(0.0, 90.0), (0.0, -90.0), (180.0, 0.0), (-180.0, 0.0), (0.0, 0.0), (90.0, 0.0), (0.0, 0.0)]
    asks = [(float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for _ in range(40)]
    asks += [(179.9, 1.0), (-179.9, -1.0), (77.0, 89.9), (10.0, 50.0), (0.0, 0.0)]
    schema = "gpi bigint, lon double, lat double"
    hits = nearest(
        spark.createDataFrame([(i, *p) for i, p in enumerate(asks)], schema),
        spark.createDataFrame([(i, *p) for i, p in enumerate(places)], schema),
        max_dist,
    )
    got = {r.gpi: (r.other_gpi, r.distance_m) for r in hits.collect()}
    for i, ask in enumerate(asks):
        distance, best = min((round(_great_circle(ask, p), 3), j) for j, p in enumerate(places))
        if max_dist is not None and distance > max_dist:
            assert i not in got
        else:
            assert got[i][1] == pytest.approx(distance, abs=0.002)
            assert _great_circle(ask, places[got[i][0]]) == pytest.approx(distance, abs=0.002)


def test_nearest_point_with_crowded_cells(spark, crowded, monkeypatch):
    from gaugewise.operators import spatial

    monkeypatch.setattr(spatial, "BROADCAST_LEVEL", 0)
    test_nearest_point(spark, monkeypatch, 4, None)


def nearest_slowly(ref, others, half):
    expected = []
    for g, h, v in ref:
        values = []
        for other in others:
            near = sorted((abs(oh - h), oh, ov) for og, oh, ov in other if og == g and abs(oh - h) <= half)
            values.append(near[0][2] if near else None)
        expected.append((g, h, v, *values))
    return expected


@pytest.mark.parametrize("dense", ["candidates", "references", "both"])
@pytest.mark.parametrize("unique", [True, False])
def test_matching_in_a_crowded_tile(spark, crowded, dense, unique):
    """Nine tenths of all rows within one tile of one location; the other series is sparse there."""
    rng = np.random.default_rng(21)

    def around(n):
        hours = rng.choice(200_000, n, replace=False)
        return [(0, 5000 + float(h) / 100_000, float(h % 97)) for h in hours]

    def anywhere(n, places):
        return [(int(g), float(h), float(h % 31)) for g, h in {(g % places, h) for g, h in rng.integers(0, 20_000, (n, 2))}]

    ref = (around(900) if dense != "candidates" else around(3)) + anywhere(60, 4)
    one = (around(900) if dense != "references" else around(2)) + anywhere(60, 4)
    two = anywhere(50, 4)
    half = 400
    matched = match_nearest(
        series(spark, ref), {"a": series(spark, one), "b": series(spark, two)}, half * HOUR, unique=unique, combined=False
    )
    assert "_sub" in matched._jdf.queryExecution().analyzed().toString()
    got = [(r.gpi, (r.ts - EPOCH).total_seconds() / 3600, r.ref, r.a, r.b) for r in matched.collect()]
    rounded = [(g, round(h, 6), *rest) for g, h, *rest in got]
    assert sorted(rounded, key=str) == sorted(((g, round(h, 6), *rest) for g, h, *rest in nearest_slowly(ref, [one, two], half)), key=str)


def test_crowded_tile_is_cut_evenly(spark, crowded):
    from gaugewise.operators.skew import crowding, cut_ranges

    rows = spark.createDataFrame([(0, i * i) for i in range(5000)] + [(k, k) for k in range(1, 500)], "k int, v long")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    pieces = [r["count"] for r in cut_ranges(rows, ["k"], "v", sizes, crowding(sizes)).groupBy("k", "_sub").count().collect()]
    assert sum(pieces) == 5499 and max(pieces) <= 2 * 5499 / 256 and len(pieces) > 600


def test_lookup_table_is_long(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "gpi bigint, lon double, lat double")
    sensors = spark.createDataFrame([(i, float(i), 1.0) for i in range(80)], "gpi bigint, lon double, lat double")
    rows = lookup_table(grid, sensors).collect()
    assert len(rows) == 80 and {r.ref_gpi for r in rows if r.gpi < 45} == {1} and {r.ref_gpi for r in rows if r.gpi > 45} == {2}


def test_bootstrap_weights_look_like_independent_poisson(spark):
    """Mean, variance and zeros of the weights; no correlation between replicates or neighbouring times."""
    draws = spark.range(40_000).selectExpr("id % 7 AS gpi", "id AS t").withColumn(
        "h", F.array(*[F.expr(block_hash("gpi", "t", str(b))) for b in (0, 1)])
    )
    draws = draws.selectExpr(
        "t", *[f"{poisson_weight(f'substring(h[{r // 8}], {r % 8 * 4 + 1}, 4)')} AS w{r}" for r in (0, 1, 7, 8, 15)]
    ).toPandas().sort_values("t")
    weights = draws.drop(columns="t").to_numpy(float)
    assert weights.mean(0) == pytest.approx(1, abs=0.03) and weights.var(0) == pytest.approx(1, abs=0.05)
    assert (weights == 0).mean(0) == pytest.approx(np.exp(-1), abs=0.015)
    assert np.abs(np.corrcoef(weights.T) - np.eye(5)).max() < 0.03
    assert abs(np.corrcoef(weights[:-1, 0], weights[1:, 0])[0, 1]) < 0.03


def _triple_rows(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for g, h in sorted({(int(g), int(h)) for g, h in zip(np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n)), rng.integers(0, 20_000, n))}):
        s = rng.normal(20, 5)
        x, y, z = (float(v) for v in (s + rng.normal(), 0.8 * s + rng.normal(), 1.1 * s + rng.normal()))
        rows.append((g, EPOCH + timedelta(hours=h), x, y, z))
    return spark.createDataFrame(rows, "gpi bigint, ts timestamp_ntz, x double, y double, z double")


@pytest.mark.parametrize("hot", [False, True])
def test_intervals_of_windows_merge_from_cells(spark, monkeypatch, hot):
    """The same intervals as over rows copied into their windows, also with a location that holds half of all rows."""
    rows, names = _triple_rows(spark), ["x", "y", "z"]
    labelled = label_recurring(rows, SEASONS, 20)
    wanted = {tuple(r)[:4]: tuple(r)[4:] for r in triple_intervals(labelled, names, by=["gpi", "tsw"]).collect()}
    if hot:
        from gaugewise.operators import skew

        monkeypatch.setattr(skew, "FLOOR", 0)
        monkeypatch.setattr(skew, "PARTS", 4)
    found = triple_intervals(rows, names, cells=recurring_cells(SEASONS, 20))
    assert found.columns == ["gpi", "tsw", "metric", "dataset", "lower", "upper"]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()}
    assert got.keys() == wanted.keys() and len(got) == 6 * 5 * 9
    assert any(low is not None for low, _ in got.values())
    for key, bounds in wanted.items():
        assert got[key] == (pytest.approx(bounds, rel=1e-9, abs=1e-9) if None not in bounds else bounds), key


def test_bootstrap_sums_do_not_travel(spark):
    """Rows travel by location, once; sums of replicates, far wider than the rows, stay where they are."""
    rows, names = _triple_rows(spark), ["x", "y", "z"]
    for cells in (None, recurring_cells(SEASONS)):
        plan = triple_intervals(rows, names, cells=cells)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(gpi") == 1 and plan.count("Exchange") == 1


def test_gathered_intervals_draw_and_evaluate_as_the_aggregation(spark):
    """Missing values, locations without a key, long and short texts: what Spark's expressions give for the same rows."""
    from gaugewise.operators import bootstrap

    names = ["x", "y", "z"]
    rows = _triple_rows(spark, seed=8).selectExpr(
        "CASE WHEN gpi <> 2 THEN gpi END AS gpi", "CASE WHEN x < 30 THEN ts END AS ts", "CASE WHEN gpi <> 3 AND z > 10 THEN x END AS x",
        "y", "CASE WHEN gpi <> 4 THEN z END AS z",
    )
    long_keys = rows.selectExpr(f"concat(repeat('k', {60}), gpi) AS gpi", "ts", *names)
    for frame in (rows, long_keys):
        for cells in (None, recurring_cells(SEASONS, 20), yearly_cells()):
            by = ["gpi"] if cells is None else ["gpi", "tsw"]
            for replicates in (100, 13):
                wanted = bootstrap._intervals(frame, names, ["gpi"], replicates, 0.95, cells).collect()
                found = bootstrap._gathered_intervals(frame.repartition(3, "gpi"), names, ["gpi"], replicates, 0.95, cells).collect()
                at = len(by) + 2
                got, wanted = ({tuple(r)[:at]: tuple(r)[at:] for r in some} for some in (found, wanted))
                assert len(found) == len(got) and got.keys() == wanted.keys()
                assert any(low is not None for low, _ in got.values()) and any(low is None for low, _ in got.values())
                for key, bounds in wanted.items():
                    assert got[key] == (pytest.approx(bounds, rel=1e-9, abs=1e-9) if None not in bounds else bounds), key


def test_triple_values_are_the_metrics_of_the_sql(spark):
    """Every case of the formulas: usable, negative variances, covariances of nothing but rounding, missing ones."""
    from gaugewise.operators.bootstrap import triple_values

    rng = np.random.default_rng(3)
    q = {p: rng.normal(0, 1, 300) for p in ("xy", "xz", "yz")} | {p: rng.uniform(0.5, 9, 300) for p in ("xx", "yy", "zz")}
    q["xy"][:40], q["xx"][30:60], q["yz"][50:70], q["zz"][60:80] = 1e-14, 0.0, np.nan, -1e-15
    frame = pd.DataFrame({f"q{k}": v for k, v in q.items()}).reset_index()
    clean = spark.createDataFrame(frame).selectExpr("index", *[f"nullif(q{k}, double('NaN')) AS q{k}" for k in q])
    values = triple_values(q)
    sql = clean.selectExpr("index", *[f"{stats.triple_metric(m, s)} AS v{i}" for i, ((m, s), _) in enumerate(values)])
    for row in sql.collect():
        for i, (name, found) in enumerate(values):
            want = row[f"v{i}"]
            assert np.isnan(found[row["index"]]) if want is None else found[row["index"]] == pytest.approx(want, rel=1e-12), (name, row)


def test_cells_of_all_days_are_those_of_the_windows(spark):
    """The calendar written out against the windows' own predicates, over turns of the century with and without leap day."""
    from gaugewise.operators.subwindows import MONTHS

    days = spark.sql(
        "SELECT explode(array_union(sequence(DATE'1895-01-01', DATE'1905-12-31'), sequence(DATE'1995-01-01', DATE'2009-12-31'))) AS d"
    ).selectExpr("CAST(d AS TIMESTAMP_NTZ) + INTERVAL '23:59:59' HOUR TO SECOND AS ts")
    for windows, overlap in ((SEASONS, 0), (SEASONS, 185), (MONTHS, 10)):
        bits = " + ".join(f"CASE WHEN {w.predicate(overlap=overlap)} THEN {1 << i}L ELSE 0L END" for i, w in enumerate(windows))
        cells = recurring_cells(windows, overlap)
        rows = days.selectExpr("ts", f"{bits} AS wanted", f"{cells.cell} AS _cell").selectExpr("*", f"{cells.windows} AS names")
        found = rows.collect()
        assert [r._cell for r in found] == [r.wanted for r in found]
        assert all(r.names == cells.names(r._cell) for r in found)
    nothing = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS ts")
    for cells, names in ((recurring_cells(SEASONS), ["bulk"]), (yearly_cells(), [None, "bulk"])):
        row = nothing.selectExpr(f"{cells.cell} AS _cell").selectExpr("*", f"{cells.windows} AS names").first()
        assert row.names == cells.names(row._cell) == names


@pytest.mark.parametrize("hot", [False, True])
def test_rank_correlations_of_windows(spark, monkeypatch, hot):
    """Against ranks of every window's own rows: ties, missing values, and rows without location or time."""
    from gaugewise.operators import skew
    from gaugewise.operators.metrics import rank_correlations

    rng = np.random.default_rng(17)
    n = 700
    frame = pd.DataFrame({"gpi": rng.choice([1.0, 2.0, np.nan], n, p=[0.2, 0.2, 0.6]), "day": rng.integers(0, 900, n), "a": rng.integers(0, 40, n)})
    frame["b"], frame["c"] = frame.a * rng.integers(0, 3, n), rng.integers(0, 5, n)
    rows = spark.createDataFrame(frame).selectExpr(
        "CAST(nullif(gpi, double('NaN')) AS BIGINT) AS gpi",
        "CASE WHEN day % 50 <> 7 THEN CAST(date_add(DATE'2000-01-01', CAST(day AS INT)) AS TIMESTAMP_NTZ) END AS ts",
        "CAST(a AS DOUBLE) AS a", "CASE WHEN c <> 2 THEN CAST(b AS DOUBLE) END AS b", "CASE WHEN gpi = 1 THEN 3D ELSE CAST(c AS DOUBLE) END AS c",
    )
    if hot:
        monkeypatch.setattr(skew, "FLOOR", 0)
        monkeypatch.setattr(skew, "PARTS", 4)
    for cells in (recurring_cells(SEASONS, 20), yearly_cells()):
        labelled = rows.withColumn("_cell", F.expr(cells.cell)).withColumn("tsw", F.explode(F.expr(cells.windows))).toPandas()
        wanted = {}
        for (gpi, tsw), own in labelled.groupby(["gpi", "tsw"], dropna=False):
            ranks = {k: own[k].rank() for k in "abc"}
            for other in "bc":
                both = own["a"].notna() & own[other].notna()
                x, y, spread = ranks["a"][both], ranks[other][both], ranks["a"].std(ddof=0) * ranks[other].std(ddof=0)
                rho = ((x - x.mean()) * (y - y.mean())).mean() / spread if both.sum() >= 10 and spread > 0 else None
                wanted[None if pd.isna(gpi) else int(gpi), None if pd.isna(tsw) else tsw, f"a_and_{other}", "rho"] = rho
        found = rank_correlations(rows, "a", ["b", "c"], cells)
        assert found.columns == ["gpi", "tsw", "combo", "metric", "value"]
        got = {tuple(r)[:4]: r.value for r in found.collect()}
        assert got.keys() == wanted.keys() and any(v is None for v in got.values())
        for key, value in wanted.items():
            assert got[key] == (value if value is None else pytest.approx(value, abs=1e-12)), key


def test_windows_are_not_made_by_copies_of_rows(spark):
    """No row is copied into its windows for its draws and ranks: the only sort and shuffle are by location."""
    from gaugewise.operators.metrics import rank_correlations
    from gaugewise.operators.subwindows import MONTHS

    rows = _triple_rows(spark)
    for found in (triple_intervals(rows, ["x", "y", "z"], cells=recurring_cells(MONTHS, 10)),
                  rank_correlations(rows, "x", ["y", "z"], recurring_cells(MONTHS, 10))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
        below = plan[plan.index("MapInArrow"):]
        assert "Generate" not in below and "Window" not in below and "Aggregate" not in below


@pytest.mark.parametrize("size", [1, 7, 100, 1000])
def test_whole_groups_of_batches(size):
    """Groups over any cuts of the batches come whole, one after the other."""
    import pyarrow as pa

    from gaugewise.operators.locations import whole_groups

    keys = [None] * 5 + [1] * 120 + [2] + [3] * 250 + [4, 5, 6] + [7] * 30
    batch = pa.RecordBatch.from_pydict({"k": keys, "v": list(range(len(keys)))})
    batches = [batch.slice(i, size) for i in range(0, len(keys), size)]
    seen = []
    for table, starts in whole_groups([batches[0].slice(0, 0), *batches], ["k"]):
        ends = [*starts[1:], table.num_rows]
        seen += [(table["k"][a].as_py(), table["v"][a:b].to_pylist()) for a, b in zip(starts.tolist(), ends)]
    assert [k for k, _ in seen] == [None, 1, 2, 3, 4, 5, 6, 7]
    assert sum((v for _, v in seen), []) == list(range(len(keys)))


def test_intervals_need_enough_rows(spark):
    rows = [(g, f"2020-01-{k + 1:02d} 0{h}:00:00", 1.0 * (k + h), 2.0 * k + h * h, k * k - 1.5 * h)
            for g, days in ((1, 4), (2, 20)) for k in range(days) for h in (1, 2)]
    matched = spark.createDataFrame(rows, "gpi long, t string, x double, y double, z double").selectExpr(
        "gpi", "CAST(t AS TIMESTAMP_NTZ) AS ts", "x", "y", "z")
    found = triple_intervals(matched, ["x", "y", "z"]).collect()
    assert all(r.lower is None and r.upper is None for r in found if r.gpi == 1)
    assert any(r.lower is not None and r.lower < r.upper for r in found if r.gpi == 2)


def test_metric_names_are_complete():
    for name in stats.PAIR_METRICS:
        assert stats.pair_metric(name)


def test_moments_merge_into_those_of_all_rows(spark):
    from gaugewise.operators import moments

    rng = np.random.default_rng(31)
    n = 400
    frame = pd.DataFrame({"gpi": rng.integers(0, 3, n), "part": rng.integers(0, 9, n), "x": rng.normal(1e6, 1, n)})
    frame["y"], frame["z"] = frame.x * 0.5 + rng.normal(0, 1, n), rng.normal(0, 1, n)
    rows = spark.createDataFrame(frame).selectExpr("gpi", "part", "x", "CASE WHEN part <> 3 THEN y END AS y", "CASE WHEN x > 1e6 THEN z END AS z")
    groups = {"_p_": ("x", "y"), "_t_": ("x", "y", "z")}
    parts = rows.groupBy("gpi", "part").agg(*map(F.expr, moments.row_moments(groups)))
    got = {r.gpi: r.asDict() for r in moments.merge_moments(parts, groups, ["gpi"], ["part"]).collect()}
    for gpi, own in frame.groupby("gpi"):
        pair = own[own.part != 3]
        triple = pair[pair.x > 1e6]
        for prefix, some, names in (("_p_", pair, "xy"), ("_t_", triple, "xyz")):
            m = got[gpi]
            assert m[prefix + "n"] == len(some)
            for a in names:
                assert m[f"{prefix}m{a}"] == pytest.approx(some[a].mean(), rel=1e-12)
                for b in names[names.index(a) :]:
                    wanted = ((some[a] - some[a].mean()) * (some[b] - some[b].mean())).sum()
                    assert m[f"{prefix}c{a}{b}"] == pytest.approx(wanted, rel=1e-6, abs=1e-6)


def test_windows_copy_no_rows(spark, sf_dir):
    from gaugewise.operators.metrics import window_metrics
    from gaugewise.operators.moments import recurring_cells
    from gaugewise.operators.subwindows import MONTHS
    from gaugewise.plans.canonical import triple

    plan = window_metrics(triple(spark, sf_dir), "x", ["y", "z"], recurring_cells(MONTHS, 10), triples=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # from the top: the metrics, then the windows of the moments; below the moments' aggregation nothing is generated
    lines = text.splitlines()
    generated = [k for k, line in enumerate(lines) if "Generate" in line]
    moments_at = max(k for k, line in enumerate(lines) if "partial_covar_pop" in line or "covar_pop" in line)
    assert generated and max(generated) < moments_at


def test_run_status_of_all_combinations(spark):
    from gaugewise.functions.scalar import run_status

    rows = [(p, e, c) for p in (-1, 0, 1, 50, 99, 100) for e in (True, False) for c in ("DONE", "RUNNING", "ERROR")]
    frame = spark.createDataFrame(rows, "progress int, ended boolean, current string")
    for r in frame.withColumn("status", run_status(F.col("progress"), F.col("ended"), F.col("current"))).collect():
        if r.current == "DONE":
            wanted = "DONE"
        elif r.progress < 0:
            wanted = "CANCELLED"
        elif r.ended:
            wanted = "DONE" if r.progress == 100 else "ERROR"
        else:
            wanted = "RUNNING" if r.progress else "SCHEDULED"
        assert r.status == wanted, r


def test_own_metrics_are_one_aggregation(spark, sf_dir):
    from gaugewise.operators.metrics import window_metrics
    from gaugewise.operators.moments import yearly_cells
    from gaugewise.plans.queries_match import OWN_METRICS

    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"gpi": rng.integers(0, 3, 300), "day": rng.integers(0, 900, 300), "a": rng.normal(5, 2, 300)})
    frame["b"] = frame.a + rng.normal(0, 1, 300)
    rows = spark.createDataFrame(frame).selectExpr("gpi", "CAST(date_add(DATE'2000-01-01', CAST(day AS INT)) AS TIMESTAMP_NTZ) AS ts", "a", "b")
    plain = metrics_long(rows, "a", ["b"], own=OWN_METRICS)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.gpi, r.metric): r.value for r in plain.collect()}
    yearly = window_metrics(rows, "a", ["b"], yearly_cells(), own=OWN_METRICS)
    merged = {(r.gpi, r.metric): r.value for r in yearly.where("tsw = 'bulk'").collect()}
    for gpi, own in frame.groupby("gpi"):
        gap = (own.a - own.b).abs()
        wanted = {"MAD": gap.mean(), "max_gap": gap.max(), "NSE": 1 - (gap**2).sum() / ((own.a - own.a.mean()) ** 2).sum()}
        for name, value in wanted.items():
            assert got[gpi, name] == pytest.approx(value) and merged[gpi, name] == pytest.approx(value)
    with pytest.raises(ValueError):
        stats.PairMetric("odd", {"n": "sum({x})"}, "{n}")
    with pytest.raises(ValueError):
        stats.PairMetric("odd", {"s": "sum({x})"}, "{s}", {"s": "avg"})


def test_covariance_of_rounding_is_none(spark):
    """Uncorrelated to the last digit: what is left of the covariance depends on the order of the rows."""
    from gaugewise.functions import stats

    x, y = [0.1, 0.2, 0.4, 0.7, 0.7, 0.4, 0.2, 0.1], [0.3, 0.5, 0.6, 0.9, 0.3, 0.5, 0.6, 0.9]
    y[4:] = y[:4][::-1]
    rows = list(zip(x, [a if k < 4 else -a for k, a in enumerate(y)], [k % 3 + 0.1 * k for k in range(8)]))
    for seed in range(6):
        order = np.random.default_rng(seed).permutation(8)
        frame = spark.createDataFrame([rows[k] for k in order], "x double, y double, z double").coalesce(1)
        moments = frame.groupBy().agg(*map(F.expr, stats.triple_moments("x", "y", "z")))
        row = moments.selectExpr("qxy", *[f"{stats.triple_metric('snr', s)} AS {s}" for s in "xyz"]).first()
        assert abs(row.qxy) < 1e-15 and (row.x, row.y, row.z) == (None, None, None)


def test_beta_median_of_a_symmetric_fit(spark):
    """Location 538 of the tables: its fit is symmetric, so the median lies half way."""
    from gaugewise.functions.beta import distinct_percentiles

    points = [3.0, 4.0, 7.0, 15.0, 26.0, 37.5, 48.0, 48.0, 50.0]
    got = distinct_percentiles(spark.createDataFrame([(points,)], "points array<double>"), "points").first().points
    assert len(got) == 9 and got[4] == pytest.approx(26.5, abs=1e-9)
    assert got[3] + got[5] == pytest.approx(53, abs=1e-9) and got[1] == pytest.approx(4.268893809667871, abs=1e-6)


def test_points_at_one_place_descend_once(spark, monkeypatch):
    from gaugewise.operators import spatial

    seen, original = [], spatial.with_unit_vector
    monkeypatch.setattr(spatial, "with_unit_vector", lambda frame: (seen.append(frame.count()), original(frame))[1])
    points = spark.createDataFrame([(k, float(k % 3), 1.0) for k in range(90)], "gpi long, lon double, lat double")
    candidates = spark.createDataFrame([(7, 0.2, 1.0), (5, 2.0, 1.5)], "gpi long, lon double, lat double")
    hits = {r.gpi: r.other_gpi for r in nearest(points, candidates).collect()}
    assert hits == {k: 5 if k % 3 == 2 else 7 for k in range(90)} and max(seen) == 3


def test_a_rank_sorts_its_column_once(spark):
    rows = [{"gpi": 0, "a": a, "b": b} for a, b in ((1.0, 2.0), (1.0, None), (3.0, 2.0), (None, 2.0), (-0.0, 5.0), (0.0, 1.0))]
    ranked = with_ranks(spark.createDataFrame(rows, "gpi long, a double, b double"), ["gpi"], ["a", "b"])
    got = sorted((r.rank_a or 9, r.rank_b or 9) for r in ranked.collect())
    assert got == sorted([(3.5, 3), (3.5, 9), (5, 3), (9, 3), (1.5, 5), (1.5, 1)])
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 2
