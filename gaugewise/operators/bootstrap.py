"""Bootstrap confidence intervals of the triple collocation metrics.

Every matched row draws a Poisson(1) weight per replicate instead of being resampled by
index: the weighted sums of all replicates then come out of one aggregation with
map-side combine, where index resampling would need a self-join of every series.
Replicates that share a hash are columns of that aggregation, so a row is copied once for
eight of them. The draws
are slices of the MD5 of (location, microsecond, block of replicates), so rows, replicates
and locations are independent, and a rerun of a lost task gives the same result.

The sums of a location are wider than its rows, so the rows travel, once, and a location is summed where
its rows are: the weights of all replicates form a matrix, and the sums are its product with that of the rows.
Only locations that hold a large share of all rows are summed map-side, by the aggregation. A draw does not depend
on a sub-window: sums are taken once a cell of days that lie in the same windows, and merged; windows that
hold the same cells of a location have the same intervals, which are computed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions import stats
from gaugewise.operators import locations
from gaugewise.operators.moments import Cells

REPLICATES = 100
CONFIDENCE = 0.95

#: Replicates that one hash serves, with four hex digits each.
BLOCK, DIGITS = 8, 4
# The Poisson(1) distribution function.
POISSON_ONE = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.999998874797402,
)


#: Rows that are hashed and weighted at once inside a task, and groups whose replicates are evaluated at once.
ROWS_AT_ONCE, GROUPS_AT_ONCE = 8192, 256

#: The products whose sums give the covariances.
PRODUCTS = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))


def block_hash(key: str, micros: str, block: str) -> str:
    """The MD5 that a block of replicates is drawn from (SQL text)."""
    return f"md5(concat_ws('|', {key}, {micros}, {block}))"


def poisson_weight(draw: str) -> str:
    """Poisson(1) weight of a number in hex digits, which sort like the numbers they stand for (SQL text)."""
    limits = [f"{round(limit * 16**DIGITS):0{DIGITS}x}" for limit in POISSON_ONE if round(limit * 16**DIGITS) < 16**DIGITS]
    cases = " ".join(f"WHEN {draw} < '{limit}' THEN {k}" for k, limit in enumerate(limits))
    return f"CASE {cases} ELSE {len(limits)} END"


def replicate_sums(
    matched: DataFrame, names: Sequence[str], by: Sequence[str] = ("gpi",), replicates: int = REPLICATES
) -> DataFrame:
    """Weighted sums of the three series per group and block of replicates, and the rows ``_rows`` of the group.

    A row stands in every block once, with a weight for each replicate of the block; the sums of a block's
    replicates are columns of one aggregation: ``_<replicate in block>_<n, x, y, z, xx, ...>``.
    """
    x, y, z = (f"`{n}`" for n in names)
    keys = [f"`{k}`" for k in by]
    products = ", ".join(f"{a} * {b} AS {a}{b}" for a, b in PRODUCTS).split(", ")
    rows = matched.selectExpr(*keys, f"{x} AS x", f"{y} AS y", f"{z} AS z", "unix_micros(CAST(ts AS TIMESTAMP)) AS _t")
    drawn = (
        rows.selectExpr("*", *products)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // BLOCK) - 1))))
        .withColumn("_h", F.expr(block_hash(f"`{by[0]}`", "_t", "_block")))
        .selectExpr("*", *[f"{poisson_weight(f'substring(_h, {r * DIGITS + 1}, {DIGITS})')} AS _w{r}" for r in range(BLOCK)])
    )
    sums = ["count(1) AS _rows"]
    for r in range(BLOCK):
        sums.append(f"sum(_w{r}) AS _{r}_n")
        sums += [f"sum(_w{r} * {s}) AS _{r}_{s}" for s in (*"xyz", *(a + b for a, b in PRODUCTS))]
    return drawn.groupBy(*by, "_block").agg(*map(F.expr, sums))


def window_sums(
    matched: DataFrame, names: Sequence[str], cells: Cells, by: Sequence[str] = ("gpi",), replicates: int = REPLICATES
) -> DataFrame:
    """``replicate_sums`` of every group and sub-window (``tsw``), merged from those of its cells."""
    sums = replicate_sums(matched.withColumn("_cell", F.expr(cells.cell)), names, [*by, "_cell"], replicates)
    spread = sums.withColumn("tsw", F.explode(F.expr(cells.windows)))
    merged = [F.sum(c).alias(c) for c in sums.columns if c not in (*by, "_cell", "_block")]
    return spread.groupBy(*by, "tsw", "_block").agg(*merged)


def triple_intervals(
    matched: DataFrame,
    names: Sequence[str],
    by: Sequence[str] = ("gpi",),
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    cells: Cells | None = None,
) -> DataFrame:
    """``by, metric, dataset, lower, upper``: percentile intervals of snr, beta and err_std, null
    where a group has too few rows for the metrics themselves. With ``cells`` there are intervals of
    every sub-window (``tsw`` after ``by``).

    The percentiles are over ``replicates`` values per group, a fixed number, held in one array.
    """
    gathered, hot = locations.by_location(matched, by[0])
    found = _gathered_intervals(gathered, names, by, replicates, confidence, cells)
    return found if hot is None else found.unionByName(_intervals(hot, names, by, replicates, confidence, cells))


def _intervals(
    matched: DataFrame, names: Sequence[str], by: Sequence[str], replicates: int, confidence: float, cells: Cells | None
) -> DataFrame:
    if cells is None:
        sums = replicate_sums(matched, names, by, replicates)
    else:
        sums, by = window_sums(matched, names, cells, by, replicates), [*by, "tsw"]
    keys = [f"`{k}`" for k in by]
    # sample covariances of every replicate of the block, as one array: the metrics are written once for all of them
    replicas = ", ".join(
        f"CASE WHEN _{r}_n > 1 AND _block * {BLOCK} + {r} < {replicates} THEN struct("
        + ", ".join(f"(_{r}_{a}{b} - _{r}_{a} * _{r}_{b} / _{r}_n) / (_{r}_n - 1) AS q{a}{b}" for a, b in PRODUCTS)
        + ") END"
        for r in range(BLOCK)
    )
    wanted = [(metric, side) for metric in stats.TRIPLE_METRICS for side in stats.TRIPLE_SIDES]
    arrays = [
        f"transform(_q, q -> CASE WHEN q IS NOT NULL THEN {stats.triple_metric(metric, side, 'q.')} END) AS _{metric}_{side}"
        for metric, side in wanted
    ]
    values = (
        sums.selectExpr(*keys, "_rows", f"array({replicas}) AS _q")
        .selectExpr(*keys, "_rows", *arrays)
        .groupBy(*by)
        .agg(
            F.max("_rows").alias("_rows"),
            *[
                F.expr(f"array_sort(array_compact(flatten(collect_list(_{metric}_{side})))) AS _{metric}_{side}")
                for metric, side in wanted
            ],
        )
    )
    dataset = dict(zip(stats.TRIPLE_SIDES, names))
    tail = (1 - confidence) / 2
    entries = ", ".join(
        f"struct('{metric}' AS metric, '{dataset[side]}' AS dataset, _{metric}_{side} AS _v)" for metric, side in wanted
    )
    enough = f"_rows >= {stats.MIN_OBS}"
    return values.selectExpr(*keys, "_rows", f"inline(array({entries}))").selectExpr(
        *keys,
        "metric",
        "dataset",
        f"CASE WHEN {enough} THEN {_quantile('_v', tail)} END AS lower",
        f"CASE WHEN {enough} THEN {_quantile('_v', 1 - tail)} END AS upper",
    )


def _quantile(values: str, q: float) -> str:
    """Interpolated quantile of a sorted array without nulls (SQL text); null of an empty one."""
    at = f"({q!r}D * (size({values}) - 1))"
    low, high = f"get({values}, CAST(floor({at}) AS INT))", f"get({values}, CAST(ceil({at}) AS INT))"
    return f"{low} + ({at} - floor({at})) * ({high} - {low})"


# --- gathered locations -----------------------------------------------------------------------

#: Weight of every draw.
_WEIGHTS = np.searchsorted(
    [limit for limit in (round(p * 16**DIGITS) for p in POISSON_ONE) if limit < 16**DIGITS], np.arange(16**DIGITS), side="right"
).astype(np.float64)

# Fixed values of MD5: rotations and constants of its steps, and its initial state.
_MD5_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_MD5_STATE = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Bytes of a text that one round of MD5 takes.
_MD5_ROOM = 55


def _gathered_intervals(
    rows: DataFrame, names: Sequence[str], by: Sequence[str], replicates: int, confidence: float, cells: Cells | None
) -> DataFrame:
    """``_intervals`` of rows that lie by location."""
    x, y, z = (f"CAST(`{n}` AS DOUBLE)" for n in names)
    keys = [f"`{k}`" for k in by]
    # a block's text (see block_hash) without the number of the block
    text = f"concat_ws('|', {keys[0]}, unix_micros(CAST(ts AS TIMESTAMP)), '')"
    ordered = rows.selectExpr(
        *keys, f"{x} AS _x", f"{y} AS _y", f"{z} AS _z", f"{text} AS _text", f"{cells.cell if cells else '0L'} AS _cell"
    ).sortWithinPartitions(*by, "_cell", "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*by).schema)
    found = ordered.mapInArrow(
        _interval_task(list(by), replicates, confidence, cells),
        f"{schema}, _tsw array<string>, _lower array<double>, _upper array<double>",
    )
    wanted = [(metric, name) for metric in stats.TRIPLE_METRICS for name in names]
    entries = ", ".join(
        f"struct('{metric}' AS metric, '{name}' AS dataset, _lower[{i}] AS lower, _upper[{i}] AS upper)"
        for i, (metric, name) in enumerate(wanted)
    )
    if cells is not None:
        found = found.selectExpr(*keys, "explode(_tsw) AS tsw", "_lower", "_upper")
        keys = [*keys, "tsw"]
    return found.selectExpr(*keys, f"inline(array({entries}))")


def _interval_task(
    by: list[str], replicates: int, confidence: float, cells: Cells | None
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tails = (1 - confidence) / 2, 1 - (1 - confidence) / 2

    def run(batches):
        for table, starts in locations.whole_groups(batches, by):
            runs, firsts, present = locations.segments(table, starts)
            sums, filled, counts = _segment_sums(table, runs, replicates)
            groups, windows = [], []  # rows of the result: the group's number; names of windows and numbers of segments
            for g, (first, last) in enumerate(zip(firsts, [*firsts[1:], len(runs)])):
                for labels, numbers in locations.shared_windows(present[first:last], cells):
                    groups.append(g)
                    windows.append((labels, [first + n for n in numbers]))
            for k in range(0, len(groups), GROUPS_AT_ONCE):
                some = windows[k : k + GROUPS_AT_ONCE]
                q = _covariances(
                    np.stack([sums[at].sum(0) for _, at in some]), np.stack([filled[at].any(0) for _, at in some])
                )
                values = np.stack([v for _, v in triple_values(q)], 1)
                enough = np.array([counts[at].sum() >= stats.MIN_OBS for _, at in some])
                lower, upper = (np.where(enough[:, None], _quantiles(values, tail), np.nan) for tail in tails)
                at = pa.array(starts[groups[k : k + GROUPS_AT_ONCE]])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(table.column(c).combine_chunks().take(at) for c in by),
                        pa.array([labels for labels, _ in some], pa.list_(pa.string())),
                        *(_lists(bound) for bound in (lower, upper)),
                    ],
                    names=[*by, "_tsw", "_lower", "_upper"],
                )

    return run


def _lists(values: np.ndarray) -> pa.Array:
    """A row's numbers as a list, NaN as null."""
    flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), flat)


def _segment_sums(table: pa.Table, runs: np.ndarray, replicates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows from each of ``runs`` on: weighted sums (run, 1 and series and products, replicate), which
    of these have a value, and the rows."""
    n, width = table.num_rows, 1 + 3 + len(PRODUCTS)
    ends = np.append(runs[1:], n)
    sums, filled = np.zeros((len(runs), width, replicates)), np.zeros((len(runs), width), bool)
    for begin in range(0, n, ROWS_AT_ONCE):
        some = table.slice(begin, ROWS_AT_ONCE)
        series, present = zip(*(locations.doubles(some.column(f"_{s}")) for s in "xyz"))
        value, there = dict(zip("xyz", series)), dict(zip("xyz", present))
        one = np.ones(some.num_rows)
        with np.errstate(all="ignore"):
            terms = np.stack([one, *series, *(value[a] * value[b] for a, b in PRODUCTS)])
        known = np.stack([one > 0, *present, *(there[a] & there[b] for a, b in PRODUCTS)])
        weights = _WEIGHTS[draws(some.column("_text").cast(pa.string()).combine_chunks(), replicates)]
        end = begin + some.num_rows
        for r in range(np.searchsorted(ends, begin, side="right"), np.searchsorted(runs, end)):
            at = slice(max(runs[r], begin) - begin, min(ends[r], end) - begin)
            with np.errstate(all="ignore"):
                sums[r] += terms[:, at] @ weights[at]
            filled[r] |= known[:, at].any(1)
    return sums, filled, ends - runs


def _covariances(sums: np.ndarray, filled: np.ndarray) -> dict[str, np.ndarray]:
    """Sample covariances (group, replicate) by name; NaN where the aggregation has NULL."""
    with np.errstate(all="ignore"):
        sums = np.where(filled[:, :, None], sums, np.nan)
        n = np.where(sums[:, 0] > 1, sums[:, 0], np.nan)
        of = {s: sums[:, 1 + i] for i, s in enumerate("xyz")}
        return {a + b: (sums[:, 4 + i] - of[a] * of[b] / n) / (n - 1) for i, (a, b) in enumerate(PRODUCTS)}


def triple_values(q: dict[str, np.ndarray]) -> list[tuple[tuple[str, str], np.ndarray]]:
    """``stats.triple_metric`` of covariances by name, for each metric and side; NaN for NULL."""
    out = []
    with np.errstate(all="ignore"):
        usable = np.logical_and.reduce(
            [np.abs(q[a + b]) > stats.ROUNDING * np.sqrt(q[a * 2] * q[b * 2]) for a, b in ("xy", "xz", "yz")]
        )
        scales = {"x": np.ones_like(q["xx"]), "y": q["xz"] / q["yz"], "z": q["xy"] / q["yz"]}
        sides = {"x": ("xy", "xz", "yz"), "y": ("xy", "yz", "xz"), "z": ("xz", "yz", "xy")}
        for metric in stats.TRIPLE_METRICS:
            for side in stats.TRIPLE_SIDES:
                own, (a, b, opposite) = q[side * 2], (q[c] for c in sides[side])
                if metric == "beta":
                    value = scales[side]
                elif metric == "err_std":
                    value = np.sqrt(own - a * b / opposite) * np.abs(scales[side])
                else:
                    noise = own * opposite / (a * b) - 1
                    value = np.where(noise > 0, -10 * np.log10(noise), np.nan)
                out.append(((metric, side), np.where(usable, value, np.nan)))
    return out


def _quantiles(values: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantile over the last axis without NaN; NaN where nothing is left."""
    ranked = np.sort(values, axis=-1)
    at = q * (np.count_nonzero(~np.isnan(ranked), axis=-1) - 1)
    low, high = (np.take_along_axis(ranked, np.maximum(f(at), 0).astype(int)[..., None], -1)[..., 0] for f in (np.floor, np.ceil))
    return low + (at - np.floor(at)) * (high - low)


def draws(texts: pa.StringArray, replicates: int) -> np.ndarray:
    """The number that each row draws for every replicate: the slices of ``block_hash`` that ``poisson_weight`` reads."""
    blocks = -(-replicates // BLOCK)
    out = np.empty((len(texts), blocks, BLOCK), np.uint16)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(ends)
    if len(texts) and sizes.max() + len(str(blocks - 1)) > _MD5_ROOM:
        for i, text in enumerate(texts.to_pylist()):
            for block in range(blocks):
                digest = hashlib.md5(f"{text}{block}".encode(), usedforsecurity=False).digest()
                out[i, block] = np.frombuffer(digest, ">u2")
        return out.reshape(len(texts), -1)[:, :replicates]
    message = np.zeros((len(texts), 64), np.uint8)
    if texts.buffers()[2] is not None:
        message[np.arange(64) < sizes[:, None]] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    words = np.ascontiguousarray(message.view("<u4").T)
    spread, at = words.view(np.uint8).reshape(16, len(texts), 4), np.arange(len(texts))
    for block in range(blocks):  # a later number is as long or longer, and covers the one before
        tail = str(block).encode()
        for i, byte in enumerate(tail + b"\x80"):
            spread[(sizes + i) // 4, at, (sizes + i) % 4] = byte
        words[14] = (sizes + len(tail)) * 8
        state = _md5(words).view(np.uint8).reshape(4, len(texts), 4)
        # two bytes make four hex digits, the first byte the first two
        for k in range(BLOCK):
            high, low = state[k // 2, :, k % 2 * 2], state[k // 2, :, k % 2 * 2 + 1]
            out[:, block, k] = high.astype(np.uint16) << 8 | low
    return out.reshape(len(texts), -1)[:, :replicates]


def _md5(words: np.ndarray) -> np.ndarray:
    """The MD5 state (4, n) after one round over the message words (16, n)."""
    state = np.repeat(_MD5_STATE[:, None], words.shape[1], 1)
    a, b, c, d = state.copy()
    f = np.empty_like(a)
    for i, turn in enumerate(_MD5_TURNS):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[g]
        f += _MD5_ADDED[i]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    state += np.stack([a, b, c, d])
    return state
