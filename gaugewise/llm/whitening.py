"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are sought in a block of vectors Q. Every product with the
covariance, XᵀXQ of the centred rows, is one pass over the rows, whose tasks send on one small matrix
each; the covariance itself is never formed. Between two Rayleigh-Ritz steps Q goes through a Chebyshev
polynomial of the covariance, which damps everything below the block's smallest Ritz value. The
iteration ends when the residuals of the wanted pairs are as small as double precision allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Components returned, and vectors of the block beyond them, at least and as a share.
COMPONENTS, MORE, MORE_SHARE = 32, 8, 0.5
#: Highest degree of a filter, and decimal digits by which it may raise the first pair over the last wanted.
DEGREE, DIGITS = 24, 8
#: Residuals, against the largest eigenvalue, that are good enough at once or when they no longer fall.
FINE, CERTIFIED = 2e-15, 1e-11
#: Filter rounds until an error is raised.
ROUNDS = 200
#: Eigenvalues below this share of the largest are zero: the data do not extend that way.
NOTHING = 1e-12
#: Bytes of a block of rows, and rows in it at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Partial matrices that reach the driver at once.
FAN = 32
SEED = 12


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry as long; null if an entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    numbers = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT))
    return F.when(bad, None).otherwise(numbers)


@dataclass(frozen=True)
class Blocks:
    """Rows packed into matrices: ``ids`` and ``x`` (row by row, 64-bit numbers) of each block."""

    frame: DataFrame
    width: int
    rows: int
    largest: int
    sums: tuple[int, ...]

    @property
    def plain(self) -> bool:
        """Whether n x - S stays within 64 bits, else Python's whole numbers are used."""
        return 2 * self.largest * max(1, self.rows) < 1 << 62

    def apart(self) -> Callable[[bytes], np.ndarray]:
        """A function from a block to n x - S, exact."""
        width, rows, plain = self.width, self.rows, self.plain
        sums = np.array(self.sums, np.int64 if plain else object)

        def of(content: bytes) -> np.ndarray:
            x = np.frombuffer(content, "<i8").reshape(-1, width)
            return (x if plain else x.astype(object)) * rows - sums

        return of

    def centred(self) -> Callable[[bytes], np.ndarray]:
        apart, rows = self.apart(), self.rows
        return lambda content: (apart(content) / rows).astype(np.float64)


def _partials(frame: DataFrame, work: Callable[[Iterator[bytes]], np.ndarray]) -> list[np.ndarray]:
    """``work`` of every task's blocks; matrices of one shape, added up to ``FAN`` of them if there are more."""

    def run(batches):
        made = work(c.as_py() for batch in batches for c in batch.column(0))
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, pa.array([made.astype("<f8").tobytes()], pa.binary())], ["part", "m"])

    def add(batches):
        rows = sorted((p, m) for batch in batches for p, m in zip(*(c.to_pylist() for c in batch.columns)))
        if rows:
            total = sum(np.frombuffer(m, "<f8") for _, m in rows)
            arrays = [pa.array([rows[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "m"])

    parts = frame.select("x").mapInArrow(run, "part int, m binary")
    if frame.rdd.getNumPartitions() > FAN:
        parts = parts.repartition(FAN, F.col("part") % FAN).mapInArrow(add, "part int, m binary")
    return [np.frombuffer(r.m, "<f8") for r in sorted(parts.collect())]


def _total(frame: DataFrame, work: Callable[[Iterator[bytes]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    return sum(_partials(frame, work), np.zeros(math.prod(shape))).reshape(shape)


def pack(rows: DataFrame, key: str, vector: str) -> Blocks:
    """Blocks of the rows whose vector is neither null nor holds null or non-finite entries.

    Vectors shorter than the longest end in zeros. Numbers beyond 64 bits become the nearest that fits.
    """
    clean = rows.select(F.col(key).alias("id"), whole_numbers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    seen = clean.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("most")).first()
    width = seen.width or 0
    at_once = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))

    def into_blocks(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                x = np.full((part.num_rows, width), SHIFT, "<i8")
                lists = part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                # sums of 32-bit halves, so that none overflows
                sums = [int(a) * (1 << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                columns = [
                    ids,
                    pa.array([x.tobytes()], pa.binary()),
                    pa.array([part.num_rows], pa.int64()),
                    pa.array([[str(s) for s in sums]], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "x", "n", "sums"])

    kind = clean.schema["id"].dataType.simpleString()
    frame = stored(clean.mapInArrow(into_blocks, f"ids array<{kind}>, x binary, n long, sums array<string>"), "vectors")
    # one row for each dimension
    per = frame.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = tuple(int(r.s) for r in sorted(per.collect()))
    n = frame.agg(F.sum("n").alias("n")).first().n or 0
    return Blocks(frame, width, n, max(seen.most or 0, SHIFT), sums)


@dataclass(frozen=True)
class Whitening:
    """Eigenpairs by falling eigenvalue (columns of ``vectors``) and what certifies them."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def filter_degree(first: float, last: float, low: float, high: float) -> int:
    """Steps of a filter on [low, high], so that pair ``first`` rises over pair ``last`` by ``DIGITS`` digits at most."""

    def rise(value: float) -> float:
        return math.acosh(max(1.0, (2 * value - low - high) / (high - low)))

    apart = rise(first) - rise(last)
    return DEGREE if apart * DEGREE <= DIGITS * math.log(10) else max(2, int(DIGITS * math.log(10) / apart))


def chebyshev(product, q, aq, first: float, low: float, high: float, degree: int) -> np.ndarray:
    """The polynomial of ``degree`` that is small on [low, high], scaled to 1 at ``first``, applied to ``q``.

    ``aq`` is the product of ``q``, so ``degree`` - 1 further products are needed.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    start = ratio = half / (first - middle)
    before, now = q, (aq - middle * q) * (ratio / half)
    for _ in range(degree - 1):
        following = 1 / (2 / start - ratio)
        before, now = now, (product(now) - middle * now) * (2 * following / half) - (ratio * following) * before
        ratio = following
    return now


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], width: int, most: int, trace: float, seed: int = SEED) -> Whitening:
    """The ``most`` leading eigenpairs of a positive semidefinite matrix known by its products only.

    Fewer, if its rank is lower. Raises if the residuals come to rest above ``CERTIFIED``.
    """
    passes = 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(q)

    size = min(width, most + max(MORE, int(most * MORE_SHARE)))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    last, low = math.inf, None
    for _ in range(ROUNDS):
        aq = counted(q)
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        wanted = int((values[:most] > NOTHING * max(values[0], 0)).sum())
        if not wanted:
            return Whitening(values[:0], q[:, :0], trace, 0.0, passes)
        worst = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        resting = worst > last / 2 and worst <= CERTIFIED
        # a block that spans the whole space is exact after one step, whatever rounding its residuals show
        if worst <= FINE or resting or (size == width and worst <= CERTIFIED):
            return Whitening(values[:wanted].copy(), q[:, :wanted], trace, float(worst), passes)
        last = worst
        # the first block is random, so its smallest Ritz value is near the lower end of the spectrum
        low = max(0.0, values[-1] * 0.9) if low is None else min(low, max(0.0, values[-1] * 0.9))
        high = max(values[-1], 0.01 * values[wanted - 1], low * 1.001)
        if size < width and high < values[0]:
            degree = filter_degree(values[0], values[wanted - 1], low, high)
            q = chebyshev(counted, q, aq, values[0], low, high, degree)
            q /= np.linalg.norm(q, axis=0)
        else:
            q = aq
        q, _ = np.linalg.qr(q)
    raise RuntimeError(f"eigenpairs not certified after {passes} passes: residual {last:.2g}")


def fit(blocks: Blocks, components: int = COMPONENTS) -> Whitening:
    """Leading eigenpairs of the covariance (divisor n) of the packed rows."""
    width, n, centred = blocks.width, blocks.rows, blocks.centred()
    if not n or not width:
        return Whitening(np.zeros(0), np.zeros((width, 0)), 0.0, 0.0, 0)

    def squares(contents):
        return np.array([sum((float((centred(c) ** 2).sum()) for c in contents), 0.0)])

    def product(q: np.ndarray) -> np.ndarray:
        def work(contents):
            total = np.zeros((width, q.shape[1]))
            for c in contents:
                y = centred(c)
                total += y.T @ (y @ q)
            return total

        return _total(blocks.frame, work, (width, q.shape[1])) / n

    trace = float(_total(blocks.frame, squares, (1,))[0]) / n
    return eigenpairs(product, width, min(components, width), trace) if trace > 0 else Whitening(
        np.zeros(0), np.zeros((width, 0)), trace, 0.0, 0
    )


def identity_error(blocks: Blocks, found: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k, n, centred = len(found.values), blocks.rows, blocks.centred()
    if not k:
        return 0.0
    turn = found.vectors / np.sqrt(found.values)

    def work(contents):
        total = np.zeros((k + 1, k))
        for c in contents:
            w = centred(c) @ turn
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return total

    total = _total(blocks.frame, work, (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    One row for each remaining row and component, components numbered from 1 by falling eigenvalue.
    Rows without a usable vector are left out; rows that repeat a key or a vector count each; a null
    key stays null. Directions without variance are no components: rows that are all alike, a single
    row or an empty table give no rows. Equal eigenvalues leave the turn within their space open. A
    ``deviation`` beyond 64 bits is null. Other columns are left out, so their names cannot clash.
    """
    blocks = pack(rows, key, vector)
    found = fit(blocks, components)
    error = identity_error(blocks, found)
    k, n, trace = len(found.values), blocks.rows, found.trace
    turn = found.vectors / np.sqrt(found.values)
    shares = found.values / trace if trace else found.values
    apart, plain = blocks.apart(), blocks.plain

    def deviations(x: np.ndarray) -> list[int | None]:
        if plain and float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return (x**2).sum(1).tolist()
        exact = (x.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(batches):
        for batch in batches if k else ():
            for at in range(batch.num_rows):
                ids, x = batch.column(0)[at].values, apart(batch.column(1)[at].as_py())
                w = (x / n).astype(np.float64) @ turn
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    ids.take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(row),
                    pa.array(w.ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    kind = blocks.frame.schema["ids"].dataType.elementType.simpleString()
    out = blocks.frame.select("ids", "x").mapInArrow(
        whitened,
        f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
    return out.withColumnRenamed("id", key)
