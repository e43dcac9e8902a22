"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to a number of pivots are computed once and kept with it. For a query the
triangle inequality turns them into a lower bound of its distance to each candidate, the largest
over all pivots, and so into an upper bound of the inner product. Candidates are evaluated in the
order of their bounds, until the next bound is below the k-th best score; no score is estimated.

Vectors with the same nearest pivot, in the order of their distance to it, lie in blocks. A block keeps the
least and largest distance of its vectors to each pivot, and a query block the lowest score that can still count.
A pair of blocks whose best bound is below that is dropped while only these summaries have travelled. The pairs
left meet, each in a task of its own; what a task sends on is the best k of each query in its block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.llm.common import ROWS_AT_ONCE, bounded, stored

#: Pivots besides the origin; rows they are chosen from at most (about; see ``bounded``).
PIVOTS, SAMPLE = 31, 2048
#: Candidates and queries in a block, and candidates evaluated at once.
CANDIDATES, QUERIES, AT_ONCE = 1024, 256, 64
SCALE = 256.0


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component as long; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    numbers = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return F.when(bad, None).otherwise(numbers)


@dataclass(frozen=True)
class Shape:
    """What all vectors have in common: components, and the type that holds them."""

    width: int
    kind: str
    exact_floats: bool

    def matrix(self, vectors: list[list[int]]) -> np.ndarray:
        """Shorter vectors are filled with zeros."""
        out = np.zeros((len(vectors), self.width), self.kind)
        for row, vector in zip(out, vectors):
            row[: len(vector)] = vector
        return out

    def numbers(self, content: bytes, rows: int) -> np.ndarray:
        """For products: floats as long as these are exact, else whole numbers."""
        stored_ = np.frombuffer(content, self.kind).reshape(rows, self.width)
        return stored_.astype(np.float64 if self.exact_floats else np.int64)


def shape_of(vectors: DataFrame) -> Shape:
    row = vectors.agg(
        F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    ).first()
    width, most = row.width or 0, row.most or 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return Shape(width, kind, width * most * most < 1 << 52)


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The origin, then each time the sampled vector farthest from all chosen so far."""
    points = sample.astype(np.float64)
    chosen, near = [np.zeros(points.shape[1])], (points**2).sum(1)
    while len(chosen) <= n and len(points) and near.max() > 0:
        chosen.append(points[int(near.argmax())])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    points = points.astype(np.float64)
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], axis=1)


def upper_bounds(query: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Upper bounds of a query's inner products from its pivot distances and the candidates'.

    The first pivot is the origin, so the first distances are lengths. A margin covers rounding.
    """
    apart = np.abs(table - query).max(1)
    square = query[0] ** 2 + table[:, 0] ** 2
    return (square - apart**2) / 2 + 1e-9 * square + 1e-6


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(query, query_id, query_table, least, block, ids, table, k):
    """The best k of a block, as far as they reach ``least``: ids and scores."""
    bounds = upper_bounds(query_table, table)
    open_ = np.flatnonzero((bounds >= least) & (ids != query_id))
    open_ = open_[np.argsort(-bounds[open_], kind="stable")]
    found_ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(open_), AT_ONCE):
        some = open_[start : start + AT_ONCE]
        if bounds[some[0]] < least:
            break
        found = np.concatenate([found, (block[some] @ query).astype(np.int64)])
        found_ids = np.concatenate([found_ids, ids[some]])
        top = best(found, found_ids, k)
        found, found_ids = found[top], found_ids[top]
        if len(found) == k:
            least = max(least, float(found[-1]))
    return found_ids, found


def block_bound(one: np.ndarray, two: np.ndarray) -> float:
    """Upper bound of all inner products between two blocks, from the (least, largest) distances to each pivot."""
    apart = max(0.0, float(np.maximum(one[0] - two[1], two[0] - one[1]).max()))
    square = one[1][0] ** 2 + two[1][0] ** 2
    return float((square - apart**2) / 2 + 1e-9 * square + 1e-6)


def near_pairs(batches):
    """Numbers of the block pairs that can hold a counting score."""
    for batch in batches:
        ends = ([np.frombuffer(x).reshape(2, -1) for x in batch.column(k).to_pylist()] for k in (2, 3))
        kept = pa.array([block_bound(q, c) >= least for q, c, least in zip(*ends, batch.column(4).to_pylist())], pa.bool_())
        yield batch.select([0, 1]).filter(kept)


def _placed(vectors: DataFrame, shape: Shape, pivots: np.ndarray) -> DataFrame:
    """Vectors in the order of their nearest pivot and their distance to it."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                table = pivot_distances(shape.matrix(part.column(1).to_pylist()), pivots)
                # the origin is the nearest of all where vectors have unit length, and parts none of them
                near = table[:, 1:].argmin(1) + 1 if table.shape[1] > 1 else np.zeros(len(table), np.int64)
                far = table[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(near, pa.int64()), pa.array(far)], names=["id", "v", "near", "far"]
                )

    placed = vectors.select("id", "v").mapInArrow(run, "id long, v array<long>, near long, far double")
    # the id parts vectors that are equal, so that these fill blocks in several tasks
    return placed.repartitionByRange("near", "far", "id").sortWithinPartitions("near", "far", "id")


def _packed(vectors: DataFrame, shape: Shape, pivots: np.ndarray, rows: int, sample=None, k: int = 0) -> DataFrame:
    """Blocks of at most ``rows`` vectors: ids, vectors, pivot distances, each one's least score, ends and lowest.

    ``ends`` are the least and largest distances to each pivot, ``lowest`` the lowest of the least scores.

    The least score of a query is its k-th best among the sample, which no k-th best of all is below.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column(0).to_numpy().astype("<i8")
                matrix = shape.matrix(part.column(1).to_pylist())
                table = pivot_distances(matrix, pivots)
                least = np.full(len(ids), -np.inf)
                if sample is not None:
                    points = shape.numbers(matrix.tobytes(), len(ids))
                    scores = (points @ shape.numbers(sample[1].tobytes(), len(sample[0])).T).astype(np.float64)
                    scores[ids[:, None] == sample[0][None, :]] = -np.inf
                    if scores.shape[1] >= k:
                        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                ends = np.stack([table.min(0), table.max(0)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x.tobytes()], pa.binary()) for x in (ids, matrix, table, least, ends)), pa.array([least.min()])],
                    names=["ids", "vectors", "table", "least", "ends", "lowest"],
                )

    packed = _placed(vectors, shape, pivots).select("id", "v").mapInArrow(
        run, "ids binary, vectors binary, table binary, least binary, ends binary, lowest double"
    )
    return packed.withColumn("block", F.monotonically_increasing_id())


def search(vectors: DataFrame, queries: Column, key: str, vector: str, k: int) -> DataFrame:
    """The best ``k`` of all rows for each row where ``queries`` holds: query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's own key; a query's key repeated is asked once,
    with the smallest of its vectors (component by component).
    Equal scores go to the smaller key. Rows without key, without vector, or with a component that is
    null or not finite take no part. Other columns are left out, so their names cannot clash.
    """
    wanted = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("v"), queries.alias("q"))
    wanted = wanted.filter("id IS NOT NULL AND v IS NOT NULL")
    shape = shape_of(wanted)
    rows = bounded(wanted.select("id", "v"), F.col("id"), SAMPLE).collect()
    sample = np.array([r.id for r in rows], np.int64), shape.matrix([r.v for r in rows])
    pivots = pick_pivots(sample[1])

    candidates = stored(_packed(wanted, shape, pivots, CANDIDATES), "pivot-table")
    asked = wanted.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(_packed(asked, shape, pivots, QUERIES, sample, k), "query-blocks")
    lanes = max(1, candidates.count())
    # summaries of the blocks: a candidate block's goes to one lane, a query block's to all of them
    few = candidates.select("block", "ends", F.pmod(F.xxhash64("block"), F.lit(lanes)).alias("lane"))
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<bigint>")).alias("lane")
    lowest = asked.select(F.col("block").alias("q_block"), F.col("ends").alias("q_ends"), "lowest", every)
    pairs = lowest.join(few, "lane").select("q_block", "block", "q_ends", "ends", "lowest")
    pairs = stored(pairs.mapInArrow(near_pairs, "q_block long, block long"), "block-pairs")
    names = ("ids", "vectors", "table", "least")
    met = pairs.join(asked.select(F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in names)), "q_block")
    met = met.join(candidates.select("block", *names[:3]), "block").drop("block", "q_block")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                q_ids, ids = np.frombuffer(part["q_ids"], "<i8"), np.frombuffer(part["ids"], "<i8")
                asked_, block = shape.numbers(part["q_vectors"], len(q_ids)), shape.numbers(part["vectors"], len(ids))
                q_table = np.frombuffer(part["q_table"]).reshape(len(q_ids), -1)
                table, least = np.frombuffer(part["table"]).reshape(len(ids), -1), np.frombuffer(part["q_least"])
                out = [
                    search_block(q, q_id, t, low, block, ids, table, k)
                    for q, q_id, t, low in zip(asked_, q_ids, q_table, least)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, [len(found) for found, _ in out]), pa.int64()),
                        pa.array(np.concatenate([found for found, _ in out]), pa.int64()),
                        pa.array(np.concatenate([scores for _, scores in out]), pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
