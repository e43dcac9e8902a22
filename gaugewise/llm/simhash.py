"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints within three bits of each other agree in one of four blocks of 16 bits. For each block
they are rotated until it leads and sorted by Gray rank, so that those that agree in it stand
together and neighbours share long patterns. The sorted run is cut into chunks, and a tree over
each chunk keeps, per node, the bits on which all fingerprints below agree. Two nodes whose shared
bits already differ in more than three places are dropped with everything below them. A block value
that fills many chunks is compared chunk against chunk, in as many tasks. Each task sends on a
spanning forest of the links it finds, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.llm.common import ROWS_AT_ONCE, stored

SHINGLE, SEED, MOST_BITS = 3, 42, 3
BANDS = 4
#: Fingerprints in a chunk, and children of a node.
CHUNK, FAN = 1024, 16


def fingerprint(text: str) -> int:
    """64 bits, each set in over half of the shingles' hashes; signed, as Spark's long."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
    return int(majority(hashes[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of ``hashes``, as many words as it has columns; signed."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (key), t (hash of the text) and fp of every row; a null text is the empty one."""
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).alias("k"), F.xxhash64(text_col).alias("t"), text_col.alias("text"))
    schema = source.select("k", "t").schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                fps = [fingerprint(value) for value in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps, pa.int64())], names=["k", "t", "fp"]
                )

    return source.mapInArrow(run, schema)


def rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def gray_rank(code: Column) -> Column:
    """Place of a code word in the Gray sequence. It keeps common leading bits common."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


class Tree:
    """Levels of a chunk's tree, from the root down: per node the bits that all below share, and where."""

    def __init__(self, fps: np.ndarray):
        shared, mask = fps, np.full(len(fps), ~np.uint64(0))
        self.levels = [(shared, mask)]
        while len(shared) > 1:
            starts = np.arange(0, len(shared), FAN)
            ones = np.bitwise_and.reduceat(shared & mask, starts)
            zeros = np.bitwise_and.reduceat(~shared & mask, starts)
            shared, mask = ones, ones | zeros
            self.levels.append((shared, mask))
        self.levels.reverse()


def links(a: np.ndarray, b: np.ndarray | None = None, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all fingerprints within ``most`` bits; without b, pairs inside a."""
    one = Tree(a)
    two = Tree(b) if b is not None else one
    depth = max(len(one.levels), len(two.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(depth):
        # the shallower tree waits at its leaves
        p, q = (t.levels[min(level, len(t.levels) - 1)] for t in (one, two))
        if level:
            i, j = _below(i, j, len(p[0]), level < len(one.levels), len(q[0]), level < len(two.levels))
        if b is None:
            near = i <= j
            i, j = i[near], j[near]
        differ = np.bitwise_count((p[0][i] ^ q[0][j]) & p[1][i] & q[1][j])
        near = differ <= most
        i, j = i[near], j[near]
    if b is None:
        other = i < j
        i, j = i[other], j[other]
    return i, j


def _below(i, j, n_one: int, one: bool, n_two: int, two: bool):
    """All pairs of children of the paired nodes."""
    if one:
        i, j = np.repeat(i * FAN, FAN) + np.tile(np.arange(FAN), len(i)), np.repeat(j, FAN)
        i, j = i[i < n_one], j[i < n_one]
    if two:
        i, j = np.repeat(i, FAN), np.repeat(j * FAN, FAN) + np.tile(np.arange(FAN), len(j))
        i, j = i[j < n_two], j[j < n_two]
    return i, j


def forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked fingerprint to the smallest of its component: at most one each."""
    order = np.argsort(fps, kind="stable")
    place = np.empty(len(fps), np.int64)
    place[order] = np.arange(len(fps))
    label, a, b = np.arange(len(fps)), place[i], place[j]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, side, low)
            np.minimum.at(label, before[side], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[order[moved]], fps[order[label[moved]]]


def _chunks(batches):
    """Chunks of the sorted run: block, its first rank, first and last block value, fingerprints."""

    def out(band, rows):
        ranks, fps = rows[:, 0], rows[:, 1]
        ends = (ranks[[0, -1]] >> 48).tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([band], pa.int32()),
                pa.array([int(ranks[0])], pa.int64()),
                pa.array([ends[0]], pa.int64()),
                pa.array([ends[1]], pa.int64()),
                pa.array([fps.tobytes()], pa.binary()),
            ],
            names=["band", "rank", "first", "last", "fps"],
        )

    band, held = None, np.empty((0, 2), np.int64)
    for batch in batches:
        bands = batch.column(0).to_numpy()
        rows = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
        for value in np.unique(bands).tolist():
            if value != band and len(held):
                yield out(band, held)
                held = held[:0]
            band = value
            held = np.concatenate([held, rows[bands == value]])
            while len(held) >= CHUNK:
                yield out(band, held[:CHUNK])
                held = held[CHUNK:]
    if len(held):
        yield out(band, held)


def _edges(batches):
    """Spanning forest of the links inside a chunk, or between two."""
    for batch in batches:
        us, vs = [], []
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a = np.frombuffer(one, "<u8")
            if two is None:
                fps, (i, j) = a, links(a)
            else:
                b = np.frombuffer(two, "<u8")
                i, j = links(a, b)
                fps, j = np.concatenate([a, b]), j + len(a)
            u, v = forest(fps.view("<i8"), i, j)
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (us, vs)], names=["u", "v"]
        )


def linked(fps: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that join the same fingerprints as all links within three bits do."""
    bands = F.explode(
        F.array(
            *(F.struct(F.lit(b).alias("band"), gray_rank(rotated(F.col("fp"), 16 * b)).alias("rank")) for b in range(BANDS))
        )
    )
    keyed = fps.select("fp").distinct().select(bands.alias("x"), "fp").select("x.band", "x.rank", "fp")
    run = keyed.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")
    chunks = stored(run.mapInArrow(_chunks, "band int, rank long, first long, last long, fps binary"), "gray-chunks")
    later = chunks.select("band", F.col("first").alias("last"), F.col("rank").alias("later"), F.col("fps").alias("two"))
    pairs = chunks.join(later, ["band", "last"]).filter(F.col("rank") < F.col("later"))
    inside = chunks.select("fps", F.lit(None).cast("binary").alias("two"))
    work = inside.unionByName(pairs.select("fps", "two"))
    return work.mapInArrow(_edges, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node with an edge.

    Large-star and small-star steps in turn: every node's neighbours are hung on the smallest of
    them, until all hang on their root. Each step is a minimum and a join on the node.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    current = stored(edges, "edges")
    now = state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, state(current)
        if before == now:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, t, fp and ``first`` (late, k, t) of every row: the first row of its component.

    Rows are ordered by key, null last, then by the hash of the text. Empty texts have fingerprint
    zero and are linked like any others. Rows keep their multiplicity.
    """
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    return of_components(rows, components(linked(rows)))


def of_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows k, t, fp with the first row of their fingerprint's component; roots has node and root."""
    firsts = rows.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("late"), "k", "t")).alias("first"))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left")
    rooted = stored(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    of_root = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_fp = rooted.select("fp", "root").join(of_root, "root").select("fp", "first")
    # a fingerprint on very many rows: the join can split its rows, as each meets one row only
    return rows.join(by_fp, "fp").select("k", "t", "fp", "first")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return grouped(docs, key, text).select(
        F.col("k").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.k").alias("component_id"),
    )


def keep_first(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id; all columns as they are.

    ``groups`` has the components, as ``grouped`` does, if they are not those of the fingerprints.
    """
    groups = grouped(docs) if groups is None else groups
    own = F.struct(F.col("k").isNull().alias("late"), "k", "t")
    kept = groups.filter(own == F.col("first")).select(F.col("k").alias("k2"), F.col("t").alias("t2")).distinct()
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(docs[f"`{c}`"].alias(f"_{n}") for n, c in enumerate(docs.columns) if c != "text")))
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("k"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"),
        F.xxhash64(others).alias("h"),
    )
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2"))
    # rows of one id and text stand together; the one whose other columns hash lowest stays
    chosen = rows.join(kept, same, "left_semi")
    one = F.row_number().over(W.partitionBy("k", "t").orderBy("h"))
    return chosen.withColumn("n", one).filter("n = 1").select("row.*")
