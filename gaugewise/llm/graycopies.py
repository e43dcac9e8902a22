"""Near copies by exact Jaccard of word shingles: SimHash through a Gray-order hierarchical index, then confirmed.

Op7's three bits can't find them: at a Jaccard of 0.8 two 64-bit fingerprints of it differ in ten bits,
and blocks of bits that agree for certain would be four bits long. Here a fingerprint is a SimHash of 128
bits. Near copies differ in 19 of them on average (24 with the fewest shingles), and agree, with a
probability of over 0.9999, in one of 24 blocks of five minima of their shingles. For each block the
fingerprints are sorted by block value and Gray rank and cut into chunks. A tree over each chunk keeps, per
node, the bits of block value and fingerprint that all below share; two nodes whose block values differ, or
whose shared bits already differ in more than RADIUS places, are dropped with everything below them.

First every fingerprint proposes the nearest one before it, inside its chunk and in the chunk where
its block value begins: at most two pairs each, confirmed on the texts. This joins groups of copies.
Blocks whose members are still in several components are then compared in full, chunk against chunk. Those
chunks carry the shingles of their members, so a task confirms what the tree finds, each pair in the first
block they share, and sends on a spanning forest: pairs that aren't near copies never leave it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm import minhash
from gaugewise.llm.common import ROWS_AT_ONCE, stored
from gaugewise.llm.simhash import FAN, _below, components, gray_rank, of_components

#: Most differing bits of 128. At SIMILAR four shingles against five differ most: in 24 bits on average, and in more than
#: this in one of 700 000 pairs; any others in one of 70 million.
RADIUS = 46
#: Share of equal minima from which two texts are held against each other: four deviations below SIMILAR.
NEARLY = 0.65
#: Fingerprints in a chunk, and bytes of shingles.
CHUNK, CHUNK_BYTES = 512, 1 << 22
#: Whether members propose their nearest before the full comparison.
PROPOSE = True

ORDER = ["g", "r1", "r2", "fp"]
CODED = {"g": "long", "r1": "long", "r2": "long", "fp": "long", "one": "long", "two": "long"}
CARRIED = {"c": "long", "band": "long", "sketch": "binary", "grams": "binary"}


class Tree:
    """Levels of a chunk's tree, from the root down: per node the bits that all below share, and where."""

    def __init__(self, words: np.ndarray):
        shared, mask = words, np.full(words.shape, ~np.uint64(0))
        self.levels = [(shared, mask)]
        while len(shared) > 1:
            starts = np.arange(0, len(shared), FAN)
            ones = np.bitwise_and.reduceat(shared & mask, starts)
            zeros = np.bitwise_and.reduceat(~shared & mask, starts)
            shared, mask = ones, ones | zeros
            self.levels.append((shared, mask))
        self.levels.reverse()


def links(a: np.ndarray, b: np.ndarray | None = None, most: int | None = None):
    """Places in ``a`` and ``b`` of all rows (block value, bits...) of one block value within ``most`` bits, and the bits.

    Without b: pairs inside a, each once.
    """
    most = RADIUS if most is None else most
    one = Tree(a)
    two = Tree(b) if b is not None else one
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(one.levels), len(two.levels))):
        # the shallower tree waits at its leaves
        p, q = (t.levels[min(level, len(t.levels) - 1)] for t in (one, two))
        if level:
            i, j = _below(i, j, len(p[0]), level < len(one.levels), len(q[0]), level < len(two.levels))
        if b is None:
            near = i <= j
            i, j = i[near], j[near]
        differ = (p[0][i] ^ q[0][j]) & p[1][i] & q[1][j]
        bits = np.bitwise_count(differ[:, 1:]).sum(1, dtype=np.int64)
        near = (differ[:, 0] == 0) & (bits <= most)
        i, j, bits = i[near], j[near], bits[near]
    if b is None:
        other = i < j
        i, j, bits = i[other], j[other], bits[other]
    return i, j, bits


def _chunks(names: list[str]):
    """Chunks of the sorted run: place of its first row, its last block value, and the columns."""

    def out(columns):
        ends = [int(columns[k][0]) for k in range(len(ORDER))] + [int(columns[0][-1])]
        # a column of binaries travels as one, with the sizes of its parts
        parts = [
            x for column in columns for x in ([column.tobytes()] if isinstance(column, np.ndarray) else [b"".join(column), np.array([len(v) for v in column], "<i8").tobytes()])
        ]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.int64()) for x in ends), *(pa.array([x], pa.binary()) for x in parts)],
            names=[*(f"at_{n}" for n in ORDER), "last", *names],
        )

    def run(batches):
        held = None
        for batch in batches:
            new = [c.to_numpy() if pa.types.is_int64(c.type) else c.to_pylist() for c in batch.columns]
            held = new if held is None else [np.concatenate([h, x]) if isinstance(h, np.ndarray) else h + x for h, x in zip(held, new)]
            while True:
                sizes = [len(v) for v in held[-1]] if isinstance(held[-1], list) else [0] * len(held[0])
                full = np.flatnonzero(np.cumsum(sizes) > CHUNK_BYTES)
                cut = min(CHUNK, max(1, int(full[0])) if len(full) else CHUNK)
                if len(held[0]) <= cut:
                    break
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield out(held)

    return run


def _chunked(run: DataFrame, kinds: dict[str, str], name: str) -> tuple[DataFrame, list[str]]:
    """Chunks of ``run`` in the order of the index, and the names of their contents."""
    names = [part for column, kind in kinds.items() for part in ([column] if kind == "long" else [column, f"{column}_sizes"])]
    ordered = run.select(*kinds).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    schema = ", ".join([*(f"at_{n} long" for n in ORDER), "last long", *(f"{n} binary" for n in names)])
    return stored(ordered.mapInArrow(_chunks(names), schema), name), names


def _place(prefix: str = ""):
    return F.struct(*(F.col(f"{prefix}at_{n}").alias(n) for n in ORDER))


def _numbers(row: dict, name: str, suffix: str) -> np.ndarray:
    return np.frombuffer(row[name + suffix], "<i8")


def _words(row: dict, suffix: str) -> np.ndarray:
    return np.column_stack([_numbers(row, n, suffix) for n in ("g", "one", "two")]).view("<u8")


def _rows(batches):
    for batch in batches:
        for start in range(batch.num_rows):
            yield batch.slice(start, 1).to_pylist()[0]


def _edges_of(u, v) -> pa.RecordBatch:
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], names=["u", "v"])


def _nearest(batches):
    """For every row within RADIUS of an earlier one (or of the other chunk's): the nearest of those."""
    for row in _rows(batches):
        fps = fqs = _numbers(row, "fp", "")
        if row["fp2"] is None:
            j, i, bits = links(_words(row, ""))
        else:
            fqs = _numbers(row, "fp", "2")
            j, i, bits = links(_words(row, "2"), _words(row, ""))
        order = np.lexsort((j, bits, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        yield _edges_of(fps[i[first]], fqs[j[first]])


def proposed(members: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v: at most two for each member of a block, itself and its nearest before it."""
    chunks, names = _chunked(members, CODED, "gray-chunks")
    begins = F.min(F.struct(*(f"at_{n}" for n in ORDER), *names)).alias("b")
    heads = chunks.groupBy("last").agg(begins).select("last", F.struct(*(F.col(f"b.at_{n}").alias(n) for n in ORDER)).alias("from"), *(F.col(f"b.{n}").alias(f"{n}2") for n in names))
    # only chunks that begin inside a block value look back to where it began
    later = chunks.withColumn("at", _place()).drop("last").join(heads, F.col("at_g") == F.col("last")).filter(F.col("from") < F.col("at"))
    inside = chunks.select(*names, *(F.lit(None).cast("binary").alias(f"{n}2") for n in names))
    work = inside.unionByName(later.select(*names, *(f"{n}2" for n in names)))
    return work.mapInArrow(_nearest, "u long, v long").distinct()


def _confirm(batches):
    known = lru_cache(256)(minhash.grams)
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
            near = pa.array([minhash.similar(known(one), known(two)) for one, two in rows], pa.bool_())
            yield part.select(["u", "v"]).filter(near)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are near copies."""
    one = texts.select(F.col("fp").alias("u"), F.col("text").alias("one"))
    two = texts.select(F.col("fp").alias("v"), F.col("text").alias("two"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two")
    return both.mapInArrow(_confirm, "u long, v long")


def forest(one: dict, two: dict | None) -> list[tuple[int, int]]:
    """Edges between near copies of different components that join what all such pairs in the chunks do.

    Sides have words, fp, c, band, sketch and grams (a list). A pair counts in the first block it shares.
    """
    other = one if two is None else two
    i, j, _ = links(one["words"], None if two is None else two["words"])
    edges = []
    roots = np.unique(np.concatenate([one["c"], other["c"]]), return_inverse=True)[1]
    c, d = roots[: len(one["c"])], roots[len(one["c"]) :]
    label = np.arange(roots.max() + 1 if len(roots) else 0)
    for start in range(0, len(i), ROWS_AT_ONCE * 16):
        a, b = i[start : start + ROWS_AT_ONCE * 16], j[start : start + ROWS_AT_ONCE * 16]
        apart = label[c[a]] != label[d[b]]
        a, b = a[apart], b[apart]
        equal = one["sketch"][a] == other["sketch"][b]
        shared = equal.reshape(-1, minhash.BANDS, minhash.MINIMA).all(2).argmax(1)
        near = (shared == one["band"][a]) & (equal.sum(1) >= NEARLY * equal.shape[1])
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            here, there = label[c[x]], label[d[y]]
            if here != there and minhash.similar(one["grams"][x], other["grams"][y]):
                label[label == there] = here
                edges.append((int(one["fp"][x]), int(other["fp"][y])))
    return edges


def _compare(batches):
    def side(row, suffix):
        ends = np.cumsum(_numbers(row, "grams_sizes", suffix)) // 8
        return {
            "words": _words(row, suffix),
            **{n: _numbers(row, n, suffix) for n in ("fp", "c", "band")},
            "sketch": np.frombuffer(row["sketch" + suffix], "<u2").reshape(-1, minhash.BANDS * minhash.MINIMA),
            "grams": np.split(np.frombuffer(row["grams" + suffix], "<u8"), ends[:-1]),
        }

    for row in _rows(batches):
        edges = forest(side(row, ""), None if row["fp2"] is None else side(row, "2"))
        yield _edges_of([u for u, _ in edges], [v for _, v in edges])


def compared(members: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that join what all near copies in one block and different components do."""
    chunks, names = _chunked(members, CODED | CARRIED, "near-chunks")
    first = chunks.select("last", _place().alias("from"), *names)
    later = chunks.select(F.col("at_g").alias("last"), _place().alias("at"), *(F.col(n).alias(f"{n}2") for n in names))
    pairs = first.join(later, "last").filter(F.col("from") < F.col("at"))
    inside = chunks.select(*names, *(F.lit(None).cast("binary").alias(f"{n}2") for n in names))
    work = inside.unionByName(pairs.select(*names, *(f"{n}2" for n in names)))
    return work.mapInArrow(_compare, "u long, v long").distinct()


def _grams(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            found = pa.array([minhash.grams(text).tobytes() for text in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["fp", "grams"])


def grouped(docs: DataFrame) -> DataFrame:
    """k, t, fp and ``first`` of every row, as simhash.grouped has them, for groups of near copies.

    Texts are near copies if their sets of five-word shingles (fewer words: the whole sequence; null: the
    empty text) have a Jaccard of minhash.SIMILAR at least; groups are the components of these links. Rows
    keep their multiplicity; equal sets are one member. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = stored(minhash.sketches(docs), "sketches")
    first = F.min(F.struct(F.col("k").isNull().alias("late"), "k", "t"))
    sets = stored(rows.groupBy("fp").agg(first.alias("first"), *(F.first(n).alias(n) for n in ("one", "two", "sketch"))), "shingle-sets")
    width = 2 * minhash.MINIMA
    blocks = F.array(*(F.struct(F.lit(b).cast("long").alias("band"), F.xxhash64(F.lit(b), F.substring("sketch", width * b + 1, width)).alias("g")) for b in range(minhash.BANDS)))
    members = sets.select(F.explode(blocks).alias("b"), "fp", "one", "two")
    members = members.select("b.g", "b.band", gray_rank(F.col("one")).alias("r1"), gray_rank(F.col("two")).alias("r2"), "fp", "one", "two")
    several = members.groupBy("g").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("g")
    members = stored(members.join(several, "g"), "block-members")

    ids = members.select("fp").distinct()
    chosen = sets.join(ids, "fp").select("fp", F.col("first.k").alias("k1"), F.col("first.t").alias("t1"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = named.join(chosen, F.col("k").eqNullSafe(F.col("k1")) & (F.col("t") == F.col("t1")))
    texts = stored(found.groupBy("fp").agg(F.first("text").alias("text")), "near-texts")

    edges = spark.createDataFrame([], "u long, v long")
    if PROPOSE:
        edges = stored(confirmed(proposed(members), texts), "near-edges")
    labelled = members.join(components(edges), F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("root", "fp"))
    apart = labelled.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("g")
    left = stored(labelled.join(apart, "g").select("band", *CODED, "c"), "apart")
    shingles = texts.join(left.select("fp").distinct(), "fp").select("fp", "text").mapInArrow(_grams, "fp long, grams binary")
    carried = sets.select("fp", "sketch").join(shingles, "fp")
    edges = edges.unionByName(compared(left.join(carried, "fp")))
    return of_components(rows.select("k", "t", "fp"), components(edges))
