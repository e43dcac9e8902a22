"""Sketches of word shingles: a SimHash of 128 bits, and minima of 120 permutations for the blocks that near copies share.

A text is the set of its five-word shingles. A bit of the SimHash differs in two texts with a probability
of about the angle of their sets over 180 degrees. Each minimum is equal with one that is their Jaccard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import ROWS_AT_ONCE
from gaugewise.llm.simhash import majority

SHINGLE, SEED = 5, 43
#: Least Jaccard, as a fraction.
SIMILAR = (4, 5)
BANDS, MINIMA = 24, 5

_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * MINIMA), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def grams(text: str) -> np.ndarray:
    """Sorted hashes of the text's shingles; a text of fewer words is one shingle."""
    words = text.encode().lower().split()  # as simhash.fingerprint
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in two words: the majority of their hashes, and of those mixed again."""
    more = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    more = (more ^ more >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return majority(np.column_stack([hashes, more ^ more >> np.uint64(31)]))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each permutation."""
    low = np.full(len(_FACTORS), ~np.uint64(0))
    for start in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[start : start + ROWS_AT_ONCE]
        np.minimum(low, (_FACTORS[:, None] * part + _SHIFTS[:, None]).min(1), out=low)
    return ((low ^ low >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame) -> DataFrame:
    """k (doc_id), t (hash of the text), fp (hash of the shingles), SimHash (one, two) and sketch of every row.

    A null text is the empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                sets = [grams(value) for value in part.column(2).to_pylist()]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], "<u8").view("<i8")
                found = [sketch(x).tobytes() for x in sets]
                words = (pa.array(x, pa.int64()) for x in (fps, *np.array([fingerprint(x) for x in sets]).T))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *words, pa.array(found, pa.binary())],
                    names=["k", "t", "fp", "one", "two", "sketch"],
                )

    schema = source.select("k", "t").schema
    for name in ("fp", "one", "two"):
        schema = schema.add(name, "long")
    return source.mapInArrow(run, schema.add("sketch", "binary"))
