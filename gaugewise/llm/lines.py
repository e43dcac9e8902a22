"""Cross-site line dedup: lines that many sites carry stay in one document only. DataFrame only.

Per line hash, HyperLogLog sketches of the sites are merged by the aggregation, together with the
first place of the line. The estimate decides the lines far from the threshold; those near it get
an exact distinct count. A line found to be boilerplate stays at its first place and goes elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import SPACE, WORD, stored

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 8
#: Estimates within this part of the threshold are counted exactly; several times the sketch's error.
NEAR = 0.25
#: Binary logarithm of the sketch's size; the relative error is about 1.6 %.
SKETCH = 12
#: Boilerplate lines up to this number are sent to every executor (some 30 bytes each).
BROADCAST_LINES = 200_000


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")


def _hashed(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """A row for each line that has a word: k, t (hash of the text), site, line hash h, place i."""
    source = docs.select(
        F.col(key).alias("k"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # the text is hashed before its lines are laid out: beside the generator it would be hashed for every line
    source = source.withColumn("t", F.xxhash64("text"))
    lines = source.select("k", "t", "site", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.filter(F.col("line").rlike(WORD)).select("k", "t", "site", "i", F.xxhash64(trimmed(F.col("line"))).alias("h"))


def boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """Lines on ``min_sites`` sites or more: hash ``h`` and its first place ``first`` (k, t, i).

    Places are ordered by key (null last), text hash and position. A null site is the empty one.
    """
    lines = _hashed(docs, key, text, site)
    place = F.struct(F.col("k").isNull().alias("late"), "k", "t", "i")
    spread = lines.groupBy("h").agg(
        F.hll_sketch_agg("site", SKETCH).alias("sketch"), F.min(place).alias("first"), F.count("*").alias("n")
    )
    counted = spread.filter(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    # few lines reach so many sites; written, as both branches below read it
    wide = stored(counted.filter(F.col("sites") >= min_sites * (1 - NEAR)), "line-spread")
    sure = F.col("sites") > min_sites * (1 + NEAR)
    near = wide.filter(~sure)
    # counted over distinct (line, site) pairs, so that a line on very many rows is merged before it travels
    exact = lines.select("h", "site").join(_small(near.select("h")), "h", "left_semi").distinct().groupBy("h").count()
    exact = exact.filter(F.col("count") >= min_sites).select("h")
    return wide.filter(sure).select("h", "first").unionByName(near.join(exact, "h", "left_semi").select("h", "first"))


def _small(frame: DataFrame) -> DataFrame:
    """For a join: sent to every executor only if counted to be small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_LINES else frame


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """``row`` (all columns as they were), new ``text``, ``n_lines`` and ``n_removed`` of every row.

    A text without boilerplate comes back as it is, a null one as null; otherwise the remaining lines
    are joined by line feeds. Lines without a word always stay. Rows equal in key and text are one
    document and are treated alike; rows keep their multiplicity.
    """
    found = stored(boilerplate(docs, key, text, site, min_sites), "boilerplate")
    lines = _hashed(docs, key, text, site).select("k", "t", "i", "h").join(_small(found), "h")
    first = F.struct(F.col("k").isNull().alias("late"), "k", "t", "i")
    dropped = lines.filter(first != F.col("first")).select("k", "t", "i").distinct()
    dropped = dropped.groupBy("k", "t").agg(F.collect_list("i").alias("gone"))  # a text's own lines at most
    source = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.col(key).alias("k"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"),
    )
    dropped = dropped.select(F.col("k").alias("k2"), F.col("t").alias("t2"), "gone")
    joined = source.join(dropped, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    joined = joined.select("row", "gone", F.col(f"row.`{text}`").cast("string").alias("text"))
    # a generator, so that the array of lines is made once and not again for every line looked up in it
    joined = joined.select(F.inline(F.array(F.struct("row", "gone", "text", F.split("text", "\n").alias("lines")))))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, "gone"), lambda i: F.get("lines", i))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with new texts; every row and column stays, ``n_chars`` follows the text."""
    out = dedup(docs)
    columns = [
        F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return out.select(*columns)
