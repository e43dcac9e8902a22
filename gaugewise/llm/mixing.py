"""Mixing of sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents fall into shards by a seeded hash. A source gets its next block, the one after n blocks held,
in the first shard where its quotient, wanted tokens up to there / (2 n + 1), reaches half a block: the
highest quotients of all are served, and a source that came off short in one shard has the higher
quotient in the next. So its shards' quotas are the steps of the rounded running total of what its
target asks, and add up to the target however few tokens a shard has. A source's documents in a shard
stand in a seeded order, cut into blocks, and the quota is met by its first blocks, beginning again
where it exceeds them.

All of it is running sums, taken in two levels (blocks of shards, then shards), so no task holds a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.llm.common import WORD, before, stored

SEED = 6
#: Words in a block. Larger blocks do not fit into a shard where a source has but a few words.
BLOCK = 1
#: Words and documents in a shard (on average).
SHARD_WORDS, SHARD_DOCS = 64_000, 4_000
#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words of the mix against those of all documents; and most uses of one word.
SHARE, MOST_USES = 1.5, 2
#: Sources up to this number are sent to every executor.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, uses: int = MOST_USES) -> DataFrame:
    """``rank`` and ``target`` added to ``sizes``, which has a row (``source``, ``size``) for each source.

    Sources stand by code point, null last, and share ``share`` of all words by weight. A source stops
    at ``uses`` times its words; what it can't give is shared anew among the others until none is above.
    Each round is one aggregation, whose two sums reach the driver.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.array(*map(F.lit, weights))[F.col("rank") % len(weights)]
    ranked = stored(sizes.withColumn("rank", place).withColumn("weight", weight), "mix-sources")
    most, weighs = uses * F.col("size"), F.col("weight")
    row = ranked.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.sum(most).alias("most")).first()
    rest, open_, full = share * (row["size"] or 0), row["weight"] or 0, F.lit(False)
    while open_:
        full = F.lit(rest) * weighs / F.lit(open_) > most
        taken = ranked.agg(F.sum(F.when(full, most)).alias("most"), F.sum(F.when(~full, weighs)).alias("weight")).first()
        rest_now, open_now = share * row["size"] - (taken.most or 0), taken.weight or 0
        if open_now == open_:
            break
        rest, open_ = rest_now, open_now
    shared = F.lit(rest) * weighs / F.lit(open_) if open_ else most.cast("double")
    return ranked.withColumn("target", F.when(full, most.cast("double")).otherwise(shared)).drop("weight")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hashed(key: Column, text: Column, seed: int) -> Column:
    """32 bits of an MD5 of key and text, which every engine can compute."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long")


def _placed(docs: DataFrame, key: str, text: str, source: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their source, shard and place; and the words of each source in each shard, with its target."""
    sized = stored(
        docs.select(
            F.col(key),
            F.col(source).cast("string").alias("source"),
            size_of(F.col(text)).alias("size"),
            hashed(F.col(key), F.col(text), seed).alias("mark"),
            hashed(F.col(key), F.col(text), seed + 1).alias("place"),
        ),
        "mix-sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = stored(targets(sums), "mix-targets")
    total = found.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    shards = max(1, -(-(total["size"] or 0) // SHARD_WORDS), -(-(total.n or 0) // SHARD_DOCS))
    table = found.select(F.col("source").alias("name"), "rank", F.col("size").alias("source_size"), "target")
    if total.sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    placed = (
        sized.join(table, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("shard", F.pmod(F.col("mark"), F.lit(shards)))
        .select(F.col(key), "name", "size", "source_size", "target", "rank", "shard", "place")
    )
    parts = placed.groupBy("shard", "rank").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    return placed, parts


def quotas(parts: DataFrame) -> DataFrame:
    """``words`` and whole ``quota`` of each source in each shard; the quotas of a source add up to its target."""

    def held(upto: Column) -> Column:
        """Blocks whose quotient reaches half a block once ``upto`` words of the source have passed."""
        return F.when(F.col("source_size") > 0, F.floor(F.col("target") * upto / F.col("source_size") / BLOCK + 0.5)).otherwise(0)

    running = before(parts, ["rank"], F.col("shard"), {"earlier": "words"})
    step = BLOCK * (held(F.col("earlier") + F.col("words")) - held(F.col("earlier")))
    return running.select("shard", "rank", "words", F.least(step, MOST_USES * F.col("words")).alias("quota"))


def _taken(placed: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """``taken`` of every row: the quota's words, from the documents in their seeded order."""
    order = W.partitionBy("shard", "rank").orderBy("place", F.col(key), "size")
    end = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    taken = sum(
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - use * F.col("words") - F.col("end") + F.col("size")))
        for use in range(MOST_USES)
    )
    return placed.join(quota, ["shard", "rank"]).withColumn("end", end).withColumn("taken", taken)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    Null texts have no words; a null source is a source. Rows with an equal key count as documents of
    their own; those with equal texts too stand next to each other. Without any word nothing is taken.
    A source takes its target to within half a block. Other columns are left out, so their names cannot clash.
    """
    placed, parts = _placed(docs, key, text, source, seed)
    return _taken(placed, quotas(parts), key).select(F.col(key), "size", "source_size", "target", "taken")


def _rounded(cut: DataFrame) -> DataFrame:
    """``shard``, ``rank`` and ``up``: whether the document that a quota cuts counts once more.

    Documents of a source are taken by rising size; one counts once more where the running total of the
    parts (part / size) passes the next half. As sizes only rise, the words rounded off add up to less
    than the longest document.
    """
    share = F.floor(F.col("part") * (1 << 20) / F.col("size")).cast("long")  # whole numbers add up alike in any order
    cut = cut.withColumn("share", share)
    inside = before(cut, ["rank", "size"], F.col("shard"), {"inside": "share"})
    sizes = cut.groupBy("rank", "size").agg(F.sum("share").alias("all"))
    sizes = before(sizes, ["rank"], F.col("size"), {"smaller": "all"}).select("rank", "size", "smaller")
    joined = inside.join(sizes, ["rank", "size"])
    start = F.col("smaller") + F.col("inside")

    def counted(total: Column) -> Column:
        return F.floor((total + (1 << 19)) / (1 << 20))

    return joined.select("shard", "rank", (counted(start + F.col("share")) - counted(start)).cast("int").alias("up"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is used, with its columns as they are.

    Documents stay whole: of each source's documents in a shard one at most is cut by the quota, and
    ``_rounded`` decides whether it counts. Rows equal in doc_id, source and text share their uses evenly.
    """
    placed, parts = _placed(docs, "doc_id", "text", "source", seed)
    taken = _taken(placed.filter("size > 0"), quotas(parts), "doc_id").groupBy("doc_id", "name", "size", "shard", "rank", "place")
    taken = stored(taken.agg(F.sum("taken").alias("taken"), (F.count("*") * F.col("size")).alias("all")), "mix-taken")
    part = F.col("taken") % F.col("all")
    # hash collisions apart one document of a source and shard; of several the largest decides
    cut = taken.filter(part > 0).groupBy("shard", "rank").agg(F.max(F.struct(F.col("all").alias("size"), part.alias("part"))).alias("c"))
    more = _rounded(cut.select("shard", "rank", "c.size", "c.part"))
    times = F.floor(F.col("taken") / F.col("all")) + F.when(part > 0, F.col("up")).otherwise(0)
    taken = taken.join(more, ["shard", "rank"], "left").select(
        F.col("doc_id").alias("k2"), F.col("name").alias("o2"), F.col("size").alias("s2"), F.col("place").alias("p2"),
        times.cast("int").alias("uses"),
    )
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("k"),
        F.col("source").cast("string").alias("o"),
        size_of(F.col("text")).alias("s"),
        hashed(F.col("doc_id"), F.col("text"), seed + 1).alias("p"),
    )
    same = F.col("k").eqNullSafe(F.col("k2")) & F.col("o").eqNullSafe(F.col("o2")) & (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2"))
    used = rows.join(taken.filter("uses > 0"), same)
    return used.withColumn("use", F.explode(F.array_repeat(F.lit(0), F.col("uses")))).select("row.*")
