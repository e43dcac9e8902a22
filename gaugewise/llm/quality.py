"""Quality rules: counts of bad form, and a log-likelihood ratio of hashed n-grams. DataFrame only.

Words and word pairs fall into hashed buckets. Two multinomials over the buckets are counted, one
from the trusted target texts, one from the whole raw corpus. The score of a text is the sum of
its n-grams' log ratios; divided by their number it is held against a threshold. Ratios are whole
thousandths, so sums are exact and the verdict depends on no order of addition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import SPACE, WORD, bounded

BUCKETS = 1 << 14
#: Trusted texts that the target multinomial is counted from, at most (about; see ``bounded``).
TRUSTED_DOCS = 20_000
#: Least mean log ratio of a kept text, in thousandths.
THRESHOLD = -100

#: Strength of the background when a bucket of the target multinomial is smoothed, in n-grams.
SMOOTHING = 10.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _shift(array: Column, by: int, length: Column | None = None) -> Column:
    """``array`` without its first elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)) if length is None else length)


# Arrays are zipped with shifted copies: an array named inside a lambda could be computed again for
# every element, once the optimizer has put its expression in the place of its name.


def pairs_of(hashes: Column) -> Column:
    """Hashes of the pairs of neighbouring words."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), _shift(hashes, 1, n), lambda a, b: F.xxhash64(a, b))


def windows_of(hashes: Column, pairs: Column) -> Column:
    """Hashes of the five-word windows: two pairs and a word."""
    n = F.greatest(F.size(hashes) - 4, F.lit(0))
    fours = F.zip_with(F.slice(pairs, 1, n), _shift(pairs, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(fours, _shift(hashes, 4, n), lambda a, b: F.xxhash64(a, b))


def _placed(windows: Column) -> Column:
    """Hash and place of each window, sorted; empty where no window is repeated."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(windows) > F.size(F.array_distinct(windows))
    return F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _equal_next(placed: Column) -> Column:
    return F.zip_with(placed, _shift(placed, 1), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))


def _repeated(placed: Column, equal_next: Column) -> Column:
    """Places of the repeated windows, ascending: in ``placed`` a repeated one has an equal neighbour."""
    before = F.slice(F.concat(F.array(F.lit(False)), equal_next), F.lit(1), F.size(equal_next))
    either = F.zip_with(equal_next, before, lambda a, b: a | b)
    places = F.zip_with(placed, either, lambda x, repeated: F.when(repeated, x["i"]))
    return F.sort_array(F.filter(places, lambda i: i.isNotNull()))


def _covered_words(places: Column) -> Column:
    """Each repeated window covers the words up to the next one, five at most."""
    lengths = F.zip_with(places, _shift(places, 1), lambda p, q: F.least(F.lit(5), F.coalesce(q - p, F.lit(5))))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def buckets_of(hashes: Column, pairs: Column) -> Column:
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def form_counts(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` plus the counts of bad form, hashes of the words and pairs, and base_failed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    step = docs.select(*keep, text.alias("text")).select(
        *keep, "text", words_of(F.col("text")).alias("words"), lines.alias("lines")
    )
    step = step.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    step = step.withColumn("pairs", pairs_of(F.col("hashes")))
    step = step.withColumn("windows", windows_of(F.col("hashes"), F.col("pairs")))
    step = step.withColumn("placed", _placed(F.col("windows")))
    step = step.withColumn("equal_next", _equal_next(F.col("placed")))
    step = step.withColumn("places", _repeated(F.col("placed"), F.col("equal_next")))
    step = step.withColumn("n_repeat_words", _covered_words(F.col("places")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.drop("windows", "placed", "equal_next", "places").withColumn("base_failed", failed)


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRUSTED_DOCS) -> list[int]:
    """Log ratio of each bucket, target against raw corpus, in thousandths.

    The raw multinomial is counted over all texts, the target one over about ``most`` trusted texts
    at most (``trusted`` has their keys). Without any n-gram all ratios are zero.
    """
    ids = bounded(trusted.select(F.col(key).alias("trusted_key")).where("trusted_key IS NOT NULL").distinct(), F.col("trusted_key"), most)
    # at most about `most` keys, hence small enough for every executor
    marked = docs.select(F.col(key).alias("k"), words_of(F.col(text).cast("string")).alias("words")).join(
        F.broadcast(ids), F.col("k") == F.col("trusted_key"), "left"
    )
    hashes = marked.select(
        F.col("trusted_key").isNotNull().alias("target"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )
    hashes = hashes.withColumn("pairs", pairs_of(F.col("hashes")))
    grams = hashes.select("target", F.explode(buckets_of(F.col("hashes"), F.col("pairs"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(
        F.count("*").alias("raw"), F.sum(F.col("target").cast("long")).alias("target")
    ).collect()  # one row for each bucket at most
    raw_all, target_all = sum(r.raw for r in counts), sum(r.target for r in counts)
    ratios = [0] * BUCKETS
    if raw_all and target_all:
        for r in counts:
            share = r.raw / raw_all
            smoothed = (r.target + SMOOTHING * share * BUCKETS) / (target_all + SMOOTHING * BUCKETS)
            ratios[r.bucket] = round(1000 * math.log(smoothed / share))
    return ratios


def judge(
    docs: DataFrame,
    ratios: list[int],
    keep: list[str],
    text: str = "text",
    threshold: int = THRESHOLD,
) -> DataFrame:
    """``keep``, counts of bad form, ``base_failed``, ``score`` (sum of log ratios), ``n_grams``, ``kept``.

    A null or empty text has no words and fails. Every text is judged whole, repeated rows alike.
    """
    # one literal of fixed length: folded once, and the same for every row
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    step = form_counts(docs, F.col(text), keep)
    step = step.withColumn("buckets", buckets_of(F.col("hashes"), F.col("pairs"))).drop("hashes", "pairs")
    step = step.withColumn(
        "score", F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))
    ).withColumn("n_grams", F.size("buckets").cast("long"))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold * F.col("n_grams"))
    step = step.drop("buckets").withColumn("kept", kept)
    # a generator, so that a later filter is not pushed down and the counts made once more for it
    return step.select(F.inline(F.array(F.struct(*step.columns))))


def trusted_keys(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts pass; columns stay as they are, whatever their names."""
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    source = row.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    judged = judge(source, fit(source, trusted_keys(labels)), ["row"])
    return judged.filter("kept").select("row.*")
