"""Fixity audit of web archives by Merkle trees over records and offset ranges.

Each record is hashed where it is read, and its digest with offset and length where it lies; whole records
are never shuffled. An archive is cut into ranges of equal length by
offset; a range's hash covers its records in order, and every node above covers FAN ranges of the
level below. Replicas are compared from the roots down: only children of nodes that differ are
looked at, until the records that differ are known. Nodes are small rows in a stored table, so an
audit of equal replicas reads their roots only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugewise.llm.common import stored

#: Bytes of the ranges at the lowest level, as a power of two, and children of a node likewise.
RANGE_BITS, FAN_BITS = 16, 4
#: Differing nodes up to this number are sent to every executor.
BROADCAST_NODES = 100_000

RECORDS_PER_ARCHIVE = 1000


def record_of(key: Column, url: Column, content: Column) -> Column:
    """A WARC response record as text; nulls are empty."""
    content, url = F.coalesce(content, F.lit("")), F.coalesce(url, F.lit(""))
    length = F.octet_length(content).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        length,
        F.lit("\r\n\r\n"),
        content,
        F.lit("\r\n\r\n"),
    )


def records_of(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html", per: int = RECORDS_PER_ARCHIVE):
    """Pages as records: archive, record_id and record, in no order.

    An archive has the records of ``per`` consecutive keys (pages without key: one archive of their own
    for each first hex digit pair of the URL's MD5). Other columns are left out, so their names cannot clash.
    """
    return pages.select(
        F.col(key).cast("long").alias("record_id"),
        F.coalesce(
            F.floor(F.col(key) / per).cast("string"), F.concat(F.lit("none-"), F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 2))
        ).alias("archive"),
        record_of(F.col(key), F.col(url).cast("string"), F.col(content).cast("string")).alias("record"),
    )


def digest_of(record: Column) -> Column:
    """SHA-256 of a record; a null record is the empty one."""
    return F.sha2(F.coalesce(record.cast("string"), F.lit("")).cast("binary"), 256)


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows (archive, record_id, length, digest, others) with their offset, in order of id and digest, null ids first.

    Equal rows follow each other as records of their own. Give digests, not records: the rows are shuffled and sorted.
    """
    order = W.partitionBy("archive").orderBy("record_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def index(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html", per: int = RECORDS_PER_ARCHIVE, **versions):
    """archive, offset, length, record_id and digest of every record of ``pages``, as ``archive`` places them.

    ``versions`` are further columns made from record_id and record, such as a replica's digest.
    """
    records = records_of(pages, key, url, content, per).withColumn("length", F.octet_length("record").cast("long"))
    own = [digest_of(F.col("record")).alias("digest"), *(made.alias(name) for name, made in versions.items())]
    return laid_out(records.select("archive", "length", "record_id", *own)).select("archive", "offset", "length", "record_id", "digest", *versions)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html", per: int = RECORDS_PER_ARCHIVE):
    """Pages as records of archives: archive, offset, length, record_id and record.

    This writes archives; an audit needs ``index`` only. Equal rows follow each other as records of their own.
    """
    records = records_of(pages, key, url, content, per)
    whole = records.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", digest_of(F.col("record")))
    return laid_out(whole).select("archive", "offset", "length", "record_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, length, record_id and digest (of place, length and content) of every record.

    Records have their content as ``record``, or its SHA-256 as ``digest``.
    """
    content = F.col("digest") if "digest" in records.columns else digest_of(F.col("record"))
    digest = F.sha2(F.concat_ws(":", "offset", "length", content).cast("binary"), 256)
    return records.select("archive", "offset", "length", "record_id", digest.alias("digest"))


def _level_of(rows: DataFrame, node: Column, level: int) -> DataFrame:
    """Nodes over rows (archive, place, hash): the hash of the hashes in their order."""
    group = rows.groupBy("archive", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("below"))
    hashes = F.concat_ws(",", F.transform("below", lambda x: F.concat_ws(":", x["place"], x["hash"])))
    return group.select(F.lit(level).alias("level"), "archive", "node", F.sha2(hashes.cast("binary"), 256).alias("hash"))


def height_of(*replicas: DataFrame) -> int:
    """Levels above the ranges until one node covers the longest archive of all replicas."""
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in replicas]
    ranges, height = max(ends) >> RANGE_BITS, 0
    while ranges:
        ranges >>= FAN_BITS
        height += 1
    return height


def tree(found: DataFrame, height: int) -> list[DataFrame]:
    """Nodes by level, ranges first and roots last. A range holds what begins in it; a node FAN nodes."""
    rows = found.select("archive", F.col("offset").alias("place"), F.col("digest").alias("hash"))
    levels = [stored(_level_of(rows, F.shiftright("place", RANGE_BITS), 0), "merkle")]
    for level in range(1, height + 1):
        rows = levels[-1].select("archive", F.col("node").alias("place"), "hash")
        levels.append(stored(_level_of(rows, F.shiftright("place", FAN_BITS), level), "merkle"))
    return levels


def _within(rows: DataFrame, parents: DataFrame, parent: Column) -> DataFrame:
    """Rows whose parent node differs."""
    few = F.broadcast(parents) if parents.count() <= BROADCAST_NODES else parents
    return rows.withColumn("parent", parent).join(
        few.select("archive", F.col("node").alias("parent")), ["archive", "parent"], "left_semi"
    ).drop("parent")


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.select("archive", "node", "hash").join(two.select("archive", "node", F.col("hash").alias("other")), ["archive", "node"], "full")
    return both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records that differ: archive, offset, length and record_id (of ``one``, else of ``two``), status.

    ``changed``: another digest at this offset; ``missing``: not in ``two``; ``extra``: only there.
    Records (archive, offset, length, record_id, and record or digest) may come in any order. Several records at
    one offset count as one whose digest covers them all. Empty replicas agree.
    """
    one, two = (stored(leaves(r), "leaves") for r in (one, two))
    height = height_of(one, two)
    trees = tree(one, height), tree(two, height)
    bad = stored(_differing(trees[0][height], trees[1][height]), "differing")
    for level in range(height - 1, -1, -1):
        sides = (_within(t[level], bad, F.shiftright("node", FAN_BITS)) for t in trees)
        bad = stored(_differing(*sides), "differing")
    sides = []
    for found in (one, two):
        near = _within(found, bad, F.shiftright("offset", RANGE_BITS))
        digest = F.concat_ws(",", F.sort_array(F.collect_list("digest")))
        sides.append(near.groupBy("archive", "offset").agg(F.max("length").alias("length"), F.min("record_id").alias("record_id"), digest.alias("digest")))
    other = sides[1].select("archive", "offset", *(F.col(c).alias(f"{c}2") for c in ("length", "record_id", "digest")))
    both = sides[0].join(other, ["archive", "offset"], "full").filter(~F.col("digest").eqNullSafe(F.col("digest2")))
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return both.select(
        "archive", "offset", F.coalesce("length", "length2").alias("length"), F.coalesce("record_id", "record_id2").alias("record_id"), status.alias("status")
    )


def damage_of(key: Column, record: Column) -> Column:
    """A replica's digest of a record, with damage that depends on its id: two in 256 lost (null), four in 256 altered."""
    sign = F.substring(F.md5(F.concat(F.lit("damage"), key.cast("string"))), 1, 2)
    altered = F.when(sign.isin("02", "03", "04", "05"), digest_of(F.concat(record, F.lit("~")))).otherwise(digest_of(record))
    return F.when(F.coalesce(~sign.isin("00", "01"), F.lit(True)), altered)
