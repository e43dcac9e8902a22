"""Query of the archive audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.llm import warc
from gaugewise.llm.common import stored, table
from gaugewise.llm.registry import query


@query(
    "op5_warc_merkle",
    f"""
    WITH records AS (
        SELECT page_id, floor(page_id / {warc.RECORDS_PER_ARCHIVE})::BIGINT::VARCHAR AS archive,
            strlen('WARC/1.1') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:page:')
            + strlen(page_id::VARCHAR) + strlen('>') + 2 + strlen('WARC-Target-URI: ') + strlen(coalesce(url, '')) + 2
            + strlen('Content-Length: ') + strlen(strlen(coalesce(html, ''))::VARCHAR) + 4 + strlen(coalesce(html, '')) + 4 AS length,
            substr(md5('damage' || page_id), 1, 2) AS sign
        FROM pages
    ), placed AS (
        SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM records
    )
    SELECT archive, start::BIGINT AS "offset", length::BIGINT AS length, page_id AS record_id,
        CASE WHEN sign <= '01' THEN 'missing' ELSE 'changed' END AS status
    FROM placed WHERE sign <= '05'
    """,
)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    both = stored(warc.index(pages, copy=warc.damage_of(F.col("record_id"), F.col("record"))), "archive-index")
    replica = both.filter("copy IS NOT NULL").withColumn("digest", F.col("copy"))
    return warc.audit(both.drop("copy"), replica.drop("copy"))
