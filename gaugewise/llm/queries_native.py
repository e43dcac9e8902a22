"""Queries of the operators on form, lines and sources."""

from __future__ import annotations

from gaugewise.llm import lines, mixing, quality
from gaugewise.llm.common import table
from gaugewise.llm.registry import query

BLANK, FULL = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@query(
    "op6_source_mix",
    f"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{FULL}+')), 0) AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS mark FROM documents
    ), sums AS (
        SELECT source, sum(size)::DOUBLE AS s, count(*) AS n FROM sized GROUP BY source
    ), ranked AS (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums
    ), weighed AS (
        SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM ranked
    ), filling AS (
        SELECT *,
            1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(w) OVER (ORDER BY 2 * s / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
        FROM weighed
    ), judged AS (
        SELECT *, coalesce(rest * w / open > 2 * s, false) AS is_full FROM filling
    ), targets AS (
        SELECT source, rank, s, n, CASE WHEN is_full THEN 2 * s ELSE
            (1.5::DOUBLE * sum(s) OVER () - sum(CASE WHEN is_full THEN 2 * s ELSE 0 END) OVER ()) * w
            / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target
        FROM judged
    ), shards AS (
        SELECT greatest(1, ceil(sum(s) / {mixing.SHARD_WORDS}), ceil(sum(n) / {mixing.SHARD_DOCS}))::BIGINT AS shards FROM sums
    ), placed AS (
        SELECT d.doc_id, d.size, t.rank, t.s, t.target,
            ('0x' || substr(md5('{mixing.SEED}:' || mark), 1, 8))::BIGINT % (SELECT shards FROM shards) AS shard,
            ('0x' || substr(md5('{mixing.SEED + 1}:' || mark), 1, 8))::BIGINT AS place
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), parts AS (
        SELECT shard, rank, sum(size)::BIGINT AS words, any_value(s) AS s, any_value(target) AS target FROM placed GROUP BY shard, rank
    ), running AS (
        SELECT *, sum(words) OVER (PARTITION BY rank ORDER BY shard) AS upto FROM parts
    ), quotas AS (
        SELECT shard, rank, words, CASE WHEN s > 0 THEN least(2 * words, {mixing.BLOCK} * (floor(target * upto / s / {mixing.BLOCK} + 0.5)
            - floor(target * (upto - words) / s / {mixing.BLOCK} + 0.5))) ELSE 0 END AS quota FROM running
    ), ends AS (
        SELECT p.*, words, quota,
            sum(p.size) OVER (PARTITION BY p.shard, p.rank ORDER BY place, doc_id, p.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
        FROM placed p JOIN quotas USING (shard, rank)
    )
    SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
        (greatest(0, least(size, quota - until + size)) + greatest(0, least(size, quota - words - until + size)))::BIGINT AS taken
    FROM ends
    """,
)
def op6(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_quality_ratio")
def op8(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, quality.trusted_keys(labels)), ["doc_id"])


@query(
    "op9_line_spread",
    f"""
    WITH cut AS (
        SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents
    ), placed AS (
        SELECT doc_id, site, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut
    ), worded AS (
        SELECT *, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS body FROM placed
    ), wide AS (
        SELECT body, min({{'late': doc_id IS NULL, 'k': doc_id, 'i': i}}) AS first FROM worded
        WHERE regexp_matches(line, '{FULL}') GROUP BY body HAVING count(DISTINCT site) >= {lines.MIN_SITES}
    ), decided AS (
        SELECT doc_id, i, line, wide.body IS NOT NULL AND {{'late': doc_id IS NULL, 'k': doc_id, 'i': i}} <> first AS gone
        FROM worded LEFT JOIN wide USING (body)
    ), joined AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text,
            count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
        FROM decided GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
    FROM documents d LEFT JOIN joined j USING (doc_id)
    """,
)
def op9(spark, sf_dir):
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_lines", "n_removed")
