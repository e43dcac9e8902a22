"""Queries of the rule ensemble, of whitening and of the conversation trie."""

from __future__ import annotations

from gaugewise.llm import prefixes, rules, whitening
from gaugewise.llm.common import table
from gaugewise.llm.registry import query


@query("op11_rule_ensemble")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rules.score(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


@query("op12_chebyshev_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# the checksum goes through the bits of every character, as SQL has no function for it
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::BIGINT)"""


@query(
    "op13_prefix_trie",
    f"""
    WITH turns AS (
        SELECT conv_id, length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
            turn FROM conversations WHERE conv_id IS NOT NULL
    ), placed AS (
        SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM turns
    ), ids AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % {prefixes.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), counts AS (
        SELECT conv_id AS base, count(*) AS n FROM turns GROUP BY conv_id
    ), rebuilt AS (
        SELECT ids.conv_id, i, digest, size FROM ids JOIN placed ON placed.conv_id = ids.base AND i <= h
        UNION ALL
        SELECT ids.conv_id, i - h + least(h, coalesce(n, 0)), digest, size
        FROM ids JOIN placed ON placed.conv_id = ids.conv_id AND i > h LEFT JOIN counts ON counts.base = ids.base
    ), strings AS (
        SELECT conv_id, coalesce(list({{'digest': digest, 'size': size}} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS seq
        FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
    ), members AS (
        SELECT conv_id, d, list_transform(seq[1:d], lambda t: t.digest) AS key, CASE WHEN d > 0 THEN seq[d].size ELSE 0 END AS size,
            d = len(seq) AS ends
        FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM strings)
    ), nodes AS (
        SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM members GROUP BY d, key
    ), children AS (
        SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
    ), under AS (
        SELECT key[1:top] AS key, top AS d, sum((n - 1) * size) AS saved, count(*) FILTER (WHERE childless) AS leaves FROM (
            SELECT nodes.*, children.n IS NULL AS childless, unnest(range(nodes.d + 1)) AS top FROM nodes LEFT JOIN children USING (d, key)
        ) GROUP BY ALL
    )
    SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
        leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
    FROM nodes v JOIN under u ON u.d = v.d AND u.key = v.key LEFT JOIN children c ON c.d = v.d AND c.key = v.key
    LEFT JOIN nodes p ON p.d = v.d - 1 AND p.key = v.key[1:v.d - 1]
    """,
)
def op13(spark, sf_dir):
    return prefixes.trie(table(spark, sf_dir, "conversations"))
