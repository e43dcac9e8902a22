"""Queries of the operators that compare rows with rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.llm import simhash, topk
from gaugewise.llm.common import table
from gaugewise.llm.registry import query


@query(
    "op1_pivot_topk",
    """
    WITH numbers AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), asked AS (
        SELECT vec_id, min(v) AS v FROM numbers WHERE vec_id % 50 = 0 GROUP BY vec_id
    ), scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM asked q JOIN numbers c ON c.vec_id <> q.vec_id
    ), ranked AS (
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM scores
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op1(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)


@query("op7_simhash_gray")
def op7(spark, sf_dir):
    return simhash.components_of(table(spark, sf_dir, "documents"))
